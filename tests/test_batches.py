"""Denominator batch and ratio report on hand-made sheets and feeds."""

from panelwright.plans import batches

SHEET = "yr int, data_item string, nsw double, vic double"
MEMBERS, ITEMS = {"nsw": "NSW", "vic": "Vic"}, {"First": "first", "Preschool": "pre"}


def sheet(spark):
    return spark.createDataFrame(
        [(2014, "First", 100.0, 80.0), (2014, "Preschool", 50.0, None), (2015, "First", 90.0, 70.0), (2015, "Preschool", 45.5, 0.0)], SHEET
    )


def test_denominator_batch_takes_last_years_migration_out(spark, rows):
    obs = [("5", "3", "1", "2014-Q2", "30"), ("6", "3", "1", "2014-Q2", "70"), ("5", "1", "1", "2014-Q2", "9"), ("5", "3", "1", "2014-Q3", "9"), ("10", "3", "1", "2014-Q2", "9"), ("5", "3", "2", "2014-Q2", "10")]
    obs = spark.createDataFrame(obs, "age string, sex string, region string, time_period string, obs_value string")
    feed = "time string, age string, measure string, region string, obs_value string"
    overseas = spark.createDataFrame([("2014", "A59", "3", "1", "20"), ("2014", "A59", "1", "1", "99"), ("2014", "A59", "3", "2", "5")], feed)
    interstate = spark.createDataFrame([("2014", "A59", "3", "1", "-10")], feed)
    got = batches.denominator_batch(sheet(spark), obs, overseas, interstate, MEMBERS, ITEMS, school="first", numerator="pre")
    assert rows(got["migration"].select("state_code", "nom", "imig", "net_mig_grp")) == [("1", 20.0, -10.0, 10.0), ("2", 5.0, 0.0, 5.0)]
    assert rows(got["apportioned"].select("state_code", "age", "p", "net_mig_sya")) == [("1", 5, 0.3, 3.0), ("1", 6, 0.7, 7.0), ("2", 5, 1.0, 5.0)]
    # 2014's migration is taken out of 2015; 2014 has none before it.
    assert rows(got["revised"].select("yr", "state", "first", "first_revised")) == [
        (2014, "NSW", 100, None), (2014, "Vic", 80, None), (2015, "NSW", 90, 87.0), (2015, "Vic", 70, 65.0),
    ]
    shares = {(r.yr, r.state, r.series): (r.numerator, r.percent, r.ratio) for r in got["ratios"].collect()}
    assert shares[2015, "NSW", "first_revised"] == (45.0, 51.7, "pre / first_revised")  # 45.5 is truncated
    assert shares[2014, "Vic", "first"][:2] == (None, None) and shares[2015, "Vic", "pre"][1] is None
    assert len(shares) == 12


def test_ratio_report_and_its_slices(spark, rows):
    got = batches.ratio_report(sheet(spark), MEMBERS, ["Preschool"])
    assert (2015, "NSW", "Preschool", 46.0) in rows(got["series"])  # half to even
    slices = batches.report_slices(got["ratios"], ["NSW", "Vic"], [2015], ["First"], ["Preschool / First"])
    assert rows(slices["count_table"]) == [(2015, "NSW", "First", 90.0), (2015, "Vic", "First", 70.0)]
    assert rows(slices["ratio_table"]) == [(2015, "NSW", "Preschool", 46.0, "First", 90.0, 51.1), (2015, "Vic", "Preschool", 0.0, "First", 70.0, 0.0)]
    assert slices["count_chart"].count() == 2 and slices["ratio_chart"].count() == 2
    assert batches.ratio_report(sheet(spark).limit(0), MEMBERS, ["Preschool"])["ratios"].count() == 0
