"""Hand-made panels for the rules that the driver tables can not show."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import adjust, cohort, enrolment, ratios, reshape, scenario, select, windows
from panelwright.operators.scenario import Horizon

CUBE = "state string, yr int, age int, erp double, cohort int"


def cube_of(spark, cells):
    return spark.createDataFrame([(s, y, a, v, y - a) for s, y, a, v in cells], CUBE)


def test_population_cube_filters_and_labels(spark, rows):
    obs = spark.createDataFrame(
        [
            ("4", "3", "1", "2013-Q2", "10"),
            ("4", "1", "1", "2013-Q2", "11"),  # other sex
            ("4", "3", "1", "2013-Q3", "12"),  # other quarter
            ("10", "3", "1", "2013-Q2", "13"),  # too old
            ("9", "3", "AUS", "2009-Q2", "14"),  # cohort 2000
            ("9", "3", "AUS", "2010-Q2", "15"),
            ("0", "3", "X", "2010-Q2", "16"),  # unknown region
        ],
        "age string, sex string, region string, time_period string, obs_value string",
    )
    assert rows(cohort.population_cube(obs)) == [
        ("2010", 2010, "Aust", 9, 15.0, 2001),
        ("2010", 2010, None, 0, 16.0, 2010),
        ("2013", 2013, "NSW", 4, 10.0, 2009),
    ]


def test_cohorts_without_first_age_are_left_out(spark, rows):
    cube = cube_of(spark, [("a", 2010, 0, 5.0), ("a", 2011, 1, 6.0), ("a", 2011, 2, 7.0), ("a", 2012, 0, None)])
    table = cohort.cohort_table(cube, range(3))
    assert rows(table) == [(2010, "a", 2014, 5.0, 6.0, None), (2012, "a", 2016, None, None, None)]


def test_duplicate_cells_stop_the_query(spark):
    cube = cube_of(spark, [("a", 2010, 0, 5.0), ("a", 2010, 0, 6.0)])
    with pytest.raises(Exception, match="more than one value for age 0"):
        cohort.cohort_table(cube).collect()


def test_lag_goes_to_the_previous_row(spark, rows):
    cube = cube_of(spark, [("a", 2010, 0, 100.0), ("a", 2012, 2, 110.0), ("a", 2013, 3, 99.0), ("a", 2017, 7, 50.0)])
    assert rows(windows.lag_change(cube).select("yr", "chg", "p_chg")) == [(2012, 10.0, 0.1), (2013, -11.0, -0.1)]
    assert windows.lag_change(cube, first_cohort=2011).count() == 0


def test_enrolment_and_fractions(spark, rows):
    counts = spark.createDataFrame(
        [
            (2014, "a NSW", "b 5 years", "a Pre-Year 1 (Foundation Year)", 30.0),
            (2014, "a NSW", "b 5 years", "a Pre-Year 1 (Foundation Year)", 10.0),
            (2014, "a NSW", "c 6 years", "a Pre-Year 1 (Foundation Year)", 60.0),
            (2014, "Other", "a 4 years and under", "a Pre-Year 1 (Foundation Year)", 7.0),
            (2014, "a NSW", "b 5 years", "b Year 1", 99.0),
        ],
        "year int, state string, age string, grade string, all_ages double",
    )
    wide = enrolment.enrolment_by_age(counts)
    assert rows(wide.drop("grade")) == [
        (2014, "Aust", 40.0, 60.0, 107.0, 100.0),
        (2014, "NSW", 40.0, 60.0, 100.0, 100.0),
        (2014, "Other", 0.0, 0.0, 7.0, 0.0),
    ]
    fractions = {r.state: (r.yr, r.orig_yr, r.p5, r.p6) for r in enrolment.age_fraction(wide).collect()}
    assert fractions["NSW"] == (2013, 2014, 0.4, 0.6)
    assert fractions["Other"] == (2013, 2014, None, None)


def test_adjusted_denominator(spark, rows):
    cube = cube_of(
        spark, [("NSW", 2013, 4, 100.0), ("NSW", 2014, 5, 110.0), ("NSW", 2013, 5, 200.0), ("NSW", 2014, 6, 190.0)]
    )
    lagged = spark.createDataFrame(
        [(2013, "NSW", 2014, 1000.0, 0.4, 0.6), (2014, "NSW", 2015, 1000.0, 0.4, 0.6)],
        "yr int, state string, orig_yr int, val double, p5 double, p6 double",
    )
    got = enrolment.migration_adjusted_denominator(lagged, cohort.inverse_change_factors(cube))
    # 100/110 = 0.9091, 200/190 = 1.0526
    assert rows(got.select("yr", "inv_chg_4_5", "inv_chg_5_6", "measure")) == [(2013, 0.9091, 1.0526, 995.0)]


def panel_of(spark, data):
    return spark.createDataFrame(
        data, "yr int, state string, measure double, erp_4 double, erp_5 double, enrol_lagged double"
    )


def test_rebase_removes_the_mean_gap_before_the_split(spark):
    panel = panel_of(
        spark,
        [(y, "SA", 110.0 if y < 2013 else 101.0, 100.0, 100.0, 1.0) for y in (2010, 2011, 2013, 2014, 2021)],
    )
    got = {r.yr: (r.measure_adj, r.measure_new) for r in adjust.rebase_segment(panel, ["state"]).collect()}
    assert got[2010] == (pytest.approx(99.0), pytest.approx(99.0))
    assert got[2013] == (101.0, 101.0)
    assert got[2014] == (None, 101.0)
    assert 2021 not in got


def test_rebase_is_null_when_a_gap_is_missing(spark):
    panel = panel_of(spark, [(2010, "SA", 110.0, 100.0, 100.0, 1.0), (2011, "SA", None, 100.0, 100.0, 1.0)])
    assert [r.measure_adj for r in adjust.rebase_segment(panel, ["state"]).collect()] == [None, None]


def test_rebased_member_is_truncated(spark, rows):
    panel = panel_of(spark, [(2012, "SA", 111.0, 100.0, 100.0, 1.0), (2013, "SA", 102.9, 100.0, 100.0, 2.0)])
    got = adjust.append_rebased_member(panel).where("state = 'SA (adj)'")
    # 111 - 11% of 111 = 98.79
    assert rows(got.select("yr", "measure", "enrol_lagged")) == [(2012, 98.0, 1.0), (2013, 102.0, 2.0)]


def test_outlier_rules(spark):
    data = [("Q", y, v) for y, v in [(2014, 1.0), (2015, 2.0), (2016, 30.0), (2017, 40.0), (2018, 5.0), (2019, 60.0)]]
    data += [("S", y, float(y - 2000)) for y in range(2014, 2020)] + [("N", 2014, 7.4), ("N", 2015, None)]
    df = spark.createDataFrame(data, "state string, yr int, measure double")
    rules = spark.createDataFrame(
        [
            ("Q", 0, 2015, "drop_first"),
            ("Q", 2018, 2018, "smooth"),
            ("S", 0, 9999, "smooth"),
            ("S", 2018, 2018, "drop_last"),
        ],
        "state string, first int, last int, action string",
    )
    got = adjust.outlier_repair(df, rules, "measure", ["state"], ["yr"])
    by = {(r.state, r.yr): r.repaired for r in got.collect()}
    assert [by["Q", y] for y in range(2014, 2020)] == [None, None, 30.0, 40.0, 35.0, 60.0]
    assert [by["S", y] for y in range(2014, 2020)] == [None, 15.0, 16.0, 17.0, None, None]
    assert [by["N", 2014], by["N", 2015]] == [7.0, None]


CHANGES = "state string, yr int, age int, erp double, cohort int, chg double, p_chg double"


def changes_of(spark):
    data = []
    for state, recent in (("up", 0.02), ("down", -0.02), ("flat", 0.0)):
        for yr in range(2015, 2022):
            p = recent if yr == 2021 else {2015: 9.0, 2016: 0.01, 2017: 0.02, 2018: 0.03, 2019: 0.04, 2020: 9.0}[yr]
            data.append((state, yr, 1, 1000.0, yr - 1, 1000.0 * p, p))
    return spark.createDataFrame(data, CHANGES)


def test_scenarios(spark, rows):
    changes = changes_of(spark)
    # Usual growth: the mean over 2016..2019.
    a = scenario.scenario_rates_a(changes)
    assert rows(a.where("state = 'up'")) == [("up", 1, 0.02, 0.01, 0.025, 0.025)]
    b = {r.state: r.B_2023 for r in scenario.scenario_rates_b(changes).collect()}
    # Members that did not grow, zero included, ease; the others return to half of the usual rate.
    assert b == {"up": 0.0125, "down": -0.01, "flat": 0.0}
    tall = scenario.scenario_long(a)
    assert {r.yr for r in tall.collect()} == {2022, 2023, 2024, 2025}
    assert {r.age_turn for r in tall.collect()} == {"0 to 1 yr"}


def cohort_rows(spark, values, cohort_year=2021):
    return spark.createDataFrame(
        [(cohort_year, "a", cohort_year + 4, age, cohort_year + age, v) for age, v in enumerate(values)],
        "cohort int, state string, yr_in_erp4 int, age int, yr int, erp_at_age double",
    )


def rates_of(spark, per_age, cohort_year=2021):
    data = [
        ("a", age, s, cohort_year + age, r) for age, r in per_age.items() for s in ("A", "B") if r is not None
    ]
    return spark.createDataFrame(data, "state string, age int, scenario string, yr int, rate double")


def project(spark, values, per_age, cohort_year=2021, last_year=2100):
    out = scenario.project_cohorts(
        cohort_rows(spark, values, cohort_year), rates_of(spark, per_age, cohort_year), last_year=last_year
    )
    return [r.erp_a for r in out.orderBy("age").collect()]


def test_projection_fills_four_steps_and_truncates_last(spark):
    tenth = {a: 0.1 for a in range(1, 6)}
    # 15, 16.5, 18.15, 19.965, 21.9615, then the fifth step is not taken.
    assert project(spark, [15.0, None, None, None, None, None], tenth) == [15, 16, 18, 19, 21, None]


def test_projection_keeps_known_values_and_restarts_after_them(spark):
    tenth = {a: 0.1 for a in range(1, 6)}
    assert project(spark, [10.0, None, 50.0, None, None, None], tenth) == [10, 11, 50, 55, 60, 66]


def test_projection_needs_every_rate_on_the_way(spark):
    assert project(spark, [10.0, None, None, None, None, None], {1: 0.1, 2: None, 3: 0.1}) == [10, 11, None, None, None, None]


def test_leading_nulls_stay(spark):
    assert project(spark, [None, None, 7.0, None, None, None], {1: 0.1, 2: 0.1, 3: 0.0}) == [None, None, 7, 7, None, None]


def test_zero_rates_keep_the_cohort_and_the_horizon_cuts(spark):
    assert project(spark, [9.0, None, None, None, None, None], {a: 0.0 for a in range(1, 6)}, last_year=2025) == [9] * 5


def test_projection_by_age_repeats_the_first_projected_year(spark, rows):
    data = [("a", 2021, 5, 50, 50), ("a", 2021, 4, 40, 40), ("a", 2022, 5, 41, 42), ("a", 2022, 4, 31, 32), ("a", 2023, 4, 1, 1)]
    projected = spark.createDataFrame(data, "state string, yr int, age int, erp_a int, erp_b int")
    assert rows(scenario.projection_by_age(projected)) == [
        (2021, "a", "NA", 50, 40),
        (2022, "a", "ERP_A", 41, 31),
        (2022, "a", "ERP_B", 42, 32),
        (2022, "a", "NA", 41, 31),
        (2022, "a", "NA", 42, 32),
    ]


def test_new_cohort_is_the_mean_of_three_years(spark, rows):
    cube = cube_of(spark, [("a", y, 0, v) for y, v in [(2017, 99.0), (2018, 1.0), (2019, 2.0), (2020, 6.0)]])
    assert rows(scenario.seed_new_cohort(cube, 2021)) == [("a", 2021, 0, 3.0, 2021)]
    rates = {r.scenario: r.rate for r in scenario.scaled_rates(changes_of(spark).where("state = 'up'"), Horizon()).collect()}
    assert rates == {"Zero": 0.0, "Med": 0.0125, "High": 0.025}


def test_ranges_sum_the_members(spark):
    data = [(2015, s, "N.A.", v, v, v - 1, v + 1) for s, v in (("a", 10.0), ("b", 20.0), ("Aust", 999.0))]
    data += [(2016, "a", "Zero", 1.0, 2.0, 1.0, 3.0), (2016, "b", "Zero", 1.0, None, 1.0, 3.0)]
    fitted = spark.createDataFrame(
        data + data[:1], "yr int, state string, assumption string, erp_4yr double, fitted double, lower double, upper double"
    )
    got = {(r.yr, r.state): r for r in scenario.member_sum_projection(fitted).collect()}
    total = got[2015, "Aust"]
    assert (total.erp_4yr_zero, total.fitted_med, total.lower_high, total.upper_high) == (30.0, 30.0, 28.0, 32.0)
    assert (got[2016, "Aust"].erp_4yr_zero, got[2016, "Aust"].fitted_zero) == (2.0, None)
    assert got[2016, "a"].fitted_med is None


def test_migration_is_merged_and_apportioned(spark, rows):
    feed = "time string, age string, measure string, region string, obs_value string"
    overseas = spark.createDataFrame(
        [("2010", "A04", "3", "0", "100"), ("2010", "A59", "3", "1", "50"), ("2010", "A04", "1", "0", "7")], feed
    )
    interstate = spark.createDataFrame([("2010", "A59", "3", "1", "-20")], feed)
    merged = adjust.migration_merge(overseas, interstate)
    assert rows(merged.select("state_code", "age_grp", "nom", "imig", "net_mig_grp")) == [
        ("0", "0-4", 100.0, 0.0, 100.0),
        ("1", "5-9", 50.0, -20.0, 30.0),
    ]
    ages = spark.createDataFrame([(2010, "1", 5, 30.0), (2010, "1", 6, 70.0)], "yr int, state_code string, age int, erp_sya double")
    split = adjust.apportion_by_share(ages, merged)
    assert rows(split.select("age", "p", "net_mig_sya")) == [(5, 0.3, 9.0), (6, 0.7, 21.0)]
    panel = spark.createDataFrame([(2010, "NSW", 500.0), (2011, "NSW", 500.0)], "yr int, state string, first_yr_sch double")
    revised = adjust.revise_denominator(panel, split, {"1": "NSW"})
    assert rows(revised) == [(2010, "NSW", 500.0, None), (2011, "NSW", 500.0, 491.0)]


def test_ratio_spine(spark, rows):
    panel = spark.createDataFrame(
        [(1, "a", "p", 1.0), (1, "a", "q", 4.0), (2, "a", "q", 4.0), (2, "a", "r", 0.0)],
        "yr int, state string, series string, value double",
    )
    got = ratios.numerator_denominator_ratio(panel, ["p", "q"])
    assert rows(got.where("yr = 1").select("series", "numerator", "n", "percent", "ratio")) == [
        ("p", "p", 1.0, 100.0, "p / p"),
        ("p", "q", 4.0, 400.0, "q / p"),
        ("q", "p", 1.0, 25.0, "p / q"),
        ("q", "q", 4.0, 100.0, "q / q"),
    ]
    # Without the first numerator the period has none at all.
    assert rows(got.where("yr = 2").select("series", "numerator", "percent")) == [("q", None, None), ("r", None, None)]


def test_reshape_round_trip_and_checks(spark, rows):
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 4.0)], "id int, a double, b double")
    tall = reshape.pivot_longer(wide, ["id"], ["a", "b"], "name", "value")
    assert rows(reshape.pivot_wider(tall, ["id"], "name", "value", ["a", "b"])) == rows(wide)
    with pytest.raises(Exception, match="more than one value"):
        reshape.pivot_wider(tall.unionByName(tall), ["id"], "name", "value", ["a", "b"]).collect()
    with pytest.raises(Exception, match="differ in their keys"):
        other = spark.createDataFrame([(1, 5.0), (3, 6.0)], "id int, c double")
        reshape.zip_columns_checked(wide, other, ["id"]).collect()
    text = spark.createDataFrame([(1, "k", "x"), (1, "l", "y")], "id int, name string, value string")
    assert rows(reshape.pivot_wider(text, ["id"], "name", "value", ["k", "l"])) == [(1, "x", "y")]


def test_order_by_levels_puts_unknown_labels_last(spark):
    df = spark.createDataFrame([("z", 1), ("b", 2), ("a", 1), ("b", 1)], "s string, yr int")
    assert [tuple(r) for r in select.order_by_levels(df, "s", ["b", "a"], "yr").collect()] == [
        ("b", 1),
        ("b", 2),
        ("a", 1),
        ("z", 1),
    ]


def test_filters_against_tables(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    keys = spark.createDataFrame([("a",), (None,)], "x string")
    assert rows(select.filter_in(df, "x", keys)) == [("a",)]
    assert rows(select.filter_not_in(df, "x", keys)) == [("b",), (None,)]
    assert rows(select.filter_not_in(df, "x", ["a"])) == [("b",), (None,)]


def test_selection_view_drops_duplicates_and_gaps(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "s", "N.A.", 1.0), ("a", 1, "s", "N.A.", 1.0), ("a", 2, "s", "Med", None), ("a", 2, "s", "High", 3.0), ("b", 1, "t", "Med", 4.0)],
        "state string, yr int, series string, assumption string, value double",
    )
    got = select.selection_view(df, scenario="Med", period_range=(1, 2), columns={"state": "State", "value": "v"})
    assert rows(got) == [("a", 1.0), ("b", 4.0)]
    assert rows(select.selection_view(df, members=["a"], series=["s"], periods=[2])) == [("a", 2, "s", "High", 3.0)]


def test_clones(spark, rows):
    df = spark.createDataFrame([("N.A.", 1), ("Med", 2)], "s string, i int")
    assert rows(reshape.clone_member(df, "s", "N.A.", ["Zero", "Med"], keep_source=False)) == [
        ("Med", 1),
        ("Med", 2),
        ("Zero", 1),
    ]
    assert reshape.clone_member(df, "s", "N.A.", ["Zero"]).count() == 3
