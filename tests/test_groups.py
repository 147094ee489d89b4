"""Operators that must not put a group into one task: the split paths against the plain ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import aggregates, groups, joins, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, among them exact copies; one group key is null."""
    rnd = random.Random(7)
    rows = [("hot", i // 3, float(i % 5)) for i in range(900)]
    rows += [(g, i, rnd.random() * 100) for g in ("a", "b", "c", "d") for i in range(20)]
    rows += [(None, i, float(i)) for i in range(10)]
    return spark.createDataFrame(rows, "g string, i int, x double").repartition(8)


def totals(df):
    return df.groupBy("g").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


def test_attach_groups_serves_every_row_once(spark, skewed, rows):
    got = groups.attach_groups(skewed, totals(skewed).drop("n"), ["g"])
    want = skewed.withColumn("total", F.sum("x").over(Window.partitionBy("g")))
    assert rows(got.withColumn("total", F.round("total", 6))) == rows(want.withColumn("total", F.round("total", 6)))


def test_attach_groups_left_and_inner(spark, skewed):
    part = totals(skewed).where("g in ('hot', 'a')")
    left = groups.attach_groups(skewed, part, ["g"])
    assert left.count() == skewed.count()
    assert left.where("total is null").count() == 70
    assert groups.attach_groups(skewed, part, ["g"], how="inner").count() == 920


@pytest.fixture
def eager_skew_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("partner", [True, False])
def test_a_hot_group_is_split_with_and_without_partner(spark, eager_skew_join, partner):
    ids = spark.range(0, 300_000, 1, 16)
    left = ids.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("g"), F.col("id").alias("v"))
    table = ids.select(F.col("id").alias("g"), (F.col("id") * 2).alias("w")).where(F.lit(partner) | (F.col("id") != 7))
    out = groups.attach_groups(left, table, ["g"]).agg(F.sum("w"), F.count(F.lit(1)), F.sum("v"))
    row = out.collect()[0]
    assert row[1] == 300_000
    assert row[0] == sum(2 * i for i in range(300_000) if i % 3) + (100_000 * 14 if partner else 0) - (0 if partner else 14)
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_describing_a_share_starts_no_job(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("describe", "describe only")
    aggregates.max_with_ties(aggregates.share_of_group(skewed, ["g"], "x"), ["g"], "x").explain("simple")
    assert tracker.getJobIdsForGroup("describe") == []
    spark.sparkContext.setJobGroup("tests", "tests")


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    numbered = groups.number_rows(df, ["v"])
    assert numbered.where("row_no = v + 1").count() == 1000


@pytest.mark.parametrize("partitions", [None, 3])
def test_numbers_in_groups(spark, rows, partitions):
    rnd = random.Random(1)
    data = [(rnd.choice("aab"), i, rnd.random()) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, x double").repartition(5)
    got = groups.number_rows_in_groups(df, ["g"], ["x", "i"], "no", "size", partitions=partitions)
    w = Window.partitionBy("g")
    want = df.withColumns({"no": F.row_number().over(w.orderBy("x", "i")), "size": F.count(F.lit(1)).over(w)})
    assert rows(got) == rows(want)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(groups, "SAMPLED", 2)


@pytest.mark.parametrize("order", [["x", "i"], ["s", "i"], ["d", "i"], ["b", "x", "i"]])
def test_numbers_in_many_cells_with_nulls_ties_and_hot_groups(spark, rows, small_cells, order):
    rnd = random.Random(3)
    data = [
        (rnd.choice(["hot", "hot", "a", None]), i, rnd.choice([None, float("nan"), -0.5, 0.1, 1e300, rnd.random()]), rnd.choice([None, "", "it's", "a\\b", "é", "z\n"]), rnd.random() < 0.5)
        for i in range(500)
    ]
    df = spark.createDataFrame(data, "g string, i int, x double, s string, b boolean").withColumn("d", F.expr("timestamp '2020-01-01 00:00:00.123456' + make_interval(0, 0, 0, i % 7)")).repartition(5)
    cut = groups.with_cells(df, ["g", *order], 40)
    assert cut.select("_cell").distinct().count() > 20
    w = Window.partitionBy("g")
    want = df.withColumns({"no": F.row_number().over(w.orderBy(*order)), "size": F.count("x").over(w)}).drop("d", "x")
    got = groups.number_rows_in_groups(df, ["g"], order, "no", "size", F.col("x"), partitions=40).drop("d", "x")
    assert rows(got) == rows(want)
    numbered = groups.number_rows(df, ["g", *order], partitions=40).drop("d", "x")
    whole = df.withColumn("row_no", F.row_number().over(Window.orderBy("g", *order))).drop("d", "x")
    assert rows(numbered) == rows(whole)


def test_ordered_operators_write_nothing(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 1.0).alias("x"))
    before = set(groups.__dict__)
    assert "checkpointed" not in before
    plan = windows.centred_moving_mean(df, ["g"], ["id"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "InMemory" not in plan


def test_columns_of_any_name_pass_through(spark, rows, small_cells):
    names = ["_cell", "_no", "_first", "_last", "__cut", "_o0", "_size"]
    data = [("a", i, float(i), *range(len(names))) for i in range(40)]
    df = spark.createDataFrame(data, ["g", "i", "x", *names]).repartition(4)
    w = Window.partitionBy("g").orderBy("i")
    assert rows(windows.right_moving_mean(df, ["g"], ["i"], "x", 2)) == rows(df.withColumn("adj", F.when(F.col("i") > 0, F.avg("x").over(w.rowsBetween(-1, 0)))))
    assert rows(groups.number_rows_in_groups(df, ["g"], ["i"], "no", "n")) == rows(df.withColumns({"no": F.row_number().over(w), "n": F.lit(40)}))


def test_empty_table_has_no_numbers(spark):
    none = spark.createDataFrame([], "g string, i int, x double")
    assert groups.number_rows_in_groups(none, ["g"], ["x", "i"]).collect() == []
    assert windows.centred_moving_mean(none, ["g"], ["i"], "x").collect() == []


@pytest.mark.parametrize("align", ["center", "right"])
@pytest.mark.parametrize("k", [3, 5])
def test_moving_mean_in_cells_equals_one_window(spark, rows, small_cells, align, k):
    data = [(g, i, None if i % 13 == 5 else float(i * i % 17)) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(data, "g string, i int, x double").repartition(6)
    low, high = (-(k // 2), k // 2) if align == "center" else (1 - k, 0)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(low, high)
    plain = df.withColumn("adj", F.when(F.count("x").over(w) == k, F.avg("x").over(w)))
    assert rows(windows.moving_mean(df, ["g"], ["i"], "x", k, align, cells=7)) == rows(plain)
    assert rows(windows.moving_mean(df, ["g"], ["i"], "x", k, align)) == rows(plain)


def test_moving_mean_edges_and_gaps(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 6.0, None, 3.0, 3.0, 3.0])], "g string, i int, x double")
    centred = [r.adj for r in windows.centred_moving_mean(df, ["g"], ["i"], "x").orderBy("i").collect()]
    assert centred == [None, 3.0, None, None, None, 3.0, None]
    right = [r.adj for r in windows.right_moving_mean(df, ["g"], ["i"], "x").orderBy("i").collect()]
    assert right == [None, None, 3.0, None, None, None, 3.0]


def test_normal_scores_small_and_missing(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, 1.0, None, 2.0])], "g string, i int, x double")
    got = {r.i: r.theoretical for r in windows.normal_scores(df, ["g"], "x", ["i"]).collect()}
    # n = 3: (i - 3/8) / (3 + 1/4)
    assert got[2] is None
    assert got[3] == pytest.approx(0.0, abs=1e-12)
    assert got[1] == pytest.approx(-0.8694238, abs=1e-6)
    assert got[0] == pytest.approx(0.8694238, abs=1e-6)


def test_normal_scores_of_the_whole_frame(spark):
    df = spark.createDataFrame([("ab"[i % 2], i, float(-i)) for i in range(50)], "g string, i int, x double")
    got = windows.normal_scores(df, [], "x", ["i"]).orderBy("x").collect()
    scores = [r.theoretical for r in got]
    assert scores == sorted(scores) and scores[0] == pytest.approx(-scores[-1])


def test_shares_sum_to_one(spark, skewed):
    shared = aggregates.share_of_group(skewed, ["g"], "x", digits=12)
    for r in shared.groupBy("g").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1.0, abs=1e-6)


def test_ties_survive_and_missing_drops_the_group(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("b", 1, 1.0), ("b", 2, None)], "g string, i int, x double"
    )
    assert rows(aggregates.max_with_ties(df, ["g"], "x")) == [("a", 1, 5.0), ("a", 2, 5.0)]


def test_totals(spark, rows):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", None)], "y int, m string, x double")
    want = [(1, "T", 3.0), (1, "a", 1.0), (1, "b", 2.0), (2, "T", None), (2, "a", 3.0), (2, "b", None)]
    assert rows(aggregates.sum_with_total(df, ["y"], "m", {"x": "x"}, "T")) == want
    assert rows(aggregates.append_total_member(df, ["y"], "m", ["x"], "T")) == want


def test_growth_uses_the_end_of_the_period(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 110.0), ("a", 1, -5.0, 95.0)], "state string, yr int, chg double, erp double")
    row = aggregates.aggregate_growth(df, ["state", "yr"], "chg", "erp").first()
    assert (row.chg, row.chg_p) == (5.0, 2.4)


def test_correlation_edge_cases(spark):
    df = spark.createDataFrame(
        [("line", float(i), 2.0 * i) for i in range(5)]
        + [("flat", float(i), 1.0) for i in range(5)]
        + [("pair", 1.0, 1.0), ("pair", 2.0, 5.0), ("pair", 3.0, None)],
        "g string, x double, y double",
    )
    got = {r.g: (r.n, r.r, r.p_value, r.stars) for r in aggregates.corr_test(df, ["g"], "x", "y").collect()}
    assert got["line"] == (5, 1.0, 0.0, "***")
    assert got["flat"] == (5, None, None, "")
    assert got["pair"] == (2, 1.0, None, "")


def test_joins_match_null_keys_and_fill_right_keys(spark, rows):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), (None, 4)], "k string, b int")
    assert rows(joins.left_join(a, b, ["k"])) == [("x", 1, None), (None, 2, 4)]
    assert rows(joins.right_join(a, b, ["k"])) == [("y", None, 3), (None, 2, 4)]
    assert rows(joins.full_join(a, b, ["k"])) == [("x", 1, None), ("y", None, 3), (None, 2, 4)]
    with pytest.raises(ValueError):
        joins.left_join(a, a, ["k"])


def test_series_replacement(spark, rows):
    panel = spark.createDataFrame([(1, "s", 10.0), (1, "t", 7.0), (2, "s", 5.0)], "yr int, series string, value double")
    away = spark.createDataFrame([(1, 4.0)], "yr int, amount double")
    got = joins.subtract_from_series(panel, "series", "s", "value", away, ["yr"], "amount")
    assert rows(got) == [(1, "s", 6.0), (1, "t", 7.0), (2, "s", 5.0)]


def test_hot_keys_of_a_fact_join_are_split_at_run_time(spark):
    """A third of the left rows share one key; the adaptive skew join cuts that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 300_000, 1, 16)
        left = ids.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        right = ids.select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        out = joins.left_join(left, right, ["k"]).agg(F.sum("w"), F.sum("v"), F.count(F.lit(1)))
        row = out.collect()[0]
        assert row[2] == 300_000
        assert row[0] == sum(2 * (7 if i % 3 == 0 else i) for i in range(300_000))
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
