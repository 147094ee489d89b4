"""Published table sets, stored layouts and refreshed cubes."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelwright.operators import cohort, ratios, select
from panelwright.plans import basics
from panelwright.session import fresh_path
from panelwright.sources import store


def panel(spark, n=200):
    return spark.range(n).select(
        (F.col("id") % 5 + 2000).cast("int").alias("yr"), F.concat(F.lit("s"), F.col("id") % 7).alias("state"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("series"), (F.col("id") * 1.5).alias("value"),
    ).dropDuplicates(["yr", "state", "series"])


def test_sets_change_all_at_once(spark, tmp_path, rows):
    folder = f"file:{tmp_path}/set"
    a, b = panel(spark), panel(spark).select("state").distinct()
    assert store.publish_tables({"a": a, "b": b}, folder, {"a": store.Layout(("series",))}) == 1
    first = store.published_tables(spark, folder)
    assert rows(first["a"]) == rows(a) and first["a"].columns == a.columns
    assert store.manifest(spark, folder)["tables"]["a"]["rows"] == a.count()

    @F.udf("double")
    def failing(x):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        store.publish_tables({"b": b.limit(1), "a": a.withColumn("value", failing("value"))}, folder)
    assert store.versions(spark, folder) == [1]
    again = store.published_tables(spark, folder)
    assert rows(again["a"]) == rows(a) and rows(again["b"]) == rows(b)
    assert len(os.listdir(tmp_path / "set" / "a")) == len(os.listdir(tmp_path / "set" / "b")) == 1  # what was staged is gone

    assert store.publish_tables({"b": b.limit(0)}, folder) == 2
    assert rows(store.published_tables(spark, folder)["a"]) == rows(a) and store.published_tables(spark, folder)["b"].count() == 0
    assert rows(first["b"]) == rows(b)  # a reader of the old set goes on with it
    assert rows(store.published_tables(spark, folder, 1)["b"]) == rows(b)


def test_second_writer_of_a_version_is_refused(spark, tmp_path, monkeypatch, rows):
    folder, df = f"file:{tmp_path}/set", panel(spark)
    store.publish_tables({"a": df}, folder)
    known = store.versions(spark, folder)
    store.publish_tables({"a": df.limit(1)}, folder)
    monkeypatch.setattr(store, "versions", lambda *_: known)
    with pytest.raises(store.PublishConflict):
        store.publish_tables({"a": df.limit(2)}, folder)
    monkeypatch.undo()
    assert store.published_tables(spark, folder)["a"].count() == 1
    assert store.forget_versions(spark, folder) == [1]
    assert len(os.listdir(tmp_path / "set" / "a")) == 1 and store.published_tables(spark, folder)["a"].count() == 1
    assert not [n for n in os.listdir(tmp_path / "set" / "_versions") if "json-" in n and not n.endswith(".crc")]


def test_no_set_and_unknown_version(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.published_tables(spark, f"file:{tmp_path}/none")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark):
    """Without broadcasts of small tables, so that exchanges would show."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    folder = fresh_path(spark, "stored")
    store.publish_tables({"series": panel(spark)}, folder, {"series": basics.STORED})
    yield store.published_tables(spark, folder)["series"]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_panel_is_pruned_and_not_shuffled(spark, stored, rows):
    def view(df, ratio=ratios.stored_ratio):
        return select.selection_view(ratio(df, ["a", "c"]), members=["s1", "s2"], period_range=(2001, 2003), columns={"yr": "yr", "state": "state", "ratio": "ratio", "percent": "percent"})

    got = view(stored)
    text = plan(got)
    assert "Exchange" not in text
    assert re.search(r"PartitionFilters: \[[^]]*yr#\d+ >= 2001[^]]*yr#\d+ <= 2003", text) and "SelectedBucketsCount" in text
    assert "Exchange" in plan(view(panel(spark)))
    assert rows(got) == rows(view(panel(spark), ratios.numerator_denominator_ratio)) and got.count() > 10
    with pytest.raises(Exception, match="more than one value of a"):
        ratios.stored_ratio(panel(spark).union(panel(spark)), ["a"]).collect()
    scanned = stored.where("yr = 2002").select(F.input_file_name().alias("f")).distinct().collect()
    assert {Path(r.f).parent.name for r in scanned} == {"yr=2002"}


def test_periods_of_a_table_prune_folders_at_run_time(spark, rows):
    folder = fresh_path(spark, "stored")
    periods = spark.createDataFrame([(2001, "x"), (2003, "x"), (2004, "y")], "yr int, kind string")
    store.publish_tables({"series": panel(spark), "periods": periods}, folder, {"series": basics.STORED})
    found = store.published_tables(spark, folder)
    view = select.selection_view(found["series"], periods=found["periods"].where("kind = 'x'").select("yr"))
    text = plan(view)
    assert "dynamicpruningexpression" in text and "Exchange hashpartitioning" not in text
    assert rows(view) == rows(panel(spark).where("yr in (2001, 2003)"))


def observations(spark, years, value="10"):
    data = [(str(a), "3", r, f"{y}-Q2", str(int(value) * (a + 1) + y)) for a in range(11) for r in ("1", "AUS", "x") for y in years]
    data += [(str(a), "1", "1", f"{y}-Q2", "7") for a in range(3) for y in years] + [("1", "3", "1", f"{y}-Q3", "7") for y in years]
    return spark.createDataFrame(data, "age string, sex string, region string, time_period string, obs_value string")


def test_refreshed_cube_equals_a_full_rebuild_and_leaves_other_cohorts_alone(spark, tmp_path, rows):
    path = f"{tmp_path}/cube"
    store.store_cube(cohort.population_cube(observations(spark, range(2001, 2015)), first_cohort=2001), path)

    def files():
        return {str(p.relative_to(path)): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}

    before = files()
    new = observations(spark, [2014], "20").unionByName(observations(spark, [2015]))  # a revision and a new period
    touched = store.refresh_cube(spark, path, new)
    assert touched == list(range(2005, 2016))
    full = cohort.population_cube(observations(spark, range(2001, 2014)).unionByName(new), first_cohort=2001)
    assert rows(store.stored_cube(spark, path)) == rows(full)
    after = files()
    untouched = {f for f in before if int(f.split("/")[0].removeprefix("cohort=")) < 2005}
    assert untouched and all(after[f] == before[f] for f in untouched)
    assert not {f for f in before if f not in untouched} & set(after)
    assert store.refresh_cube(spark, path, new) == touched and rows(store.stored_cube(spark, path)) == rows(full)


def test_refresh_without_rows(spark, tmp_path, rows):
    path = f"{tmp_path}/cube"
    cube = cohort.population_cube(observations(spark, [2003]), first_cohort=2001)
    store.store_cube(cube, path)
    assert store.refresh_cube(spark, path, observations(spark, [])) == []
    assert rows(store.stored_cube(spark, path)) == rows(cube)
