from panelwright.session import fresh_path, shared_folder
from panelwright.sources import observations, tables

DIMS = {"AGE": "age", "SEX": "sex", "REGION": "region", "TIME_PERIOD": "time_period"}

FLAT = """<?xml version="1.0"?>
<m:DataSet xmlns:m="urn:m" xmlns:g="urn:g">
  <g:Obs><g:ObsKey><g:Value id="AGE" value="4"/><g:Value id="SEX" value="3"/><g:Value id="REGION" value="AUS"/>
    <g:Value id="TIME_PERIOD" value="2013-Q2"/></g:ObsKey><g:ObsValue value="310"/></g:Obs>
  <g:Obs><g:ObsKey><g:Value id="SEX" value="3"/><g:Value id="AGE" value="5"/></g:ObsKey><g:ObsValue value="12.5"/></g:Obs>
</m:DataSet>"""

SERIES = """<DataSet>
  <Series><SeriesKey><Value concept="AGE" value="A04"/><Value concept="REGION" value="1"/></SeriesKey>
    <Obs><Time>2012</Time><ObsValue value="7"/></Obs><Obs><Time>2013</Time><ObsValue value="-8"/></Obs></Series>
  <Series><SeriesKey><Value concept="AGE" value="A59"/><Value concept="REGION" value="2"/></SeriesKey>
    <Obs><Time>2012</Time><ObsValue value="9"/></Obs></Series>
</DataSet>"""

COMPACT = """<DataSet><Obs AGE="4" SEX="3" REGION="1" TIME_PERIOD="2013-Q2" OBS_VALUE="99"/></DataSet>"""


def test_flat_observations(spark, tmp_path, rows):
    (tmp_path / "flat.xml").write_text(FLAT)
    got = observations.read_flat_observations(spark, str(tmp_path / "flat.xml"), DIMS)
    assert rows(got) == [("4", "3", "AUS", "2013-Q2", "310"), ("5", "3", None, None, "12.5")]


def test_series_observations(spark, tmp_path, rows):
    (tmp_path / "series.xml").write_text(SERIES)
    got = observations.read_series_observations(spark, str(tmp_path / "series.xml"), {"AGE": "age", "REGION": "region"})
    assert got.columns == ["age", "region", "time", "obs_value"]
    assert rows(got) == [("A04", "1", "2012", "7"), ("A04", "1", "2013", "-8"), ("A59", "2", "2012", "9")]


def test_compact_observations(spark, tmp_path, rows):
    (tmp_path / "compact.xml").write_text(COMPACT)
    got = observations.read_compact_observations(spark, str(tmp_path / "compact.xml"), DIMS)
    assert rows(got) == [("4", "3", "1", "2013-Q2", "99")]


def test_text_tables_read_na_as_missing(spark, rows):
    df = spark.createDataFrame([(1, "NA", 1.5), (2, "x", None)], "i int, s string, v double")
    path = fresh_path(spark, "text")
    tables.write_text_table(df, path)
    got = tables.read_panel_table(spark, path, "i int, s string, v double", {"v": "value"})
    assert got.columns == ["i", "s", "value"]
    # The label "NA" comes back as missing, which is why the panels relabel it.
    assert rows(got) == [(1, None, 1.5), (2, "x", None)]


def test_named_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "p"), (2, "q")], "i int, series string")
    tables.write_panel_tables({"a": a, "b": a}, str(tmp_path), {"b": ["series"]})
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    plan = spark.read.parquet(str(tmp_path / "b")).where("series = 'p'")
    assert "PartitionFilters: [isnotnull(series" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
