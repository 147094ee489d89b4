"""Bounded ranges of text tables and feeds in any layout, with splits at every place."""

import pytest
from pyspark.sql.types import StructType
from test_sources import COMPACT, DIMS, FLAT, SERIES

from panelwright.sources import observations, ranges, tables

SHEET = "Title,,\n\nSource: é\nTable 2,,\nyr,state,v\n2001,NSW,1.5\n2002,NA,\n2003,\"a, b\",3\n2004,Vic,-4\n"


def read(spark, path, cells, size=ranges.RANGE_BYTES, schema="yr int, state string, v double"):
    return [tuple(r) for r in tables.read_panel_range(spark, str(path), schema, cells, range_bytes=size).collect()]


ALL = [(2001, "NSW", 1.5), (2002, None, None), (2003, "a, b", 3.0), (2004, "Vic", -4.0)]


@pytest.mark.parametrize("size", [1, 7, 16, 50, 1 << 20])
def test_range_under_notes_wherever_the_file_is_split(spark, tmp_path, size):
    (tmp_path / "sheet.csv").write_text(SHEET)
    assert sorted(read(spark, tmp_path / "sheet.csv", "A5:C", size)) == ALL
    assert sorted(read(spark, tmp_path / "sheet.csv", "A5:C8", size)) == ALL[:3]


def test_lines_are_split_at_every_byte():
    """Every line is counted and read by one range, whatever the size of the ranges."""
    import tempfile
    from pathlib import Path

    texts = ["", "\n", "a", "a\n", "a\nbb\n\nccc", "\n\n\nx\n", "one long line without end"]
    for text in texts:
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / "t"
            path.write_text(text)
            for size in range(1, len(text) + 2):
                parts = ranges.ranges_of(str(path), size)
                assert sum(map(ranges._line_starts, parts)) == len(text.splitlines())
                assert b"".join(ranges._lines(p, 0, None) for p in parts).decode() == text
                for p in parts:
                    own = ranges._lines(p, 0, None).split(b"\n")
                    n = ranges._line_starts(p)
                    assert ranges._lines(p, 1, 1) == (own[1] + b"\n" * (len(own) > 2) if n > 1 else b"")


def test_columns_inside_the_range_and_types(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(SHEET)
    assert sorted(read(spark, tmp_path / "sheet.csv", "B5:B7", 10, "state string"), key=str) == [("NSW",), (None,)]
    with pytest.raises(Exception, match="not \\['yr', 'state'\\]"):
        read(spark, tmp_path / "sheet.csv", "B5:C9", schema="yr int, state string")
    with pytest.raises(ValueError, match="has no line 50"):
        read(spark, tmp_path / "sheet.csv", "A50:C")
    with pytest.raises(ValueError, match="fewer columns"):
        read(spark, tmp_path / "sheet.csv", "A5:B")
    with pytest.raises(Exception, match="invalid value 'NSW'|conversion error"):
        read(spark, tmp_path / "sheet.csv", "A5:C", schema="yr int, state int, v double")


def test_only_the_ranges_of_the_wanted_lines_are_read(spark, tmp_path):
    lines = ["note"] * 4 + ["k,v"] + [f"{k},{k * k}" for k in range(20_000)]
    (tmp_path / "long.csv").write_text("\n".join(lines))
    counts, ended = ranges.line_counts(spark, str(tmp_path / "long.csv"), 100, 1000, first_wave=1)
    (n,) = counts.values()
    assert not ended and len(n) * 1000 < (tmp_path / "long.csv").stat().st_size / 10
    df = tables.read_panel_range(spark, str(tmp_path / "long.csv"), "k long, v long", "A5:B104", range_bytes=1000)
    assert df.rdd.getNumPartitions() == 1 and sorted(map(tuple, df.collect())) == [(k, k * k) for k in range(99)]
    everything = tables.read_panel_range(spark, str(tmp_path / "long.csv"), "k long, v long", "A5:B", range_bytes=1000)
    assert everything.count() == 20_000 and everything.agg({"v": "sum"}).first()[0] == sum(k * k for k in range(20_000))


def test_folder_of_sheets_each_with_its_header(spark, tmp_path):
    df = spark.createDataFrame([(k, f"s{k}") for k in range(40)] + [(None, None)], "k int, s string").repartition(5)
    tables.write_sheets(df, f"file:{tmp_path}/sheets", ["one", "", "three"])
    got = read(spark, f"file:{tmp_path}/sheets", "A4:B", 20, "k int, s string")
    assert sorted(got, key=str) == sorted([(k, f"s{k}") for k in range(40)] + [(None, None)], key=str)


def test_empty_tables(spark, tmp_path):
    (tmp_path / "head.csv").write_text("note\nyr,state,v")
    assert read(spark, tmp_path / "head.csv", "A2:C") == [] and read(spark, tmp_path / "head.csv", "A2:C2") == []
    with pytest.raises(Exception, match="missing.csv|FileNotFound"):
        read(spark, tmp_path / "missing.csv", "A1:C")


def test_cells():
    assert ranges.parse_cells("A5:M72866") == (0, 12, 5, 72866) and ranges.parse_cells("AA1:AZ") == (26, 51, 1, None)
    for wrong in ("A:B", "B2:A9", "A5:B4", "", "A0:B2"):
        with pytest.raises(ValueError):
            ranges.parse_cells(wrong)


MIXED = """<DataSet>
 <!-- <Obs AGE="x" OBS_VALUE="hidden"/> -->
 <g:Series AGE="4" note="a>b &amp; c"><g:Obs TIME_PERIOD="2001" OBS_VALUE="1"/><g:Obs TIME_PERIOD='2002' OBS_VALUE='2'></g:Obs></g:Series>
 <g:Series AGE="5"/>
 <g:Series><g:SeriesKey><g:Value id="AGE" value="6"/></g:SeriesKey>
   <g:Obs><g:ObsDimension value="2001"/><g:ObsValue value="3"/><g:Attributes><g:Value id="AGE" value="no"/></g:Attributes></g:Obs></g:Series>
</DataSet>"""


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        (FLAT, "full", [("4", "3", "AUS", "2013-Q2", "310"), ("5", "3", None, None, "12.5")]),
        (SERIES, "series", [("A04", None, "1", "2012", "7"), ("A04", None, "1", "2013", "-8"), ("A59", None, "2", "2012", "9")]),
        (COMPACT, "compact", [("4", "3", "1", "2013-Q2", "99")]),
        (MIXED, "series", [("4", None, None, "2001", "1"), ("4", None, None, "2002", "2"), ("6", None, None, "2001", "3")]),
        ("<DataSet/>", "full", []),
    ],
)
def test_layouts_are_told_apart_and_split_anywhere(spark, tmp_path, rows, text, kind, want):
    """Without Spark for every size of range, so that splits fall inside tags, keys and series; with it for one."""
    path = str(tmp_path / "feed.xml")
    (tmp_path / "feed.xml").write_text(text)
    assert ranges.layout(path) == kind
    ids = [*DIMS, "OBS_VALUE"]
    for size in range(1, len(text) + 1, 1 if text is not MIXED else 3):
        parts, open_at, got = ranges.ranges_of(path, size), -1, []
        # Comments that cross the start of a range are not seen.
        if text is MIXED and any(p.start and p.start < text.index("-->") and p.start > text.index("<!--") for p in parts):
            continue
        for p in parts:
            got += [tuple(o.get(i) for i in ids) for o in ranges.observations(p, open_at)]
            at, opened = ranges._last_series(p)
            open_at = open_at if at < 0 else at if opened else -1
        assert got == want, size
    assert rows(observations.read_observations(spark, path, DIMS, range_bytes=max(230, len(text) // 3))) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_written_layouts_read_alike(spark, tmp_path, rows):
    data = [(str(a), s, r, f"{y}-Q2", str(a * y)) for a in range(6) for s in "12" for r in ("1", "AUS") for y in range(2000, 2030)]
    obs = spark.createDataFrame(data, "age string, sex string, region string, time_period string, obs_value string").repartition(3)
    ids = {v: k for k, v in DIMS.items()}
    observations.write_flat_observations(obs, f"{tmp_path}/full", ids)
    observations.write_series_observations(obs, f"{tmp_path}/series", ids, "time_period")
    observations.write_compact_observations(obs, f"{tmp_path}/compact", ids)
    for kind in ("full", "series", "compact"):
        for size in (700, ranges.RANGE_BYTES):  # a series is longer than 700 bytes
            got = observations.read_observations(spark, f"file:{tmp_path}/{kind}", DIMS, range_bytes=size)
            assert rows(got) == sorted(data, key=lambda r: tuple((v is None, str(v)) for v in r)), (kind, size)


def test_schema_types_pass_through(spark, tmp_path):
    (tmp_path / "t.csv").write_text("d;b;n\n2020-06-30;true;9000000000\nNA;;\n")
    schema = StructType.fromDDL("d date, b boolean, n bigint")
    got = tables.read_panel_range(spark, str(tmp_path / "t.csv"), schema, "A1:C", separator=";")
    assert got.schema == schema and str(got.orderBy("n").collect()[1].d) == "2020-06-30"
