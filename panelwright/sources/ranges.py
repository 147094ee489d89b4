"""Byte ranges of files as a partitioned data source.

Two sources of Spark's Python data source interface live here, one for lines of
text tables and one for observation feeds. Both work in the same steps:

* files are cut into byte ranges, one task each; a line or an observation
  belongs to the range in which its first byte lies, so whatever crosses the
  end of a range is read to its end by the task that began it;
* where a range's meaning depends on what stands before it (the number of its
  first line, the series that is open at its start), a first job summarises
  every range in one small row, and the rows are chained in the order of the
  file;
* tasks yield Arrow batches.

What the driver holds is one row for each range, as it holds one split for each
block of any other file source.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RANGE_BYTES = 32 << 20
#: Bytes read at a time behind the end of a range, to finish what began in it.
AHEAD_BYTES = 1 << 16

# The classes travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file of ``size`` bytes; ``note``: what a reader has to know besides."""

    path: str
    start: int
    end: int
    size: int
    note: tuple = ()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][\w+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def ranges_of(path: str, range_bytes: int) -> list[Range]:
    """All ranges of a file, or of the files of a folder but hidden ones, in order."""
    files, inner = _opened(path)
    info = files.get_file_info(inner)
    found = [info]
    if info.type == fs.FileType.Directory:
        found = [f for f in files.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name[:1] not in "._"]
    elif info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = re.match(r"[A-Za-z][\w+.-]+:", path)
    prefix = f"{scheme[0]}//" if scheme and not path.startswith("file:") else ""
    out = []
    for f in sorted(found, key=lambda f: f.path):
        out += [Range(prefix + f.path, a, min(a + range_bytes, f.size), f.size) for a in range(0, f.size, range_bytes)]
    return out


def read_bytes(path: str, start: int, end: int) -> bytes:
    files, inner = _opened(path)
    with files.open_input_file(inner) as f:
        return f.read_at(max(0, min(end, f.size()) - start), start)


# ---- lines


def _line_starts(part: Range) -> int:
    """How many lines begin in the range."""
    before = max(part.start - 1, 0)
    return read_bytes(part.path, before, part.end - 1).count(b"\n") + (part.start == 0)


def _lines(part: Range, skip: int, take: int | None) -> bytes:
    """Lines that begin in the range, without the first ``skip``, ``take`` of them at most."""
    before = max(part.start - 1, 0)
    raw, end = read_bytes(part.path, before, part.end), part.end
    while end < part.size and not raw.endswith(b"\n"):
        more = read_bytes(part.path, end, end + AHEAD_BYTES)
        stop = more.find(b"\n")
        raw += more if stop < 0 else more[: stop + 1]
        end = end + len(more) if stop < 0 else part.size
    at = 0 if part.start == 0 else raw.find(b"\n") + 1
    if part.start and not at:
        return b""  # no line begins here
    for _ in range(skip):
        at = raw.find(b"\n", at) + 1
        if not at:
            return b""
    if take is None:
        return raw[at:]
    stop = at
    for _ in range(take):
        stop = raw.find(b"\n", stop) + 1
        if not stop:
            return raw[at:]
    return raw[at:stop]


class _LineReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.mode = options["path"], options["mode"]
        self.range_bytes = int(options["rangebytes"])
        self.plan = json.loads(options.get("plan", "{}"))
        self.schema = schema

    def partitions(self) -> list[Range]:
        parts, low, high = [], *self.plan.get("window", (0, None))
        rank: dict[str, int] = {}
        for r in ranges_of(self.path, self.range_bytes):
            k = rank[r.path] = rank.get(r.path, -1) + 1
            if self.mode == "count":
                if low <= k and (high is None or k < high):
                    parts.append(r)
                continue
            spot = self.plan["files"].get(r.path)
            if spot is None:
                continue
            first, skip, last, take = spot
            if first <= k and (last is None or k <= last):
                parts.append(Range(r.path, r.start, r.end, r.size, (skip if k == first else 0, k == last and take, k == first and k == last and skip)))
        # Without a partition Spark would read all.
        return parts or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        if self.mode == "count":
            yield pa.RecordBatch.from_pydict({"path": [part.path], "start": [part.start], "n": [_line_starts(part)]})
            return
        skip, take, cut = part.note
        raw = _lines(part, skip, None if take is False else take - (cut or 0))
        if not raw:
            return
        if self.mode == "text":
            yield pa.RecordBatch.from_pydict({"path": [part.path], "line": [raw.decode().rstrip("\r\n")]})
            return
        kinds = to_arrow_schema(self.schema)
        names = [f"c{k}" for k in range(self.plan["width"])]
        chosen = names[self.plan["left"] : self.plan["left"] + len(kinds)]
        options = pyarrow.csv.ConvertOptions(
            column_types={c: f.type for c, f in zip(chosen, kinds)}, include_columns=chosen, null_values=["", self.plan["missing"]], strings_can_be_null=True
        )
        read = pyarrow.csv.ReadOptions(column_names=names, block_size=max(1 << 20, min(len(raw) + 1, 1 << 30)))
        parse = pyarrow.csv.ParseOptions(delimiter=self.plan["separator"], ignore_empty_lines=False)
        found = pyarrow.csv.read_csv(io.BytesIO(raw), read_options=read, parse_options=parse, convert_options=options)
        yield from found.rename_columns(kinds.names).cast(kinds).to_batches(max_chunksize=10_000)


class LineSource(DataSource):
    """``panel_lines``: counts of lines by range, single lines, or parsed lines of a range of lines."""

    @classmethod
    def name(cls) -> str:
        return "panel_lines"

    def schema(self) -> str:
        return {"count": "path string, start long, n long", "text": "path string, line string"}[self.options["mode"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(self.options, schema)


def _load(spark: SparkSession, path: str, mode: str, range_bytes: int, plan: dict, schema: StructType | None = None):
    spark.dataSource.register(LineSource)
    reader = spark.read.format("panel_lines").option("path", path).option("mode", mode).option("rangebytes", str(range_bytes)).option("plan", json.dumps(plan))
    return (reader.schema(schema) if schema is not None else reader).load()


def line_counts(spark: SparkSession, path: str, upto: int, range_bytes: int, first_wave: int = 64) -> tuple[dict[str, list[int]], set[str]]:
    """Lines that begin in each range of every file, until ``upto`` lines of it are counted; and files counted to their end.

    Ranges are counted in waves of growing width, each a job, so a range of
    lines near the top of a long file does not cost a pass over the file.
    """
    counts: dict[str, list[int]] = {}
    low, wave = 0, first_wave
    while True:
        rows = _load(spark, path, "count", range_bytes, {"window": (low, low + wave)}).collect()
        ended = set(counts)
        for r in sorted(rows, key=lambda r: (r.path, r.start)):
            counts.setdefault(r.path, []).append(r.n)
            ended.discard(r.path)
        ended |= {p for p, n in counts.items() if len(n) < low + wave}
        if all(p in ended or sum(n) >= upto for p, n in counts.items()):
            return counts, ended
        low, wave = low + wave, 2 * wave


def _spot(counts: list[int], line: int) -> tuple[int, int] | None:
    """(range, lines before it there) of a line counted from 1."""
    before = 0
    for k, n in enumerate(counts):
        if line <= before + n:
            return k, line - before - 1
        before += n
    return None


def column_number(letters: str) -> int:
    """A -> 0, Z -> 25, AA -> 26."""
    number = 0
    for c in letters.upper():
        number = number * 26 + ord(c) - 64
    return number - 1


def parse_cells(cells: str) -> tuple[int, int, int, int | None]:
    """``A5:M72866`` -> first and last column from 0, first and last line from 1; ``A5:M`` goes on to the last line (None)."""
    found = re.fullmatch(r"([A-Za-z]+)(\d+):([A-Za-z]+)(\d*)", cells)
    if not found:
        raise ValueError(f"not a range of cells: {cells!r}")
    left, top, right = column_number(found[1]), int(found[2]), column_number(found[3])
    bottom = int(found[4]) if found[4] else None
    if left > right or top < 1 or (bottom is not None and bottom < top):
        raise ValueError(f"an empty range of cells: {cells!r}")
    return left, right, top, bottom


def read_lines(spark: SparkSession, path: str, schema: StructType, top: int, bottom: int | None, left: int, separator: str,
               missing: str, range_bytes: int):
    """Lines ``top`` + 1 to ``bottom`` (None: the last) under the header in line ``top``, with the columns of ``schema`` from column ``left`` on."""
    counts, _ = line_counts(spark, path, bottom or top + 1, range_bytes)
    heads, files = {}, {}
    for name, n in counts.items():
        at = _spot(n, top)
        if at is None:
            raise ValueError(f"{name} has no line {top}")
        heads[name] = [*at, at[0], at[1] + 1]
        start = _spot(n, top + 1)
        if start is None or bottom == top:
            continue  # nothing below the header
        end = _spot(n, bottom) if bottom else None
        files[name] = [*start, *((end[0], end[1] + 1) if end else (None, None))]
    width = left + len(schema)
    for r in _load(spark, path, "text", range_bytes, {"files": heads}).collect():
        header = next(csv.reader([r.line], delimiter=separator), [])
        if header[left : left + len(schema)] != schema.names:
            raise ValueError(f"line {top} of {r.path} reads {header}, not {schema.names} from column {left + 1} on")
        width = len(header)
    plan = {"files": files, "width": width, "left": left, "separator": separator, "missing": missing}
    return _load(spark, path, "rows", range_bytes, plan, schema)


# ---- observation feeds

_NAME = rb"(?:[\w.-]+:)?"
_ATTRIBUTES = rb"((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>"
_OBS = re.compile(rb"<" + _NAME + rb"Obs(?=[\s/>])")
_OBS_TAG = re.compile(rb"<" + _NAME + rb"Obs" + _ATTRIBUTES)
_OBS_END = re.compile(rb"</" + _NAME + rb"Obs\s*>")
_SERIES = re.compile(rb"<(/?)" + _NAME + rb"Series(?=[\s/>])")
_SERIES_TAG = re.compile(rb"<" + _NAME + rb"Series" + _ATTRIBUTES)
_EVENT = re.compile(rb"<(/?)" + _NAME + rb"(Series|Obs)(?=[\s/>])")
_KEY = re.compile(rb"<" + _NAME + rb"(?:SeriesKey|ObsKey)\s*>(.*?)</" + _NAME + rb"(?:SeriesKey|ObsKey)\s*>", re.S)
_KEY_VALUE = re.compile(rb"<" + _NAME + rb"Value" + _ATTRIBUTES)
_ATTRIBUTE = re.compile(rb"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_TIME = re.compile(rb"<" + _NAME + rb"Time\s*>\s*([^<]*?)\s*</")
_AT = re.compile(rb"<" + _NAME + rb"ObsDimension" + _ATTRIBUTES)
_VALUE = re.compile(rb"<" + _NAME + rb"ObsValue" + _ATTRIBUTES)
_COMMENT = re.compile(rb"<!--.*?-->", re.S)

TIME, VALUE = "TIME_PERIOD", "OBS_VALUE"


def _attributes(raw: bytes) -> dict[str, str]:
    return {m[1].decode(): html.unescape((m[2] if m[2] is not None else m[3]).decode()) for m in _ATTRIBUTE.finditer(raw)}


def _key(body: bytes) -> dict[str, str]:
    """Dimension -> value of a SeriesKey or ObsKey in ``body``."""
    found = _KEY.search(body)
    pairs = [_attributes(m[1]) for m in _KEY_VALUE.finditer(found[1])] if found else []
    return {p.get("id", p.get("concept", "")): p.get("value", "") for p in pairs}


class _Window:
    """Bytes of a range that grow at their end; comments are blanked."""

    def __init__(self, part: Range) -> None:
        self.part, self.end = part, part.start
        self.raw = b""
        self.more(part.end - part.start + AHEAD_BYTES)

    def more(self, count: int = AHEAD_BYTES) -> bool:
        if self.end >= self.part.size:
            return False
        got = read_bytes(self.part.path, self.end, self.end + count)
        self.end += len(got)
        self.raw += got
        if b"<!--" in self.raw:
            self.raw = _COMMENT.sub(lambda m: b" " * len(m[0]), self.raw)
        return True

    def find(self, pattern: re.Pattern, at: int) -> re.Match:
        """The match at or after ``at``, reading on where it takes more bytes."""
        while (found := pattern.search(self.raw, at)) is None:
            if not self.more(max(AHEAD_BYTES, len(self.raw))):
                raise ValueError(f"{self.part.path}: what begins at byte {self.part.start + at} does not end")
        return found


def layout(path: str) -> str:
    """``full`` (observations with their whole key), ``series`` (a key for many observations) or ``compact`` (attributes), by the first element."""
    for part in ranges_of(path, 1 << 40):
        window = _Window(Range(part.path, 0, 0, part.size))
        while (first := _EVENT.search(window.raw)) is None and window.more():
            pass
        if first is None:
            continue
        if first[2] == b"Series":
            return "series"
        return "compact" if window.find(_OBS_TAG, first.start())[1].strip() else "full"
    return "full"


def _last_series(part: Range) -> tuple[int, bool]:
    """Byte of the last series tag that begins in the range, and whether it opens a series; (-1, ..) without one."""
    window, last = _Window(part), None
    for found in _SERIES.finditer(window.raw):
        if found.start() < part.end - part.start:
            last = found
    if last is None:
        return -1, False
    if last[1]:
        return part.start + last.start(), False
    return part.start + last.start(), not window.find(_SERIES_TAG, last.start())[2]


def _series_key(path: str, at: int, size: int) -> dict[str, str]:
    """Key of the series whose tag begins at a byte."""
    window = _Window(Range(path, at, at, size))
    tag = window.find(_SERIES_TAG, 0)
    key = _attributes(tag[1])
    first = window.find(re.compile(_OBS.pattern + rb"|" + _SERIES.pattern), tag.end())
    return key | _key(window.raw[tag.end() : first.start()])


def observations(part: Range, open_at: int) -> Iterator[dict[str, str]]:
    """The observations that begin in a range; ``open_at``: byte of the series open at its start, or -1."""
    window, at, key = _Window(part), 0, {}
    if open_at >= 0:
        key = _series_key(part.path, open_at, part.size)
    limit = part.end - part.start
    while True:
        event = _EVENT.search(window.raw, at)
        if event is None or event.start() >= limit:
            return
        at = event.end()
        if event[2] == b"Series":
            key = {} if event[1] else _series_key(part.path, part.start + event.start(), part.size)
            continue
        if event[1]:
            continue
        tag = window.find(_OBS_TAG, event.start())
        row, at = key | _attributes(tag[1]), tag.end()
        if not tag[2]:
            end = window.find(_OBS_END, at)
            body, at = window.raw[at : end.start()], end.end()
            row |= _key(body)
            if found := _TIME.search(body):
                row[TIME] = html.unescape(found[1].decode())
            if found := _AT.search(body):
                row[TIME] = _attributes(found[1]).get("value", "")
            if found := _VALUE.search(body):
                row[VALUE] = _attributes(found[1]).get("value", "")
        yield row


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.range_bytes, self.mode = options["path"], int(options["rangebytes"]), options["mode"]
        self.names = json.loads(options.get("dimensions", "{}"))
        self.open_at = json.loads(options.get("openat", "{}"))

    def partitions(self) -> list[Range]:
        parts = ranges_of(self.path, self.range_bytes)
        noted = [Range(r.path, r.start, r.end, r.size, (self.open_at.get(r.path, {}).get(str(r.start), -1),)) for r in parts]
        return noted or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        if self.mode == "series":
            at, opened = _last_series(part)
            yield pa.RecordBatch.from_pydict({"path": [part.path], "start": [part.start], "at": [at], "opened": [opened]})
            return
        ids = [*self.names, VALUE]
        shape = pa.schema([(self.names.get(i, "obs_value"), pa.string()) for i in ids])
        held: list[list[str | None]] = []
        for row in observations(part, part.note[0]):
            held.append([row.get(i) for i in ids])
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=shape)


class FeedSource(DataSource):
    """``panel_observations``: observations of a feed in any layout, or the last series tag of each range."""

    @classmethod
    def name(cls) -> str:
        return "panel_observations"

    def schema(self) -> str:
        if self.options["mode"] == "series":
            return "path string, start long, at long, opened boolean"
        return ", ".join(f"`{c}` string" for c in [*json.loads(self.options["dimensions"]).values(), "obs_value"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeedReader(self.options, schema)


def open_series(spark: SparkSession, path: str, range_bytes: int) -> dict[str, dict[str, int]]:
    """Of every range that begins inside a series: file -> start -> byte of the series' tag."""
    rows = spark.read.format("panel_observations").option("path", path).option("mode", "series").option("rangebytes", str(range_bytes)).load().collect()
    found: dict[str, dict[str, int]] = {}
    path_now, now = None, -1
    for r in sorted(rows, key=lambda r: (r.path, r.start)):
        if r.path != path_now:
            path_now, now = r.path, -1
        if now >= 0:
            found.setdefault(r.path, {})[str(r.start)] = now
        if r.at >= 0:
            now = r.at if r.opened else -1
    return found


def read_feed(spark: SparkSession, path: str, dimensions: dict[str, str], range_bytes: int = RANGE_BYTES):
    """Observations of a feed, whatever its layout: (a column for each dimension id -> name, obs_value), all text.

    The period has the id TIME_PERIOD in every layout. A dimension that an
    observation does not name is null. Comments that cross the start of a range
    are not seen as such.
    """
    spark.dataSource.register(FeedSource)
    # A one-row job, so that the file is looked at by a task and not by the driver.
    kind = spark.range(0, 1, 1, 1).mapInArrow(_layout_task(path), "layout string").first().layout
    reader = spark.read.format("panel_observations").option("path", path).option("mode", "rows").option("rangebytes", str(range_bytes))
    if kind == "series":
        reader = reader.option("openat", json.dumps(open_series(spark, path, range_bytes)))
    return reader.option("dimensions", json.dumps(dimensions)).load()


def _layout_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"layout": [layout(path)]})

    return task
