"""Panel tables in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ranges

MISSING = "NA"
"""Text that stands for a missing value in table files."""


def read_panel_table(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    renames: dict[str, str] | None = None,
    drop: list[str] | None = None,
    format: str = "csv",
) -> DataFrame:
    """Read a table with a declared schema, drop index columns, repair names.

    For text files the word "NA" is read as missing, and the header must name
    the columns of the schema in order; another header stops the query.
    """
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.option("header", "true").option("nullValue", MISSING).option("mode", "FAILFAST").option("enforceSchema", "false")
    df = reader.format(format).load(path)
    return df.drop(*(drop or [])).withColumnsRenamed(renames or {})


def read_panel_range(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    cells: str = "A1:XFD",
    renames: dict[str, str] | None = None,
    drop: list[str] | None = None,
    separator: str = ",",
    range_bytes: int = ranges.RANGE_BYTES,
) -> DataFrame:
    """A range of cells of a text table: ``A5:M72866`` has its header in line 5, ``A5:M`` goes on to the end.

    The file may be split anywhere: lines are numbered from counts of the byte
    ranges before them, only the ranges that hold wanted lines are read, and
    only wanted columns are parsed. The header must name the columns of the
    schema in order; "NA" and empty cells are missing. A folder is read file by
    file, each with its own header. Fields hold no line breaks.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    left, right, top, bottom = ranges.parse_cells(cells)
    if right - left + 1 < len(schema):
        raise ValueError(f"{cells} has fewer columns than the schema")
    df = ranges.read_lines(spark, path, schema, top, bottom, left, separator, MISSING, range_bytes)
    return df.drop(*(drop or [])).withColumnsRenamed(renames or {})


def write_sheets(df: DataFrame, path: str, notes: list[str]) -> None:
    """Write text tables, a file for each partition that has rows: the notes, a header, the rows."""
    head = [*notes, ",".join(df.columns)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_pydict({"value": head})
                first = False
            yield batch

    lines = df.select(F.to_csv(F.struct(*df.columns), {"nullValue": MISSING}).alias("value"))
    lines.mapInArrow(task, "value string").write.mode("overwrite").text(path)


def write_panel_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> list[str]:
    """Write named result tables under one folder, one directory each."""
    paths = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(path)
        paths.append(path)
    return paths


def write_text_table(df: DataFrame, path: str) -> None:
    """Write a table as text with "NA" for missing values."""
    df.write.mode("overwrite").option("header", "true").option("nullValue", MISSING).csv(path)
