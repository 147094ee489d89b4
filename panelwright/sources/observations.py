"""Statistical observation feeds in XML -> flat rows.

There are three layouts: observations that carry their full key, series that
hold their observations, and the compact form in which dimensions are
attributes. ``read_observations`` tells them apart and splits files anywhere,
also inside a series. The readers of one layout use Spark's XML source, which
splits large files at the row tag, so a series is one task's; the schema is
declared and no pass over the file is spent on inferring it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import RANGE_BYTES, read_feed

_PAIR = "array<struct<_id:string,_concept:string,_value:string>>"
_NUMBER = "struct<_value:string>"


def _reader(spark: SparkSession, tag: str, schema: str):
    return (
        spark.read.format("xml")
        .option("rowTag", tag)
        .option("ignoreNamespace", "true")
        .option("mode", "FAILFAST")
        .schema(schema)
    )


def _dimensions(pairs: str, names: dict[str, str]) -> list:
    """Key/value pairs -> one column per dimension (id in the feed -> column name)."""
    as_map = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.coalesce(p["_id"], p["_concept"]), p["_value"]))
    )
    return [F.try_element_at(as_map, F.lit(k)).alias(v) for k, v in names.items()]


def read_flat_observations(spark: SparkSession, path: str, dimensions: dict[str, str]) -> DataFrame:
    """``<Obs><ObsKey><Value id= value=/>..</ObsKey><ObsValue value=/></Obs>``"""
    raw = _reader(spark, "Obs", f"ObsKey struct<Value:{_PAIR}>, ObsValue {_NUMBER}").load(path)
    return raw.select(*_dimensions("ObsKey.Value", dimensions), F.col("ObsValue._value").alias("obs_value"))


def read_series_observations(
    spark: SparkSession, path: str, dimensions: dict[str, str], period: str = "time"
) -> DataFrame:
    """``<Series><SeriesKey><Value concept= value=/>..</SeriesKey><Obs><Time/><ObsValue value=/></Obs>..</Series>``"""
    raw = _reader(
        spark,
        "Series",
        f"SeriesKey struct<Value:{_PAIR}>, Obs array<struct<Time:string,ObsValue:{_NUMBER}>>",
    ).load(path)
    flat = raw.select(*_dimensions("SeriesKey.Value", dimensions), F.explode("Obs").alias("_o"))
    return flat.select(
        *dimensions.values(), F.col("_o.Time").alias(period), F.col("_o.ObsValue._value").alias("obs_value")
    )


def read_compact_observations(
    spark: SparkSession, path: str, dimensions: dict[str, str], value: str = "OBS_VALUE"
) -> DataFrame:
    """``<Obs AGE= SEX= .. OBS_VALUE=/>``"""
    fields = ", ".join(f"`_{c}` string" for c in [*dimensions, value])
    raw = _reader(spark, "Obs", fields).load(path)
    return raw.select(
        *[F.col(f"_{k}").alias(v) for k, v in dimensions.items()], F.col(f"_{value}").alias("obs_value")
    )


def read_observations(spark: SparkSession, path: str, dimensions: dict[str, str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of a feed in any layout: dimension id -> column name, and obs_value, all text.

    The period's id is TIME_PERIOD in every layout. Files are read in byte
    ranges; an observation belongs to the range it begins in.
    """
    return read_feed(spark, path, dimensions, range_bytes)


def write_flat_observations(obs: DataFrame, path: str, dimensions: dict[str, str]) -> None:
    """Write flat rows in the full-key layout (column name -> id in the feed)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("_id"), F.col(c).alias("_value")) for c, k in dimensions.items()])
    (
        obs.select(
            F.struct(pairs.alias("Value")).alias("ObsKey"), F.struct(F.col("obs_value").alias("_value")).alias("ObsValue")
        )
        .write.format("xml")
        .option("rootTag", "DataSet")
        .option("rowTag", "Obs")
        .mode("overwrite")
        .save(path)
    )


def write_series_observations(obs: DataFrame, path: str, dimensions: dict[str, str], period: str) -> None:
    """Write flat rows in the series layout; a series holds one observation for each period."""
    names = [c for c in dimensions if c != period]
    pairs = F.array(*[F.struct(F.lit(dimensions[c]).alias("_concept"), F.col(c).alias("_value")) for c in names])
    each = F.struct(F.col(period).alias("Time"), F.struct(F.col("obs_value").alias("_value")).alias("ObsValue"))
    series = obs.groupBy(*names).agg(F.array_sort(F.collect_list(each)).alias("Obs"))
    _write(series.select(F.struct(pairs.alias("Value")).alias("SeriesKey"), "Obs"), path, "Series")


def write_compact_observations(obs: DataFrame, path: str, dimensions: dict[str, str]) -> None:
    """Write flat rows in the compact layout."""
    _write(obs.select(*[F.col(c).alias(f"_{k}") for c, k in dimensions.items()], F.col("obs_value").alias("_OBS_VALUE")), path, "Obs")


def _write(rows: DataFrame, path: str, tag: str) -> None:
    rows.write.format("xml").option("rootTag", "DataSet").option("rowTag", tag).mode("overwrite").save(path)
