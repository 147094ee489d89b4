"""Numerators over denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import percent
from ..functions.labels import ratio_label
from ..functions.nulls import only_value
from .joins import left_join
from .reshape import pivot_longer


def fanout_ratio_join(panel: DataFrame, numerators: list[str]) -> DataFrame:
    """Every series of a (yr, state) next to each of the numerators of that (yr, state).

    The numerators are first folded to one row per (yr, state), so the join
    itself is one-to-many on a unique key and only the explode fans out. The
    first numerator is the spine: without it a (yr, state) has no numerators.
    """
    folded = panel.where(F.col("series").isin(numerators)).groupBy("yr", "state").agg(
        F.count(F.when(F.col("series") == numerators[0], F.lit(1))).alias("_spine"),
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("numerator"),
                    only_value(F.when(F.col("series") == n, F.col("value")), n).alias("n"),
                )
                for n in numerators
            ]
        ).alias("_numerators"),
    )
    joined = left_join(panel, folded.where("_spine > 0").drop("_spine"), ["yr", "state"])
    return joined.withColumn("_e", F.explode_outer("_numerators")).select(*panel.columns, "_e.numerator", "_e.n")


def numerator_denominator_ratio(panel: DataFrame, numerators: list[str]) -> DataFrame:
    """Percent and label of every numerator over every series."""
    fanned = fanout_ratio_join(panel, numerators)
    return fanned.withColumns(
        {"percent": percent("n", "value"), "ratio": ratio_label("numerator", "series")}
    )


def stored_ratio(panel: DataFrame, numerators: list[str]) -> DataFrame:
    """:func:`numerator_denominator_ratio` along the buckets of a panel stored by member.

    A (yr, state) has one row for each series, so it is a window of its own; a
    panel with buckets by ``state`` has them together already and nothing is
    shuffled. A second value of a numerator stops the query.
    """
    here = Window.partitionBy("yr", "state")
    cells = {n: F.when(F.col("series") == n, F.col("value")) for n in numerators}
    spine = F.count(F.when(F.col("series") == numerators[0], F.lit(1))).over(here)
    twice = lambda n: F.raise_error(F.lit(f"more than one value of {n}"))
    each = [
        F.struct(F.lit(n).alias("numerator"), F.when(F.count(c).over(here) > 1, twice(n)).otherwise(F.max(c).over(here)).alias("n"))
        for n, c in cells.items()
    ]
    held = panel.withColumn("_numerators", F.when(spine > 0, F.array(*each)))
    fanned = held.withColumn("_e", F.explode_outer("_numerators")).select(*panel.columns, "_e.numerator", "_e.n")
    return fanned.withColumns({"percent": percent("n", "value"), "ratio": ratio_label("numerator", "series")})


def wide_ratio(wide: DataFrame, ids: list[str], series: list[str], numerator: str) -> DataFrame:
    """One numerator column over every series column of a wide panel, in long form."""
    held = wide.withColumn("_numerator", F.col(numerator))
    tall = pivot_longer(held, [*ids, "_numerator"], series, "series", "value")
    return tall.withColumnRenamed("_numerator", "numerator").withColumns(
        {
            "percent": percent("numerator", "value"),
            "ratio": ratio_label(F.lit(numerator), "series"),
        }
    )


def stacked_ratios(tall: DataFrame, numerators: dict[str, str]) -> DataFrame:
    """Several numerator columns over one value column, stacked: column -> display name."""
    entries = [
        F.struct(ratio_label(F.lit(name), "series").alias("ratio"), percent(c, "value").alias("percent"))
        for c, name in numerators.items()
    ]
    return tall.withColumn("_e", F.explode(F.array(*entries))).select(*tall.columns, "_e.ratio", "_e.percent")
