"""Rounding and integer conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


NOISE = 1e-11
"""Share of a value by which sums of doubles may differ with the order of summation."""


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """Round with ties to the even digit.

    Sums of doubles differ in the last bits with the order in which partitions
    are merged. A value within that noise of a tie is taken for the tie, so it
    goes the same way on every run and on every partitioning; any other value
    is rounded once, as it is. Plain double arithmetic, so it compiles with its
    stage, unlike decimal rounding; adding zero turns -0.0 into 0.0.
    """
    up = 10.0 ** abs(digits)
    if isinstance(c, str):
        # One SQL text instead of a chain of calls to the JVM.
        grow, shrink = ("*", "/") if digits >= 0 else ("/", "*")
        y = f"(CAST(`{c}` AS DOUBLE) {grow} {up!r}D)"
        tie = f"(rint({y} - 0.5D) + 0.5D)"
        whole = f"rint(CASE WHEN abs({y} - {tie}) <= {NOISE!r}D * greatest(abs({y}), 1D) THEN {tie} ELSE {y} END)"
        return F.expr(f"{whole} {shrink} {up!r}D + 0D")
    value = c.cast("double")
    scaled = value * up if digits >= 0 else value / up
    tie = F.rint(scaled - 0.5) + 0.5
    near = F.abs(scaled - tie) <= F.greatest(F.abs(scaled), F.lit(1.0)) * NOISE
    whole = F.rint(F.when(near, tie).otherwise(scaled))
    return (whole / up if digits >= 0 else whole * up) + 0.0


def truncate_int(c: Column | str) -> Column:
    """64-bit integer toward zero; what does not fit stops the query."""
    return column(c).cast("bigint")


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round several columns, each to its own number of digits."""
    return df.withColumns({name: round_half_even(name, n) for name, n in digits.items()})
