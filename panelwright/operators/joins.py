"""Joins on panel keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str], how: str = "left") -> DataFrame:
    """Equi join on equal or differently named keys (left name -> right name).

    The left key names stay. A right or full join fills them from the right
    side. Null keys match null keys, as the panels' missing labels do.
    """
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    hidden = {rk: f"_r_{rk}" for rk in pairs.values()}
    values = [c for c in right.columns if c not in hidden]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}; rename one side first")
    cond: Column | None = None
    for lk, rk in pairs.items():
        same = F.col(lk).eqNullSafe(F.col(hidden[rk]))
        cond = same if cond is None else cond & same
    joined = left.join(right.withColumnsRenamed(hidden), cond, how)
    if how in ("right", "full"):
        joined = joined.withColumns({lk: F.coalesce(lk, hidden[rk]) for lk, rk in pairs.items()})
    return joined.select(*left.columns, *values)


def left_join(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    return join_keys(left, right, keys, "left")


def right_join(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    return join_keys(left, right, keys, "right")


def full_join(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    return join_keys(left, right, keys, "full")


def lagged_join(left: DataFrame, right: DataFrame, period: str, keys: list[str], shift: int = 1) -> DataFrame:
    """Give period y of the left side what the right side holds for y - shift."""
    moved = right.withColumn(period, F.col(period) + shift)
    return join_keys(left, moved, [*keys, period])


def replace_series(df: DataFrame, column: str, label: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take one series out, change it, and put it back."""
    changed = change(df.where(F.col(column) == label))
    return df.where(F.col(column) != label).unionByName(changed.select(*df.columns))


def subtract_from_series(
    df: DataFrame, column: str, label: str, value: str, deduction: DataFrame, keys: list[str], amount: str
) -> DataFrame:
    """Subtract ``amount`` (0 where the deduction has no row) from one series."""

    def change(series: DataFrame) -> DataFrame:
        joined = left_join(series, deduction.select(*keys, F.col(amount).alias("_amount")), keys)
        return joined.withColumn(value, F.col(value) - F.coalesce("_amount", F.lit(0)))

    return replace_series(df, column, label, change)
