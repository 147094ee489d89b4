"""Ordered operators: change along a cohort, moving means, normal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import ratio
from ..functions.rounding import round_half_even
from ..functions.tails import normal_quantile
from .groups import framed, number_rows_in_groups


def lag_change(
    cube: DataFrame,
    first_cohort: int | None = None,
    max_age: int = 6,
    member: str = "state",
    cohort: str = "cohort",
    period: str = "yr",
    age: str = "age",
    value: str = "erp",
    digits: int = 5,
) -> DataFrame:
    """Change and relative change against the previous row of the cohort.

    A cohort has one row per age, so a window never holds more than
    ``max_age + 1`` rows however large a member is. The previous row counts
    even when a period is missing in between. Incomplete rows are dropped.
    """
    rows = cube.where(F.col(age) <= max_age)
    if first_cohort is not None:
        # The whole cohort goes or stays, so the filter may run before the window.
        rows = rows.where(F.col(cohort) >= first_cohort)
    before = F.lag(value).over(Window.partitionBy(member, cohort).orderBy(period))
    changed = rows.withColumn("chg", F.col(value) - before)
    return changed.withColumn(
        "p_chg", round_half_even(ratio("chg", F.col(value) - F.col("chg")), digits)
    ).dropna()


def transition_rates(changes: DataFrame, steps: dict[int, str], after: int) -> DataFrame:
    """The rates as the cohort chart shows them: percent, step labels, no age 0, late years."""
    from ..functions.labels import recode

    kept = changes.where((F.col("yr") != F.col("cohort")) & (F.col("yr") > after))
    return kept.withColumns(
        {"age_turn": recode("age", steps), "percent": round_half_even(F.col("p_chg") * 100, 2)}
    )


def _frame(k: int, align: str) -> tuple[int, int]:
    if align == "center":
        half = (k - 1) // 2
        return -half, k - 1 - half
    if align == "right":
        return 1 - k, 0
    raise ValueError(f"unknown alignment {align!r}")


def _full_frame_mean(value: str, w, k: int) -> Column:
    return F.when(F.count(value).over(w) == k, F.avg(value).over(w))


def moving_mean(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    k: int = 3,
    align: str = "center",
    name: str = "adj",
    cells: int | None = None,
) -> DataFrame:
    """Mean of k neighbouring rows; null at the ends and where a neighbour is null.

    The result is that of one window over the group, whatever its size;
    ``cells``: into how many parts the whole table is cut, default the
    session's shuffle partitions.
    """
    low, high = _frame(k, align)
    return framed(df, keys, list(order), low, high, lambda w: _full_frame_mean(value, w, k), name, cells)


def centred_moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, k: int = 3, name: str = "adj") -> DataFrame:
    return moving_mean(df, keys, order, value, k, "center", name)


def right_moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, k: int = 3, name: str = "adj") -> DataFrame:
    return moving_mean(df, keys, order, value, k, "right", name)


def normal_scores(
    df: DataFrame, keys: list[str], value: str, tie_break: list[str], name: str = "theoretical"
) -> DataFrame:
    """Theoretical quantile of each value for a normal Q-Q plot.

    ``keys=[]`` ranks the whole frame. Equal values are told apart by
    ``tie_break``. Missing values take no rank and get no quantile; they sort
    last, so one order serves all rows.
    """
    ranked = number_rows_in_groups(df, keys, [F.col(value).isNull(), value, *tie_break], "_i", "_n", F.col(value))
    a = F.when(F.col("_n") <= 10, 3 / 8).otherwise(0.5)
    placed = ranked.withColumn("_point", (F.col("_i") - a) / (F.col("_n") + 1 - 2 * a))
    score = F.when(F.col(value).isNotNull(), normal_quantile("_point"))
    return placed.withColumn(name, score).drop("_i", "_n", "_point")
