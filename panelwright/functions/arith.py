"""Row arithmetic on measures. A zero divisor gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import column, round_half_even


def ratio(n: Column | str, d: Column | str) -> Column:
    return F.try_divide(column(n), column(d))


def percent(n: Column | str, d: Column | str, digits: int = 1) -> Column:
    """100 * n / d, rounded."""
    return round_half_even(ratio(n, d) * 100, digits)


def percent_gap(value: Column | str, base: Column | str) -> Column:
    """How far a value lies from its base, in percent of the base."""
    return ratio(column(value) - column(base), base) * 100


def midpoint(a: Column | str, b: Column | str) -> Column:
    return (column(a) + column(b)) / 2
