"""Aggregates and predicates in which one missing value makes the result missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import column


def complete(*cols: Column | str) -> Column:
    """True where every column holds a value."""
    return reduce(lambda a, b: a & b, [column(c).isNotNull() for c in cols])


def _whole(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def strict_sum(c: Column | str) -> Column:
    """Sum that is null when any input is null."""
    c = column(c)
    return F.when(_whole(c), F.sum(c))


def strict_mean(c: Column | str) -> Column:
    """Mean that is null when any input is null."""
    c = column(c)
    return F.when(_whole(c), F.avg(c))


def strict_mean_where(c: Column | str, keep: Column) -> Column:
    """Strict mean over the rows for which ``keep`` holds; null when there are none."""
    c = column(c)
    kept = F.coalesce(keep, F.lit(False))
    return F.when(F.count(F.when(kept, c)) == F.count(F.when(kept, F.lit(1))), F.avg(F.when(kept, c)))


def strict_max(c: Column | str) -> Column:
    """Maximum that is null when any input is null."""
    c = column(c)
    return F.when(_whole(c), F.max(c))


def only_value(c: Column, what: str) -> Column:
    """The single non-null value of a group; a second one stops the query.

    Used where a cell key has to be unique: a duplicate is an input error that
    must not be summed or dropped silently.
    """
    problem = F.raise_error(F.lit(f"more than one value for {what}"))
    return F.when(F.count(c) > 1, problem).otherwise(F.max(c))


def is_not_in(c: Column | str, values: list) -> Column:
    """Negated membership in which a null counts as "not in"."""
    return ~F.coalesce(column(c).isin(values), F.lit(False))


def null_where(c: Column | str, cond: Column) -> Column:
    """The column with a null wherever the condition holds."""
    return F.when(~F.coalesce(cond, F.lit(False)), column(c))
