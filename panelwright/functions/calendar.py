"""Periods: reference dates of 30 June, quarters, shifted years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import column


def reference_date(year: Column | str) -> Column:
    """30 June of the year."""
    return F.make_date(column(year).cast("int"), F.lit(6), F.lit(30))


def year_text(date: Column | str) -> Column:
    return F.date_format(column(date), "yyyy")


def period_year(period: Column | str) -> Column:
    """2013 from "2013-Q2"."""
    return F.substring(column(period), 1, 4).try_cast("int")


def period_quarter(period: Column | str) -> Column:
    """"Q2" from "2013-Q2"."""
    return F.substring(column(period), 6, 2)


def year_before(year: Column | str) -> Column:
    return column(year).cast("int") - 1
