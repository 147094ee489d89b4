"""School enrolments, the migration-adjusted denominator and the measure panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import ratio
from ..functions.calendar import reference_date, year_before
from ..functions.labels import recode
from ..functions.rounding import round_half_even
from ..levels import FOUNDATION_GRADE, SCHOOL_AGES, SCHOOL_MEMBERS
from .aggregates import sum_with_total
from .cohort import ages_side_by_side
from .joins import full_join, left_join
from .reshape import fill_zero, pivot_longer, pivot_wider


def enrolment_by_age(
    counts: DataFrame,
    grade: str = FOUNDATION_GRADE,
    ages: dict[str, str] = SCHOOL_AGES,
    members: dict[str, str] = SCHOOL_MEMBERS,
    total_label: str = "Aust",
) -> DataFrame:
    """Raw counts of one grade -> per (year, state): ages 5 and 6, all ages, and 5 + 6 together.

    An age without a count is 0. The total member comes from the same pass.
    """
    rows = counts.where(F.col("grade") == grade).select(
        "year",
        recode("state", members, F.col("state")).alias("state"),
        "grade",
        recode("age", ages, F.col("age")).alias("age"),
        "all_ages",
    )
    sums = sum_with_total(rows, ["year", "grade", "age"], "state", {"all_ages": "n"}, total_label)
    names = {label: label.lower() for label in ages.values()}
    wide = fill_zero(pivot_wider(sums, ["year", "state", "grade"], "age", "n", names))
    columns = list(names.values())
    return wide.select(
        "year",
        "state",
        "grade",
        "aged_5",
        "aged_6",
        sum((F.col(c) for c in columns[1:]), F.col(columns[0])).alias("all_ages"),
        (F.col("aged_5") + F.col("aged_6")).alias("total_5_6"),
    )


def age_fraction(enrolments: DataFrame) -> DataFrame:
    """Move school year n to reference year n - 1 and split the ages 5 and 6 in shares."""
    return enrolments.select(
        year_before("year").alias("yr"),
        "state",
        F.col("year").alias("orig_yr"),
        F.col("all_ages").alias("val"),
        round_half_even(ratio("aged_5", "total_5_6"), 2).alias("p5"),
        round_half_even(ratio("aged_6", "total_5_6"), 2).alias("p6"),
    )


def migration_adjusted_denominator(lagged: DataFrame, factors: DataFrame) -> DataFrame:
    """Take the migration between the reference year and the school year out of the enrolments."""
    fives = factors.select("state", F.col("yr_turn_5").alias("orig_yr"), "inv_chg_4_5")
    sixes = factors.select("state", F.col("yr_turn_6").alias("orig_yr"), "inv_chg_5_6")
    joined = left_join(left_join(lagged, fives, ["state", "orig_yr"]), sixes, ["state", "orig_yr"]).dropna()
    factor = F.col("p5") * F.col("inv_chg_4_5") + F.col("p6") * F.col("inv_chg_5_6")
    return joined.withColumn("measure", round_half_even(F.col("val") * factor, 0))


def measure_panel(
    adjusted: DataFrame, cube: DataFrame, lagged: DataFrame, skip_years: tuple[int, ...] = (2005,)
) -> DataFrame:
    """Adjusted measure, population of 4 and 5 year olds and raw lagged enrolments per (yr, state)."""
    population = ages_side_by_side(cube, [4, 5], "erp_")
    panel = full_join(adjusted.select("yr", "state", "measure"), population, ["yr", "state"])
    if skip_years:
        panel = panel.where(~F.col("yr").isin(*skip_years))
    enrolled = lagged.select("yr", "state", F.col("val").alias("enrol_lagged"))
    return left_join(panel, enrolled, ["yr", "state"])


MEASURES = ["enrol_lagged", "measure", "erp_4", "erp_5"]


def measure_panel_long(panel: DataFrame, after: int = 2006) -> DataFrame:
    """Long form of the panel with the reference date."""
    tall = pivot_longer(panel.where(F.col("yr") > after), ["yr", "state"], MEASURES, "series", "number")
    return tall.withColumn("date", reference_date("yr"))
