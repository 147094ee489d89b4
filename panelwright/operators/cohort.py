"""Population cube, cohort tables and within-cohort factors.

Names used throughout: ``state`` is the panel member, ``yr`` the period,
``age`` the age at the period and ``cohort = yr - age``. A cube holds one row
per (state, yr, age), so everything grouped by (state, cohort) has at most one
row per age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import ratio
from ..functions.calendar import period_quarter, period_year
from ..functions.labels import recode
from ..functions.nulls import only_value
from ..functions.rounding import round_half_even
from ..levels import REGION_LABELS
from .reshape import pivot_longer


def population_cube(
    obs: DataFrame,
    regions: dict[str, str] = REGION_LABELS,
    sex: str = "3",
    quarter: str = "Q2",
    max_age: int = 9,
    first_cohort: int = 2001,
) -> DataFrame:
    """Flat observations (all text) -> typed cube of one sex and one quarter."""
    typed = obs.select(
        F.substring("time_period", 1, 4).alias("year"),
        period_year("time_period").alias("yr"),
        recode("region", regions).alias("state"),
        F.col("age").try_cast("int").alias("age"),
        F.col("obs_value").try_cast("double").alias("erp"),
        F.col("sex").alias("_sex"),
        period_quarter("time_period").alias("_quarter"),
    )
    kept = typed.where((F.col("_sex") == sex) & (F.col("_quarter") == quarter) & (F.col("age") <= max_age))
    cube = kept.withColumn("cohort", F.col("yr") - F.col("age")).where(F.col("cohort") >= first_cohort)
    return cube.select("year", "yr", "state", "age", "erp", "cohort")


def _at_age(age: int, value: str = "erp") -> Column:
    return only_value(F.when(F.col("age") == age, F.col(value)), f"age {age}")


def cohort_table(cube: DataFrame, ages: range = range(6)) -> DataFrame:
    """One row per (cohort, state), one column per age; cohorts without a first-age row are left out."""
    first = ages[0]
    wide = (
        cube.where(F.col("age").between(first, ages[-1]))
        .groupBy("cohort", "state")
        .agg(
            F.count(F.when(F.col("age") == first, F.lit(1))).alias("_spine"),
            *[_at_age(a).alias(f"erp{a}") for a in ages],
        )
    )
    return wide.where("_spine > 0").select(
        "cohort", "state", (F.col("cohort") + 4).alias("yr_in_erp4"), *[f"erp{a}" for a in ages]
    )


def cohort_long(table: DataFrame, ages: range = range(6)) -> DataFrame:
    """Cohort table -> one row per age, ages not yet reached included."""
    ids = ["cohort", "state", "yr_in_erp4"]
    tall = pivot_longer(table, ids, {f"erp{a}": str(a) for a in ages}, "_age", "erp_at_age")
    age = F.col("_age").cast("int")
    return tall.select(*ids, age.alias("age"), (F.col("cohort") + age).alias("yr"), "erp_at_age")


def ages_side_by_side(cube: DataFrame, ages: list[int], prefix: str, complete_only: bool = False) -> DataFrame:
    """(yr, state) with one column per listed age."""
    wide = (
        cube.where(F.col("age").isin(ages))
        .groupBy("yr", "state")
        .agg(*[_at_age(a).alias(f"{prefix}{a}") for a in ages])
    )
    return wide.dropna() if complete_only else wide


def inverse_change_factors(cube: DataFrame, digits: int = 4) -> DataFrame:
    """Per cohort: size at 4 over size at 5, size at 5 over size at 6, with the years they apply to."""
    wide = (
        cube.where(F.col("age").between(4, 6))
        .groupBy("state", "cohort")
        .agg(*[_at_age(a).alias(f"age_{a}") for a in (4, 5, 6)])
    )
    return wide.select(
        "state",
        "cohort",
        "age_4",
        "age_5",
        "age_6",
        (F.col("cohort") + 5).alias("yr_turn_5"),
        (F.col("cohort") + 6).alias("yr_turn_6"),
        round_half_even(ratio("age_4", "age_5"), digits).alias("inv_chg_4_5"),
        round_half_even(ratio("age_5", "age_6"), digits).alias("inv_chg_5_6"),
    )


def cohort_change_report(factors: DataFrame, younger: int = 2016, older: int = 2015) -> DataFrame:
    """Absolute change of the two cohorts that turned five and six last."""
    return factors.where(F.col("cohort").isin(older, younger)).select(
        "state",
        "cohort",
        "age_4",
        "age_5",
        "age_6",
        "inv_chg_4_5",
        "inv_chg_5_6",
        F.when(F.col("cohort") == younger, F.col("age_5") - F.col("age_4")).otherwise(0.0).alias("chg_4_5"),
        F.when(F.col("cohort") == older, F.col("age_6") - F.col("age_5")).otherwise(0.0).alias("chg_5_6"),
    )
