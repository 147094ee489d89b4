"""Repairing series: level breaks, outliers, migration revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import midpoint, percent_gap
from ..functions.labels import age_band, recode
from ..functions.nulls import null_where, strict_mean_where
from ..functions.rounding import round_half_even, truncate_int
from ..levels import MIGRATION_BANDS
from .aggregates import share_of_group
from .groups import attach_groups
from .joins import lagged_join, left_join
from .windows import centred_moving_mean


def rebase_segment(
    panel: DataFrame,
    keys: list[str],
    split: int = 2013,
    first: int = 2006,
    before: int = 2021,
) -> DataFrame:
    """Take a level break at ``split`` out of a measure, for each group.

    The gap of the measure to the mean population of ages 4 and 5, averaged
    over the years before the split, is deducted from those years. The year of
    the split keeps its value as the splice point.
    """
    rows = panel.where(F.col("yr") < before).withColumn("avg_4_5", midpoint("erp_4", "erp_5"))
    rows = rows.withColumn("diff_pc", percent_gap("measure", "avg_4_5"))
    gaps = rows.groupBy(*keys).agg(strict_mean_where("diff_pc", F.col("yr") < split).alias("gap"))
    joined = attach_groups(rows, gaps, keys)
    lowered = F.col("measure") - F.col("gap") / 100 * F.col("measure")
    adj = F.when(F.col("yr") < split, lowered).when(F.col("yr") == split, F.col("measure"))
    return joined.withColumn("measure_adj", adj).withColumn(
        "measure_new",
        F.when(F.col("yr").between(first, split - 1), F.col("measure_adj")).otherwise(F.col("measure")),
    )


def append_rebased_member(panel: DataFrame, member: str = "SA", label: str = "SA (adj)", split: int = 2013, before: int = 2021) -> DataFrame:
    """Stack the rebased series of one member as if it were another member."""
    rebased = rebase_segment(panel.where(F.col("state") == member), ["state"], split=split, before=before)
    late = null_where("measure", F.col("yr") < split)
    copy = rebased.withColumns(
        {
            "measure": truncate_int(F.coalesce(late, F.col("measure_adj"))).cast("double"),
            "state": F.lit(label),
        }
    )
    return panel.unionByName(copy.select(*panel.columns))


def outlier_repair(
    df: DataFrame,
    rules: DataFrame,
    value: str,
    keys: list[str],
    order: list[str],
    period: str = "yr",
    name: str = "repaired",
) -> DataFrame:
    """Apply a rule table (group, first, last, action) to a series.

    ``drop_first`` blanks a value before smoothing, ``smooth`` replaces it by
    the centred mean of three, ``drop_last`` blanks it afterwards. Kept values
    are rounded to whole numbers. Rules are unfolded to the periods they cover
    and folded to one row per group and period, so the join never multiplies
    rows and no row carries a list of rules.
    """
    actions = ("drop_first", "smooth", "drop_last")
    covered = rules.select(*keys, "action", F.explode(F.sequence("first", "last")).alias(period))
    folded = covered.groupBy(*keys, period).agg(
        *[F.max(F.when(F.col("action") == a, True)).alias(f"_{a}") for a in actions]
    )
    ruled = attach_groups(df, folded, [*keys, period])
    hit = {a: F.coalesce(F.col(f"_{a}"), F.lit(False)) for a in actions}
    flagged = ruled.withColumns({"_smooth": hit["smooth"], "_last": hit["drop_last"], name: null_where(value, hit["drop_first"])})
    smoothed = centred_moving_mean(flagged.drop("_drop_first", "_drop_last"), keys, order, name, name="_mean")
    kept = round_half_even(F.when(F.col("_smooth"), F.col("_mean")).otherwise(F.col(name)), 0)
    return smoothed.withColumn(name, null_where(kept, F.col("_last"))).select(*df.columns, name)


def migration_merge(overseas: DataFrame, interstate: DataFrame, measure: str = "3") -> DataFrame:
    """Net migration per (year, age band, region); a missing interstate value counts as 0."""

    def tidy(obs: DataFrame, name: str) -> DataFrame:
        return obs.where(F.col("measure") == measure).select(
            F.col("time").try_cast("int").alias("yr"),
            recode("age", MIGRATION_BANDS).alias("age_grp"),
            F.col("region").alias("state_code"),
            F.col("obs_value").try_cast("double").alias(name),
        )

    joined = left_join(tidy(overseas, "nom"), tidy(interstate, "imig"), ["yr", "age_grp", "state_code"])
    filled = joined.fillna(0, subset=["imig"])
    return filled.withColumn("net_mig_grp", F.col("nom") + F.col("imig"))


def apportion_by_share(single_ages: DataFrame, migration: DataFrame) -> DataFrame:
    """Split the migration of an age band over single years in proportion to population.

    ``single_ages``: (yr, state_code, age, erp_sya), one row per cell.
    """
    banded = single_ages.withColumn("age_grp", age_band("age"))
    shared = share_of_group(banded, ["state_code", "age_grp", "yr"], "erp_sya", "p", "erp_grp")
    joined = left_join(shared, migration.select("yr", "state_code", "age_grp", "net_mig_grp"), ["yr", "state_code", "age_grp"])
    part = round_half_even(F.col("net_mig_grp") * F.col("p"), 0)
    return joined.withColumn("net_mig_sya", part).select(
        "yr", "state_code", "age", "age_grp", "net_mig_sya", "net_mig_grp", "erp_sya", "erp_grp", "p"
    )


def revise_denominator(panel: DataFrame, apportioned: DataFrame, labels: dict[str, str], age: int = 5) -> DataFrame:
    """Deduct last year's migration of one age from the first-year-of-school series."""
    moved = apportioned.where(F.col("age") == age).select(
        "yr", recode("state_code", labels).alias("state"), F.col("net_mig_sya").alias("net_mig")
    )
    joined = lagged_join(panel, moved, "yr", ["state"])
    return joined.withColumn("first_yr_sch_revised", F.col("first_yr_sch") - F.col("net_mig")).drop("net_mig")
