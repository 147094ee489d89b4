"""Growth scenarios and the projection of cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import recode, sign_indicator
from ..functions.nulls import only_value, strict_mean_where
from ..functions.rounding import round_half_even, truncate_int
from ..levels import AGE_STEPS, NO_SCENARIO, SCENARIO_SHARES
from .aggregates import aggregate_growth, append_total_member
from .joins import left_join
from .reshape import clone_member, pivot_longer, pivot_wider, split_name_suffix


@dataclass(frozen=True)
class Horizon:
    """Latest observed year, the years of ordinary growth, and how far to project."""

    latest: int = 2021
    usual_first: int = 2016
    usual_last: int = 2019
    steps: int = 4

    @property
    def years(self) -> list[int]:
        return [self.latest + i for i in range(1, self.steps + 1)]


def growth_sign(changes: DataFrame, horizon: Horizon) -> DataFrame:
    """"pos" or "neg" per member, by its growth in the latest year."""
    growth = aggregate_growth(changes.where(F.col("yr") == horizon.latest), ["state", "yr"], "chg", "erp")
    return growth.select("state", sign_indicator("chg_p").alias("sign"))


def _rates(changes: DataFrame, horizon: Horizon) -> DataFrame:
    """The four means that both scenarios are made of, in one aggregation."""
    recent = F.col("yr") >= horizon.latest
    usual = F.col("yr").between(horizon.usual_first, horizon.usual_last)

    def mean(c: Column, keep: Column) -> Column:
        return round_half_even(strict_mean_where(c, keep), 5)

    half = F.col("p_chg") * 0.5
    grouped = changes.groupBy("state", "age").agg(
        mean(F.col("p_chg"), recent).alias("_recent"),
        mean(half, recent).alias("_recent_half"),
        mean(F.col("p_chg"), usual).alias("_usual"),
        mean(half, usual).alias("_usual_half"),
        F.count(F.when(recent, F.lit(1))).alias("_n"),
    )
    return grouped.where("_n > 0").drop("_n")


def _spread_over_years(rates: DataFrame, label: str, horizon: Horizon, second: Column) -> DataFrame:
    first, then, *later = horizon.years
    return rates.select(
        "state",
        "age",
        F.col("_recent").alias(f"{label}_{first}"),
        second.alias(f"{label}_{then}"),
        *[F.col("_usual").alias(f"{label}_{y}") for y in later],
    )


def scenario_rates_a(changes: DataFrame, horizon: Horizon = Horizon()) -> DataFrame:
    """A: the latest rate, then half of it, then the usual rate."""
    return _spread_over_years(_rates(changes, horizon), "A", horizon, F.col("_recent_half"))


def scenario_rates_b(changes: DataFrame, horizon: Horizon = Horizon(), signs: DataFrame | None = None) -> DataFrame:
    """B: as A, but members that grew use half of the usual rate in the second year."""
    signs = growth_sign(changes, horizon) if signs is None else signs
    rates = left_join(_rates(changes, horizon), signs, ["state"])
    second = F.when(F.col("sign") == "neg", F.col("_recent_half")).when(F.col("sign") == "pos", F.col("_usual_half"))
    return _spread_over_years(rates, "B", horizon, second)


def scenario_long(*scenarios: DataFrame) -> DataFrame:
    """Wide scenario tables -> (state, age, scenario, yr, rate) with display columns."""
    parts = None
    for wide in scenarios:
        names = [c for c in wide.columns if c not in ("state", "age")]
        tall = split_name_suffix(pivot_longer(wide, ["state", "age"], names, "_name", "rate"), "_name", "scenario", "yr")
        parts = tall if parts is None else parts.unionByName(tall)
    return parts.select(
        "state",
        "age",
        "scenario",
        "yr",
        "rate",
        round_half_even(F.col("rate") * 100, 2).alias("percent"),
        recode("age", AGE_STEPS).alias("age_turn"),
    )


def project_cohorts(
    cohorts: DataFrame,
    rates: DataFrame,
    ages: range = range(6),
    scenarios: tuple[str, ...] = ("A", "B"),
    last_year: int = 2025,
    steps: int = 4,
) -> DataFrame:
    """Fill the ages a cohort has not reached by advancing it at the scenario rates.

    ``cohorts``: one row per (state, cohort, age) with ``erp_at_age``;
    ``rates``: (state, age, scenario, yr, rate), the rate of reaching ``age``
    in ``yr``. A value is filled at most ``steps`` ages after a known one and
    only while every rate on the way is known. Known values stay. The cohort
    is laid out as one row, so the steps are plain columns and the products
    are formed in age order; truncation comes last.
    """
    by_scenario = rates.groupBy("state", "age", "yr").agg(
        *[only_value(F.when(F.col("scenario") == s, F.col("rate")), f"rate {s}").alias(f"_rate_{s}") for s in scenarios]
    )
    joined = left_join(cohorts, by_scenario, ["state", "age", "yr"])
    cells = []
    for a in ages:
        here = F.col("age") == a
        cells.append(only_value(F.when(here, F.col("erp_at_age")), f"age {a}").alias(f"_known_{a}"))
        cells += [F.max(F.when(here, F.col(f"_rate_{s}"))).alias(f"_rate_{s}_{a}") for s in scenarios]
    wide = joined.groupBy("cohort", "state").agg(*cells)

    first = ages[0]
    wide = wide.withColumns(
        {f"_run_{first}": F.lit(0), **{f"_{s}_{first}": F.col(f"_known_{first}") for s in scenarios}}
    )
    for a in ages[1:]:
        known, gap = F.col(f"_known_{a}"), F.col(f"_run_{a - 1}")
        out = {f"_run_{a}": F.when(known.isNotNull(), 0).otherwise(gap + 1)}
        for s in scenarios:
            prior = F.col(f"_{s}_{a - 1}")
            grown = F.when(gap < steps, prior + prior * F.col(f"_rate_{s}_{a}"))
            out[f"_{s}_{a}"] = F.coalesce(known, grown)
        wide = wide.withColumns(out)

    entries = [
        F.struct(
            F.lit(a).alias("age"),
            (F.col("cohort") + a).alias("yr"),
            F.col(f"_known_{a}").alias("erp_at_age"),
            *[truncate_int(f"_{s}_{a}").alias(f"erp_{s.lower()}") for s in scenarios],
        )
        for a in ages
    ]
    tall = wide.select("cohort", "state", F.explode(F.array(*entries)).alias("_e")).select("cohort", "state", "_e.*")
    return tall.where(F.col("yr") <= last_year)


def projection_by_age(projected: DataFrame, first_year: int = 2006, latest: int = 2021) -> DataFrame:
    """Ages 4 and 5 of a year side by side, per scenario.

    Up to ``latest`` the scenarios agree and collapse to "NA"; the first
    projected year is repeated under "NA" once per scenario, so that lines
    drawn from the history connect.
    """
    kept = projected.where((F.col("yr") >= first_year) & F.col("age").isin(4, 5))
    tall = pivot_longer(kept, ["state", "yr", "age"], {"erp_a": "ERP_A", "erp_b": "ERP_B"}, "assumption", "_erp")
    wide = tall.groupBy("yr", "state", "assumption").agg(
        F.count(F.when(F.col("age") == 5, F.lit(1))).alias("_spine"),
        only_value(F.when(F.col("age") == 5, F.col("_erp")), "age 5").alias("erp_5yr"),
        only_value(F.when(F.col("age") == 4, F.col("_erp")), "age 4").alias("erp_4yr"),
    )
    label = F.when(F.col("yr") <= latest, "NA").otherwise(F.col("assumption"))
    merged = wide.where("_spine > 0").drop("_spine").withColumn("assumption", label).distinct()
    copies = F.when(F.col("yr") == latest + 1, F.array(F.col("assumption"), F.lit("NA"))).otherwise(
        F.array("assumption")
    )
    return merged.withColumn("assumption", F.explode(copies))


def seed_new_cohort(cube: DataFrame, year: int, span: int = 3) -> DataFrame:
    """A cohort born in ``year``: the mean of the newborn of the ``span`` years before."""
    recent = (F.col("age") == 0) & F.col("yr").between(year - span, year - 1)
    size = cube.where(recent).groupBy("state").agg(strict_mean_where("erp", F.lit(True)).alias("erp"))
    return size.select(
        "state", F.lit(year).alias("yr"), F.lit(0).alias("age"), "erp", F.lit(year).alias("cohort")
    )


def scaled_rates(
    changes: DataFrame, horizon: Horizon, shares: dict[str, float] = SCENARIO_SHARES, years: list[int] | None = None
) -> DataFrame:
    """Zero, half and full usual growth as scenario rates; with ``years`` one row for each, as projections read them."""
    usual = F.col("yr").between(horizon.usual_first, horizon.usual_last)
    base = changes.where(usual).groupBy("state", "age").agg(strict_mean_where("p_chg", F.lit(True)).alias("_usual"))
    entries = [
        F.struct(F.lit(label).alias("scenario"), round_half_even(F.col("_usual") * share, 5).alias("rate"))
        for label, share in shares.items()
    ]
    rates = base.select("state", "age", F.explode(F.array(*entries)).alias("_e")).select("state", "age", "_e.*")
    return rates if years is None else rates.withColumn("yr", F.explode(F.array(*[F.lit(y) for y in years])))


def with_new_cohort(cube: DataFrame, year: int, span: int = 3) -> DataFrame:
    """The cube and the cohort seeded for ``year``."""
    seed = seed_new_cohort(cube, year, span)
    return cube.select(*seed.columns).unionByName(seed)


RANGE_MEASURES = ["erp_4yr", "fitted", "lower", "upper"]


def member_sum_projection(
    fitted: DataFrame, total_label: str = "Aust", shares: dict[str, float] = SCENARIO_SHARES
) -> DataFrame:
    """Fitted values and bounds per scenario, the total being the sum of the members.

    Rows without a scenario count for every scenario. The bounds of the total
    are sums of bounds, not a confidence interval.
    """
    labels = list(shares)
    cloned = clone_member(fitted.distinct(), "assumption", NO_SCENARIO, labels, keep_source=False)
    members = cloned.where(F.col("state") != total_label)
    stacked = append_total_member(members, ["yr", "assumption"], "state", RANGE_MEASURES, total_label)
    wide = pivot_wider(stacked, ["yr", "state"], "assumption", RANGE_MEASURES, {n: n.lower() for n in labels})
    ordered = [f"{m}_{n.lower()}" for n in labels for m in ("fitted", "lower", "upper")]
    return wide.select("yr", "state", *[f"erp_4yr_{n.lower()}" for n in labels], *ordered)
