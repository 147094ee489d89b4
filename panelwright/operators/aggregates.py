"""Grouped aggregates. All of them aggregate partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import ratio
from ..functions.labels import significance_stars
from ..functions.nulls import complete, strict_max, strict_mean, strict_sum
from ..functions.rounding import round_half_even
from ..functions.tails import t_two_sided_sql
from .groups import attach_groups


def group_sum_strict(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Sum per key, null when a value is missing: source column -> result name."""
    return df.groupBy(*keys).agg(*[strict_sum(c).alias(name) for c, name in measures.items()])


def group_mean_strict(df: DataFrame, keys: list[str], measures: dict[str, str], digits: int | None = None) -> DataFrame:
    """Mean per key, null when a value is missing."""

    def mean(c: str) -> Column:
        return strict_mean(c) if digits is None else round_half_even(strict_mean(c), digits)

    return df.groupBy(*keys).agg(*[mean(c).alias(name) for c, name in measures.items()])


def sum_with_total(
    df: DataFrame, keys: list[str], member: str, measures: dict[str, str], total_label: str
) -> DataFrame:
    """Strict sums per member and for all members together, from one pass over the rows.

    The rows are summed per member first; only those sums are then doubled for
    the total. Grouping sets would double every input row instead.
    """
    names = list(measures.values())
    sums = group_sum_strict(df, [*keys, member], measures)
    part = [
        F.struct(F.col(member).alias(member), F.lit(False).alias("_total")),
        F.struct(F.lit(total_label).alias(member), F.lit(True).alias("_total")),
    ]
    doubled = sums.select(*keys, F.explode(F.array(*part)).alias("_m"), *names).select(*keys, "_m.*", *names)
    whole = doubled.groupBy(*keys, member, "_total").agg(*[strict_sum(n).alias(n) for n in names])
    return whole.select(*keys, member, *names)


def append_total_member(
    df: DataFrame, keys: list[str], member: str, measures: list[str], total_label: str
) -> DataFrame:
    """Stack a total member under a table that already holds one row per member.

    One pass: every row stands for itself and for the total. Columns that are
    neither key nor measure are null in the total.
    """
    others = [c for c in df.columns if c not in (*keys, member, *measures)]
    part = [
        F.struct(F.col(member).alias(member), F.lit(False).alias("_total"), *[F.col(c).alias(c) for c in others]),
        F.struct(F.lit(total_label).alias(member), F.lit(True).alias("_total"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in others]),
    ]
    doubled = df.select(*keys, *measures, F.explode(F.array(*part)).alias("_m")).select(*keys, *measures, "_m.*")
    sums = doubled.groupBy(*keys, member, "_total", *others).agg(*[strict_sum(c).alias(c) for c in measures])
    return sums.select(*df.columns)


def aggregate_growth(df: DataFrame, keys: list[str], change: str, level: str, digits: int = 1) -> DataFrame:
    """Growth of all cohorts together, in percent of the level at the end of the period."""
    sums = df.groupBy(*keys).agg(strict_sum(level).alias("_level"), strict_sum(change).alias("chg"))
    growth = round_half_even(ratio("chg", "_level") * 100, digits)
    return sums.select(*keys, "chg", growth.alias("chg_p"))


def share_of_group(df: DataFrame, keys: list[str], value: str, share: str = "p", total: str = "group_total", digits: int = 4) -> DataFrame:
    """Value as a share of its group's strict total, total attached."""
    totals = df.groupBy(*keys).agg(strict_sum(value).alias(total))
    joined = attach_groups(df, totals, keys)
    return joined.withColumn(share, round_half_even(ratio(value, total), digits))


def max_with_ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that equal the maximum of their group; a missing value drops the group."""
    best = df.groupBy(*keys).agg(strict_max(value).alias("_best"))
    joined = attach_groups(df, best, keys)
    return joined.where(F.col(value) == F.col("_best")).drop("_best")


def _correlation(x: str, y: str) -> Column:
    """Pearson r of two SQL terms; null when a side does not vary.

    Built from centred products, because the built-in ``corr`` raises a
    division error on a side without variation.
    """
    r = f"try_divide(regr_sxy({y}, {x}), sqrt(regr_sxx({y}, {x})) * sqrt(regr_syy({y}, {x})))"
    # least and greatest skip nulls, so a missing r needs its own branch.
    return F.expr(f"CASE WHEN {r} IS NOT NULL THEN least(1D, greatest(-1D, {r})) END")


def _correlation_p(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation: 0 for a perfect one, null below three pairs."""
    t = f"({r} * sqrt({n} - 2) / sqrt(1D - {r} * {r}))"
    return F.expr(
        f"CASE WHEN {n} <= 2 THEN NULL WHEN 1D - {r} * {r} <= 0D THEN 0D ELSE {t_two_sided_sql(t, f'({n} - 2)')} END"
    )


def group_corr(df: DataFrame, keys: list[str], x: str, y: str, digits: int | None = 2, name: str = "r") -> DataFrame:
    """Correlation per group over the rows that have both values."""
    r = _correlation(f"`{x}`", f"`{y}`")
    out = r if digits is None else round_half_even(r, digits)
    return df.where(complete(x, y)).groupBy(*keys).agg(out.alias(name))


def corr_test(df: DataFrame, keys: list[str], x: str, y: str, digits: int = 4) -> DataFrame:
    """Correlation, number of pairs, rounded two-sided p-value and its stars."""
    base = df.where(complete(x, y)).groupBy(*keys).agg(
        _correlation(f"`{x}`", f"`{y}`").alias("_r"), F.count(F.lit(1)).alias("n")
    )
    p = round_half_even(_correlation_p("_r", "n"), digits)
    return base.select(*keys, "n", round_half_even("_r", 2).alias("r"), p.alias("p_value")).withColumn(
        "stars", significance_stars("p_value")
    )


def corr_table(
    df: DataFrame,
    keys: list[str],
    y: str,
    covariates: dict[str, str],
    period: str,
    windows: dict[str, tuple[int, int]],
    digits: int = 2,
) -> DataFrame:
    """r and stars of y against each covariate, for each period window.

    Rows are complete over y and all covariates. All windows and covariates
    come out of one aggregation of conditional correlations.
    """
    cells, inside, tests = [], {}, {}
    for i, (first, last) in enumerate(windows.values()):
        # A null in y masks the pair: the products only count complete pairs.
        inside[f"_y{i}"] = F.when(F.col(period).between(first, last), F.col(y))
        cells.append(F.count(f"_y{i}").alias(f"_n{i}"))
        for j, c in enumerate(covariates):
            cells.append(_correlation(f"`{c}`", f"_y{i}").alias(f"_r{i}_{j}"))
            tests[f"_p{i}_{j}"] = round_half_even(_correlation_p(f"_r{i}_{j}", f"_n{i}"), 4)
    whole = df.where(complete(y, *covariates)).withColumns(inside)
    tested = whole.groupBy(*keys).agg(*cells).withColumns(tests)
    entries = []
    for i, w in enumerate(windows):
        parts = [F.lit(w).alias("window"), F.col(f"_n{i}").alias("n")]
        for j, label in enumerate(covariates.values()):
            parts.append(round_half_even(f"_r{i}_{j}", digits).alias(f"r_{label}"))
            parts.append(significance_stars(f"_p{i}_{j}").alias(f"sig_{label}"))
        entries.append(F.struct(*parts))
    return tested.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*").where("n > 0")
