"""Long <-> wide, stacking, cloning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import only_value


def pivot_wider(
    df: DataFrame,
    ids: list[str],
    names_from: str,
    values_from: str | list[str],
    names: list | dict,
    prefix: str = "",
) -> DataFrame:
    """Rows -> columns, in one aggregation with map-side partial results.

    ``names`` lists the expected labels (or maps label -> column name), so no
    job is needed to discover them. Several value columns give
    ``value_label`` columns. A cell with two values stops the query.
    """
    labels = names if isinstance(names, dict) else {n: f"{prefix}{n}" for n in names}
    several = isinstance(values_from, list)
    out: list[Column] = []
    for value in values_from if several else [values_from]:
        for label, name in labels.items():
            cell = F.when(F.col(names_from) == label, F.col(value))
            name = f"{value}_{name}" if several else name
            kind = df.schema[value].dataType
            out.append(only_value(cell, f"{names_from} {label}").cast(kind).alias(name))
    return df.groupBy(*ids).agg(*out)


def pivot_longer(df: DataFrame, ids: list[str], columns: list[str] | dict, name: str, value: str) -> DataFrame:
    """Columns -> rows; a dict also gives the labels. One Expand, no shuffle."""
    labels = columns if isinstance(columns, dict) else {c: c for c in columns}
    renamed = df.select(*ids, *[F.col(f"`{c}`").alias(label) for c, label in labels.items()])
    return renamed.unpivot(ids, list(labels.values()), name, value)


def melt_cast(
    df: DataFrame,
    ids: list[str],
    members: list[str] | dict,
    member: str,
    item: str,
    items: list[str] | dict,
    integers: bool = True,
) -> DataFrame:
    """Member columns to rows, then item rows to columns."""
    tall = pivot_longer(df, [*ids, item], members, member, "_value")
    if integers:
        tall = tall.withColumn("_value", F.col("_value").cast("bigint"))
    return pivot_wider(tall, [*ids, member], item, "_value", items)


def split_name_suffix(df: DataFrame, column: str, label: str, period: str) -> DataFrame:
    """"Med_2022" -> label "Med" and period 2022: the last underscore divides; a name without one stops the query."""
    parts = F.regexp_extract(column, "(?s)^(.*)_([0-9]+)$", 2), F.regexp_extract(column, "(?s)^(.*)_([0-9]+)$", 1)
    out = df.withColumns({"_p": parts[0].cast("int"), "_l": parts[1]}).drop(column)
    return out.withColumnsRenamed({"_p": period, "_l": label})


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables by column name; a missing column becomes null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def zip_columns_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Put the columns of two tables with the same keys side by side.

    A key that only one side has, or that occurs twice on a side, stops the
    query instead of shifting or multiplying rows. Null keys equal null keys.
    Both tables meet in one grouping, so no key multiplies before it is seen.
    """
    mine = [c for c in left.columns if c not in keys]
    yours = [c for c in right.columns if c not in keys]
    a = left.select(*keys, F.struct(*mine).alias("_a"), F.lit(None).alias("_b"))
    b = right.select(*keys, F.lit(None).alias("_a"), F.struct(*yours).alias("_b"))
    met = a.union(b).groupBy(*keys).agg(
        F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.first("_a", True).alias("_a"), F.first("_b", True).alias("_b")
    )
    fits = (F.col("_na") == 1) & (F.col("_nb") == 1)
    problem = F.raise_error(F.lit("tables to be zipped differ in their keys or repeat one"))
    values = [(f"_a.{c}", c) for c in mine] + [(f"_b.{c}", c) for c in yours]
    return met.select(*keys, *[F.when(fits, F.col(source)).otherwise(problem).alias(c) for source, c in values])


def clone_member(df: DataFrame, column: str, source: str, labels: list[str], keep_source: bool = True) -> DataFrame:
    """Repeat the rows of one member under further labels, in the same pass."""
    targets = [F.col(column), *map(F.lit, labels)] if keep_source else [*map(F.lit, labels)]
    copies = F.when(F.col(column) == source, F.array(*targets)).otherwise(F.array(F.col(column)))
    return df.withColumn(column, F.explode(copies)).select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null -> 0 in the named, or in all numeric, columns."""
    return df.fillna(0, subset=columns)
