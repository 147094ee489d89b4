"""Projection, filters and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_not_in


def select_rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Choose, order and rename columns: source name -> new name."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def filter_in(df: DataFrame, col: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is in a literal list, or in the first column of a table."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("_key"))
        return df.join(keys, F.col(col) == F.col("_key"), "left_semi")
    return df.where(F.col(col).isin(values))


def filter_not_in(df: DataFrame, col: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is not in the list; a null is not in any list."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("_key")).where("_key is not null")
        return df.join(keys, F.col(col) == F.col("_key"), "left_anti")
    return df.where(is_not_in(col, values))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Listwise deletion over the named columns, or over all of them."""
    return df.dropna(subset=columns)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Dictionary of one or more columns."""
    return df.select(*columns).distinct()


def period_bounds(df: DataFrame, period: str) -> DataFrame:
    """First and last period."""
    return df.agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def order_by_levels(df: DataFrame, level: str, levels: list[str], *then: str) -> DataFrame:
    """Sort by the position in the level list, then by the given columns.

    The remaining columns close the sort key. The order is total, so the range
    partitioning can cut inside a member that holds much of the table.
    """
    from ..functions.labels import ordinal

    rest = [c for c in df.columns if c != level and c not in then]
    return df.orderBy(ordinal(level, levels).asc_nulls_last(), *then, level, *rest)


def numbered_by_levels(df: DataFrame, level: str, levels: list[str], *then: str, name: str = "position") -> DataFrame:
    """The rows with their position in the order of :func:`order_by_levels`."""
    from ..functions.labels import ordinal
    from .groups import number_rows

    rest = [c for c in df.columns if c != level and c not in then]
    place = ordinal(level, levels)
    return number_rows(df, [place.isNull(), place, *then, level, *rest], name)


def selection_view(
    df: DataFrame,
    members: list[str] | None = None,
    periods: list | DataFrame | None = None,
    period_range: tuple | None = None,
    series: list[str] | None = None,
    ratios: list[str] | None = None,
    scenario: str | None = None,
    columns: dict[str, str] | None = None,
    distinct: bool = True,
    exclude_members: list[str] | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """The slice behind one table or chart of the interactive reports.

    Every choice is a plain filter, so all of them reach the scan of a stored
    panel. ``periods`` may be the first column of a table: on a panel stored by
    period, the folders of other periods are then skipped at run time.
    ``scenario`` keeps the rows without scenario as well. ``names`` overrides
    the column names the filters act on.
    """
    col = {
        "member": "state",
        "period": "yr",
        "series": "series",
        "ratio": "ratio",
        "scenario": "assumption",
        **(names or {}),
    }
    if scenario is not None:
        df = df.where(F.col(col["scenario"]).isin("N.A.", scenario))
    if members is not None:
        df = df.where(F.col(col["member"]).isin(members))
    if exclude_members is not None:
        df = df.where(~F.col(col["member"]).isin(exclude_members))
    if periods is not None:
        df = filter_in(df, col["period"], periods)
    if period_range is not None:
        df = df.where(F.col(col["period"]).between(*period_range))
    if series is not None:
        df = df.where(F.col(col["series"]).isin(series))
    if ratios is not None:
        df = df.where(F.col(col["ratio"]).isin(ratios))
    if columns is not None:
        df = select_rename(df, columns)
    return (df.distinct() if distinct else df).dropna()
