"""Group totals on rows and row numbers in groups, for groups of any size.

A window partitioned by the group puts a whole group into one task. A member
of the panel can hold a third of all rows, so nothing here does that: totals
are pre-aggregated and joined back, ordered work is done in cells of the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])


def attach_groups(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``table``, one row per group, to ``rows``.

    A plain equi join without hint: Spark broadcasts a table whose bytes it
    knows to be few, and otherwise the adaptive skew join splits the rows of a
    heavy group, whether or not the table has it. Null keys match null keys, as
    they do in a grouping.
    """
    payload = [c for c in table.columns if c not in keys]
    renamed = table.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    return rows.join(renamed, _same_keys(keys), how).select(*rows.columns, *payload)


SAMPLED = 60
"""Rows looked at for each cell, about."""


def _sort_key(v) -> tuple:
    """Python order of a value = Spark's ascending order: nulls first, texts by their bytes, NaN last."""
    if isinstance(v, str):
        v = v.encode()
    return (0,) if v is None else (2,) if v != v else (1, v)


def _literal(text: str | None, kind: str) -> str:
    if text is None:
        return f"CAST(NULL AS {kind})"
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{quoted}' AS {kind})"


def with_cells(df: DataFrame, key: list[str], cells: int, name: str = "_cell") -> DataFrame:
    """The rows with the number of their cell; cells follow each other in the ascending order of ``key``, nulls first.

    Cut points come from a sample by the hash of the key, so the same rows give
    the same cells in every job and on every retry and nothing has to be
    written to fix them. What the driver holds is about SAMPLED keys a cell, as
    for a range partitioning. Equal keys share a cell.
    """
    kinds = [df.schema[k].dataType.simpleString() for k in key]
    share = SAMPLED * cells / max(1, df.count())
    picked = df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < share * (1 << 30)).groupBy(*key).count()
    texts = [F.col(k).cast("string").alias(f"_t{i}") for i, k in enumerate(key)]
    sample = sorted(picked.select(*key, *texts, "count").collect(), key=lambda r: [_sort_key(r[i]) for i in range(len(key))])
    cuts, seen = [], 0
    for r in sample:
        if seen >= SAMPLED:
            cuts.append(r[len(key) : 2 * len(key)])
            seen = 0
        seen += r["count"]
    if not cuts:
        return df.withColumn(name, F.lit(0))
    point = lambda values: "named_struct(" + ", ".join(f"'f{i}', {v}" for i, v in enumerate(values)) + ")"
    row = point([f"`{k}`" for k in key])
    table = "array(" + ", ".join(point([_literal(t, kind) for t, kind in zip(c, kinds)]) for c in cuts) + ")"
    steps = ", ".join(str(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1))
    # A binary search for the number of cut points that are not above the row.
    below = f"CASE WHEN lo + step > {len(cuts)} THEN lo WHEN element_at({table}, lo + step) <= {row} THEN lo + step ELSE lo END"
    return df.withColumn(name, F.expr(f"aggregate(array({steps}), 0, (lo, step) -> {below})"))


def _own(df: DataFrame, *taken: str) -> str:
    """A beginning that no column has, for columns of passage."""
    own = "_"
    while any(c.startswith(own) for c in (*df.columns, *taken)):
        own += "_"
    return own


def _ordered(df: DataFrame, own: str, keys: list[str], order: list, partitions: int | None) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with their cell of keys and order; the columns to partition a window by and to order it by."""
    sort = {f"{own}o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    cells = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_cells(df.withColumns(sort), [*keys, *sort], cells, f"{own}cell"), [*keys, f"{own}cell"], list(sort)


def number_rows(df: DataFrame, order: list, name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers 1..n over the whole table without a one-task sort; ``order``: ascending, nulls first."""
    return number_rows_in_groups(df, [], order, name, "_size", partitions=partitions).drop("_size")


def number_rows_in_groups(
    df: DataFrame,
    keys: list[str],
    order: list,
    name: str = "row_no",
    size: str = "group_n",
    counted: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Row number in the group and size of the group (``counted``: of its rows where this is not null).

    Rows are numbered inside the cells of their group; exact counts of the cells
    before (a row for each group and cell) are added. ``order``: columns,
    ascending with nulls first. Of rows equal in keys and order any may be the
    first. ``partitions``: number of cells, default the session's shuffle
    partitions; a large group is dealt over many, small groups share one.
    """
    own = _own(df, name, size)
    rows, window, sort = _ordered(df, own, keys, order, partitions)
    cell, rows_, before, no = (f"{own}{c}" for c in ("cell", "rows", "before", "no"))
    sizes = rows.groupBy(*window).agg(F.count(F.lit(1)).alias(rows_), F.count(F.lit(1) if counted is None else counted).alias(size))
    # Cells of a group: at most the number of cells.
    group = Window.partitionBy(*keys)
    sofar = F.sum(rows_).over(group.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    table = sizes.select(*window, F.coalesce(sofar, F.lit(0)).alias(before), F.sum(size).over(group).alias(size))
    numbered = rows.withColumn(no, F.row_number().over(Window.partitionBy(*window).orderBy(*sort)))
    return attach_groups(numbered, table, window).select(*df.columns, (F.col(before) + F.col(no)).alias(name), size)


def framed(df: DataFrame, keys: list[str], order: list, low: int, high: int, result, name: str, partitions: int | None = None) -> DataFrame:
    """A function of the rows ``low`` .. ``high`` around each row of its group, as one window over the group would give it.

    ``result`` maps a window to a column. Every cell is a window of its own; the
    rows whose frame reaches over its ends are worked out again, from the ends
    of all cells of the group, which are few rows.
    """
    own = _own(df, name)
    rows, window, sort = _ordered(df, own, keys, order, partitions)
    cell, no, cut, end = (f"{own}{c}" for c in ("cell", "no", "cut", "end"))
    inside = Window.partitionBy(*window).orderBy(*sort)
    alone = lambda back, on: F.lag(F.lit(1), back).over(inside).isNull() | F.lead(F.lit(1), on).over(inside).isNull()
    held = rows.withColumns({name: result(inside.rowsBetween(low, high)), no: F.row_number().over(inside), cut: alone(-low, high), end: alone(high - low, high - low)})
    across = Window.partitionBy(*keys).orderBy(cell, no).rowsBetween(low, high)
    ends = held.where(end).withColumn(name, result(across)).where(cut)
    return held.where(~F.col(cut)).unionByName(ends).select(*df.columns, name)
