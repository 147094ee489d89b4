"""Queries: aggregates, windows, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import sign_indicator
from ..functions.rounding import round_columns
from ..operators import aggregates, reshape, select, windows
from ..operators.scenario import growth_sign
from . import panels, sqltext
from .panels import table
from .registry import query

rnd = sqltext.rnd

# ---- aggregates


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_partkey", F.expr("if(l_discount > 0.095, null, l_quantity)").alias("quantity"), "l_tax"
    )


@query(
    "group_sum_strict",
    f"""WITH g AS (SELECT l_partkey, CASE WHEN l_discount > 0.095 THEN NULL ELSE l_quantity END AS quantity FROM lineitem)
    SELECT l_partkey, {sqltext.strict_sum("quantity")} AS total FROM g GROUP BY l_partkey""",
)
def group_sum_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_sum_strict(_with_gaps(spark, sf_dir), ["l_partkey"], {"quantity": "total"})


@query(
    "group_mean_strict",
    f"""WITH g AS (SELECT l_partkey, CASE WHEN l_discount > 0.095 THEN NULL ELSE l_quantity END AS quantity, l_tax FROM lineitem)
    SELECT l_partkey, {rnd("(" + sqltext.strict_avg("quantity") + ")", 4)} AS mean_quantity,
           {rnd("avg(l_tax)", 4)} AS mean_tax FROM g GROUP BY l_partkey""",
)
def group_mean_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"quantity": "mean_quantity", "l_tax": "mean_tax"}
    return aggregates.group_mean_strict(_with_gaps(spark, sf_dir), ["l_partkey"], measures, digits=4)


@query(
    "append_total_member",
    f"""WITH {sqltext.ORDERS}, sums AS (SELECT yr, n_name AS state, count(*) AS n FROM order_rows GROUP BY yr, n_name)
    SELECT yr, state, n FROM sums UNION ALL SELECT yr, 'All', CAST(sum(n) AS BIGINT) FROM sums GROUP BY yr""",
)
def append_total_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = panels.orders_per_nation(spark, sf_dir, {"yr": F.year("o_orderdate")})
    rows = counts.select("yr", F.col("n_name").alias("state"), "n")
    return aggregates.append_total_member(rows, ["yr"], "state", ["n"], "All")


@query(
    "group_corr",
    f"""SELECT l_suppkey, {rnd("corr(l_quantity, l_extendedprice)", 2)} AS r FROM lineitem GROUP BY l_suppkey""",
)
def group_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_corr(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query(
    "corr_test",
    f"""WITH base AS (
      SELECT l_partkey, CASE WHEN count(*) > 1 THEN corr(l_quantity, l_extendedprice) END AS r, count(*) AS n
      FROM lineitem GROUP BY l_partkey),
    tested AS (SELECT l_partkey, n, r, r * sqrt(CAST(n - 2 AS DOUBLE)) / sqrt(1 - r * r) AS t, n - 2 AS df
               FROM base WHERE n > 2),
    p AS (SELECT l_partkey, {rnd(sqltext.t_p("t", "df"), 4)} AS p_value FROM tested)
    SELECT base.l_partkey, n, {rnd("r", 2)} AS r, p_value, {sqltext.stars("p_value")} AS stars
    FROM base LEFT JOIN p ON base.l_partkey = p.l_partkey""",
)
def corr_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.corr_test(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice")


def _corr_table_sql() -> str:
    parts = []
    for name, (lo, hi) in {"full": (1995, 2000), "late": (1997, 2000)}.items():
        parts.append(
            f"""SELECT state, '{name}' AS "window", count(*) AS n, corr(erp_4yr, measure) AS r4, corr(erp_5yr, measure) AS r5
            FROM model_input WHERE measure IS NOT NULL AND erp_4yr IS NOT NULL AND erp_5yr IS NOT NULL
              AND yr BETWEEN {lo} AND {hi} GROUP BY state"""
        )
    p4, p5 = (
        rnd(sqltext.t_p(f"(r{i} * sqrt(CAST(n - 2 AS DOUBLE)) / sqrt(1 - r{i} * r{i}))", "(n - 2)"), 4) for i in (4, 5)
    )
    return f"""WITH {sqltext.MODEL}, base AS ({" UNION ALL ".join(parts)}),
    p AS (SELECT *, {p4} AS p4, {p5} AS p5 FROM base)
    SELECT state, "window", n, {rnd("r4", 2)} AS r_4yrs, {sqltext.stars("p4")} AS sig_4yrs,
           {rnd("r5", 2)} AS r_5yrs, {sqltext.stars("p5")} AS sig_5yrs FROM p"""


@query("corr_table", _corr_table_sql())
def corr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.corr_table(
        panels.model_input(spark, sf_dir),
        ["state"],
        "measure",
        {"erp_4yr": "4yrs", "erp_5yr": "5yrs"},
        "yr",
        {"full": (1995, 2000), "late": (1997, 2000)},
    )


@query(
    "share_of_group",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
           sum(l_quantity) OVER (PARTITION BY l_suppkey) AS group_total,
           {rnd("l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey)", 4)} AS p FROM lineitem""",
)
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return aggregates.share_of_group(lines, ["l_suppkey"], "l_quantity")


@query(
    "aggregate_growth",
    f"""WITH {sqltext.CHANGES}
    SELECT state, yr, sum(chg) AS chg, {rnd("100 * sum(chg) / sum(erp)", 1)} AS chg_p FROM changes GROUP BY state, yr""",
)
def aggregate_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate_growth(panels.changes(spark, sf_dir), ["state", "yr"], "chg", "erp")


@query(
    "sign_indicator",
    f"""WITH {sqltext.CHANGES}
    SELECT state, yr, CASE WHEN {rnd("100 * sum(chg) / sum(erp)", 1)} > 0 THEN 'pos' ELSE 'neg' END AS sign
    FROM changes GROUP BY state, yr""",
)
def sign_of_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = aggregates.aggregate_growth(panels.changes(spark, sf_dir), ["state", "yr"], "chg", "erp")
    return growth.select("state", "yr", sign_indicator("chg_p").alias("sign"))


@query(
    "max_with_ties",
    """WITH q AS (SELECT l_suppkey, l_orderkey, l_linenumber,
                         CASE WHEN l_partkey = 1 THEN NULL ELSE l_quantity END AS quantity FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, quantity FROM (
      SELECT *, max(quantity) OVER w AS best, count(*) OVER w - count(quantity) OVER w AS missing
      FROM q WINDOW w AS (PARTITION BY l_suppkey))
    WHERE missing = 0 AND quantity = best""",
)
def max_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.expr("if(l_partkey = 1, null, l_quantity)").alias("quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", quantity)
    return aggregates.max_with_ties(lines, ["l_suppkey"], "quantity")


# ---- windows


@query("lag_change", f"WITH {sqltext.CHANGES} SELECT state, yr, age, erp, cohort, chg, p_chg FROM changes")
def lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.changes(spark, sf_dir)


@query(
    "lag_change_rates",
    f"""WITH {sqltext.CHANGES}
    SELECT state, yr, age, {sqltext.case("age", {i: f"{i - 1} to {i} yr" for i in range(1, 7)})} AS age_turn,
           {rnd("p_chg * 100", 2)} AS percent FROM changes WHERE yr <> cohort AND yr > 1997""",
)
def lag_change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..levels import AGE_STEPS

    rates = windows.transition_rates(panels.changes(spark, sf_dir), AGE_STEPS, after=1997)
    return rates.select("state", "yr", "age", "age_turn", "percent")


def _moving_sql(low: int, high: int) -> str:
    frame = f"ROWS BETWEEN {-low} PRECEDING AND " + (f"{high} FOLLOWING" if high else "CURRENT ROW")
    return f"""WITH e AS (SELECT event_type, event_id, CASE WHEN "value" > 300 THEN NULL ELSE "value" END AS v FROM events)
    SELECT event_type, event_id, {rnd("CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END", 4)} AS adj
    FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id {frame})"""


def _event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("if(value > 300, null, value)").alias("v")
    return table(spark, sf_dir, "events").select("event_type", "event_id", value)


@query("centred_moving_mean", _moving_sql(-1, 1))
def centred_moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = windows.centred_moving_mean(_event_values(spark, sf_dir), ["event_type"], ["event_id"], "v")
    return round_columns(smoothed.drop("v"), {"adj": 4})


@query("right_moving_mean", _moving_sql(-2, 0))
def right_moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = windows.right_moving_mean(_event_values(spark, sf_dir), ["event_type"], ["event_id"], "v")
    return round_columns(smoothed.drop("v"), {"adj": 4})


def _scores_sql(partition: str) -> str:
    point = "(i - a) / (n + 1 - 2 * a)"
    return f"""WITH ranked AS (
      SELECT event_type, event_id, "value", CAST(row_number() OVER ({partition} ORDER BY "value", event_id) AS DOUBLE) AS i,
             CAST(count(*) OVER ({partition}) AS DOUBLE) AS n FROM events),
    points AS (SELECT *, {point} AS pt FROM (SELECT *, CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END AS a FROM ranked))
    SELECT event_type, event_id, "value", {rnd(sqltext.normal_quantile("pt"), 6)} AS theoretical FROM points"""


@query("normal_scores", _scores_sql("PARTITION BY event_type"))
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return round_columns(windows.normal_scores(rows, ["event_type"], "value", ["event_id"]), {"theoretical": 6})


@query("normal_scores_global", _scores_sql(""))
def normal_scores_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return round_columns(windows.normal_scores(rows, [], "value", ["event_id"]), {"theoretical": 6})


# ---- reshaping

AGES = range(7)
_AGE_COLUMNS = ", ".join(f"max(erp) FILTER (age = {a}) AS aged_{a}" for a in AGES)


@query("pivot_wider", f"WITH {sqltext.CELLS} SELECT state, yr, {_AGE_COLUMNS} FROM cells GROUP BY state, yr")
def pivot_wider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot_wider(panels.cells(spark, sf_dir), ["state", "yr"], "age", "erp", list(AGES), "aged_")


_WIDE_MULTI = ", ".join(
    f"max({m}) FILTER (assumption = '{s}') AS {m}_{s.lower().replace('.', '')}"
    for m in ("measure", "erp_4yr", "numerator")
    for s in ("N.A.", "Zero", "Med", "High")
)


@query(
    "pivot_wider_multi",
    f"WITH {sqltext.MODEL} SELECT yr, state, {_WIDE_MULTI} FROM model_input GROUP BY yr, state",
)
def pivot_wider_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.model_input(spark, sf_dir)
    names = {"N.A.": "na", **{s: s.lower() for s in ("Zero", "Med", "High")}}
    return reshape.pivot_wider(rows, ["yr", "state"], "assumption", ["measure", "erp_4yr", "numerator"], names)


@query(
    "pivot_longer",
    """SELECT l_orderkey, l_linenumber, series, "value" FROM
    (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)
    UNPIVOT INCLUDE NULLS ("value" FOR series IN (quantity, discount, tax))""",
)
def pivot_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"l_quantity": "quantity", "l_discount": "discount", "l_tax": "tax"}
    return reshape.pivot_longer(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], columns, "series", "value"
    )


@query(
    "melt_cast",
    f"""WITH {sqltext.PRIORITY}
    SELECT yr, state, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in panels.PRIORITY_COLUMNS.values())}
    FROM priority_panel""",
)
def melt_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = panels.assembled(spark, sf_dir)
    members = list(panels.REGION_COLUMNS.values())
    return reshape.melt_cast(wide, ["yr"], members, "state", "data_item", panels.PRIORITY_COLUMNS)


@query(
    "split_name_suffix",
    f"""WITH {sqltext.LINES}
    SELECT n_name AS state, l_returnflag AS scenario, yr, sum(l_quantity) AS rate
    FROM lines GROUP BY n_name, l_returnflag, yr""",
)
def split_name_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", "l_returnflag", panels.ship_year())
    names = [f"{s}_{y}" for s in ("A", "N", "R") for y in range(1995, 2002)]
    sums = panels.per_nation(spark, sf_dir, {"name": name}, {"rate": F.col("l_quantity")})
    wide = reshape.pivot_wider(sums, ["n_name"], "name", "rate", names).withColumnRenamed("n_name", "state")
    tall = reshape.pivot_longer(wide, ["state"], names, "name", "rate").where("rate is not null")
    return reshape.split_name_suffix(tall, "name", "scenario", "yr")


@query(
    "union_by_name",
    """SELECT o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS name FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer
    UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return reshape.union_by_name(orders, customers, suppliers).select("id", "amount", "name")


@query(
    "zip_columns_checked",
    f"""WITH {sqltext.LINES}
    SELECT n_name AS state, yr, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lines GROUP BY n_name, yr""",
)
def zip_columns_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = {"yr": panels.ship_year()}
    quantity = panels.per_nation(spark, sf_dir, year, {"quantity": F.col("l_quantity")})
    lines = panels.per_nation(spark, sf_dir, year, {"n_lines": F.lit(1)})
    state = F.col("n_name").alias("state")
    return reshape.zip_columns_checked(
        quantity.select(state, "yr", "quantity"), lines.select(state, "yr", "n_lines"), ["state", "yr"]
    )


@query(
    "clone_member",
    """SELECT l_orderkey, l_linenumber, l_returnflag AS flag FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, f FROM lineitem, (VALUES ('N (adj)'), ('N (low)')) t(f) WHERE l_returnflag = 'N'""",
)
def clone_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    return reshape.clone_member(lines, "flag", "N", ["N (adj)", "N (low)"])


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.distinct_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query(
    "order_by_levels",
    """SELECT o_orderpriority, o_orderdate, o_orderkey, row_number() OVER (
    ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 END NULLS LAST,
             o_orderdate, o_orderpriority, o_orderkey) AS "position" FROM orders""",
)
def order_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey")
    return select.numbered_by_levels(orders, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"], "o_orderdate")


@query(
    "growth_sign",
    f"""WITH {sqltext.CHANGES}
    SELECT state, CASE WHEN {rnd("100 * sum(chg) / sum(erp)", 1)} > 0 THEN 'pos' ELSE 'neg' END AS sign
    FROM changes WHERE yr = 2001 GROUP BY state""",
)
def latest_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth_sign(panels.changes(spark, sf_dir), panels.HORIZON)
