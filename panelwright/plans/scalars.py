"""Queries: column functions on whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arith, calendar, labels, nulls, rounding
from ..functions.rounding import round_half_even
from ..operators import reshape
from . import panels, sqltext
from .panels import table
from .registry import query

rnd = sqltext.rnd


@query(
    "recode",
    f"""SELECT o_orderkey, {sqltext.case("o_orderpriority", panels.PRIORITY_AGES)} AS age_label,
    CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
    CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status_or_null FROM orders""",
)
def recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"F": "final", "O": "open"}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        labels.recode("o_orderpriority", panels.PRIORITY_AGES).alias("age_label"),
        labels.recode("o_orderstatus", states, F.col("o_orderstatus")).alias("status"),
        labels.recode("o_orderstatus", states).alias("status_or_null"),
    )


@query(
    "age_band",
    """SELECT p_partkey, p_size, CASE WHEN p_size BETWEEN 0 AND 4 THEN '0-4' WHEN p_size BETWEEN 5 AND 9 THEN '5-9' END AS band
    FROM part""",
)
def age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", labels.age_band("p_size").alias("band"))


@query(
    "significance_stars",
    f"""SELECT l_orderkey, l_linenumber, {sqltext.stars("p")} AS stars
    FROM (SELECT *, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_discount * l_tax END AS p FROM lineitem)""",
)
def significance_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("if(l_tax > 0.07, null, l_discount * l_tax)")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", labels.significance_stars(p).alias("stars")
    )


@query(
    "round_half_even",
    f"""SELECT l_orderkey, l_linenumber, {rnd("l_quantity / 4", 1)} AS q1, {rnd("l_quantity / 2", 0)} AS q0,
    {rnd("l_extendedprice * l_discount", 1)} AS d1, {rnd("l_discount * l_tax * 7", 3)} AS t3 FROM lineitem""",
)
def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 4).alias("q1"),
        (F.col("l_quantity") / 2).alias("q0"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("d1"),
        (F.col("l_discount") * F.col("l_tax") * 7).alias("t3"),
    )
    return rounding.round_columns(lines, {"q1": 1, "q0": 0, "d1": 1, "t3": 3})


@query(
    "date_parts",
    """SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS BIGINT), 6, 30) AS reference,
    strftime(o_orderdate, '%Y') AS year_text, concat('Q', quarter(o_orderdate)) AS quarter,
    CAST(year(o_orderdate) AS INTEGER) AS period_year FROM orders""",
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.col("o_orderdate")
    period = F.concat(F.year(ordered), F.lit("-Q"), F.quarter(ordered))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        calendar.reference_date(F.year(ordered)).alias("reference"),
        calendar.year_text(ordered).alias("year_text"),
        calendar.period_quarter(period).alias("quarter"),
        calendar.period_year(period).alias("period_year"),
    )


@query(
    "lag_year_label",
    """SELECT o_orderkey, CAST(year(o_orderdate) - 1 AS INTEGER) AS yr,
    strftime(make_date(year(o_orderdate) - 1, 6, 30), '%Y') AS "year", CAST(year(o_orderdate) AS INTEGER) AS orig_yr FROM orders""",
)
def lag_year_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    before = calendar.year_before(year)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        before.alias("yr"),
        calendar.year_text(calendar.reference_date(before)).alias("year"),
        year.alias("orig_yr"),
    )


@query(
    "coalesce_zero",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 0 ELSE l_quantity END AS quantity,
    CASE WHEN l_tax < 0.01 THEN 0 ELSE l_tax END AS tax FROM lineitem""",
)
def coalesce_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.expr("if(l_quantity > 40, null, l_quantity)").alias("quantity"),
        F.expr("if(l_tax < 0.01, null, l_tax)").alias("tax"),
    )
    return reshape.fill_zero(lines, ["quantity", "tax"])


@query(
    "coalesce_cols",
    """SELECT l_orderkey, l_linenumber,
    coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END, l_extendedprice) AS first_known FROM lineitem""",
)
def coalesce_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.coalesce(nulls.null_where("l_quantity", F.col("l_returnflag") == "R"), "l_extendedprice").alias("first_known"),
    )


@query(
    "null_where",
    """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1998-01-01' THEN NULL ELSE l_quantity END AS quantity
    FROM lineitem""",
)
def null_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = (F.col("l_linestatus") == "F") & (F.col("l_shipdate") < F.expr("timestamp_ntz '1998-01-01'"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", nulls.null_where("l_quantity", early).alias("quantity")
    )


@query(
    "row_arith",
    f"""SELECT l_orderkey, l_linenumber, {rnd("(l_discount + l_tax) / 2", 6)} AS mid,
    {rnd("(l_quantity - l_linenumber) / nullif(l_linenumber, 0) * 100", 4)} AS gap_pc,
    {rnd("l_discount / nullif(l_tax, 0)", 6)} AS ratio,
    {rnd("(l_quantity - 25) / l_quantity * 100", 1)} AS residual_pc FROM lineitem""",
)
def row_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        arith.midpoint("l_discount", "l_tax").alias("mid"),
        arith.percent_gap("l_quantity", "l_linenumber").alias("gap_pc"),
        arith.ratio("l_discount", "l_tax").alias("ratio"),
        arith.percent(F.col("l_quantity") - 25, "l_quantity").alias("residual_pc"),
    )
    return rounding.round_columns(lines, {"mid": 6, "gap_pc": 4, "ratio": 6})


@query(
    "truncate_int",
    """SELECT o_orderkey, CAST(trunc(o_totalprice / 7) AS BIGINT) AS up, CAST(trunc(-o_totalprice / 7) AS BIGINT) AS down
    FROM orders""",
)
def truncate_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.col("o_totalprice") / 7
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rounding.truncate_int(seventh).alias("up"), rounding.truncate_int(-seventh).alias("down")
    )


@query(
    "concat_label",
    """SELECT DISTINCT o_orderpriority || ' / ' || o_orderstatus AS ratio, 'y ~ ' || o_orderpriority || ' + ' || o_orderstatus AS call,
    o_orderpriority || ' + ' || o_orderstatus AS covariates FROM orders""",
)
def concat_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = labels.call_label("y", F.concat_ws(" + ", "o_orderpriority", "o_orderstatus"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            labels.ratio_label("o_orderpriority", "o_orderstatus").alias("ratio"),
            call.alias("call"),
            labels.covariates_of_call(call, "y").alias("covariates"),
        )
        .distinct()
    )


@query(
    "strict_mean_rounded",
    f"""SELECT l_suppkey, {rnd("CASE WHEN count(*) = count(CASE WHEN l_tax > 0.079 THEN NULL ELSE l_quantity END) THEN avg(l_quantity) END", 2)} AS mean_quantity
    FROM lineitem GROUP BY l_suppkey""",
)
def strict_mean_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("if(l_tax > 0.079, null, l_quantity)")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(round_half_even(nulls.strict_mean(value), 2).alias("mean_quantity"))
    )
