"""Queries: sources and sinks, projection and filters, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import null_where
from ..functions.rounding import round_columns
from ..operators import joins, ratios, regression, select
from ..session import fresh_path
from ..sources import observations as feeds
from ..sources import store, tables
from . import panels, sqltext
from .panels import table
from .registry import query

# ---- sources and sinks


@query("read_sdmx_obs", f"WITH {sqltext.OBS} SELECT age, sex, region, time_period, obs_value FROM obs")
def read_sdmx_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = panels.observations(spark, sf_dir)
    dims = {"age": "AGE", "sex": "SEX", "region": "REGION", "time_period": "TIME_PERIOD"}
    path = fresh_path(spark, "observations")
    feeds.write_flat_observations(obs, path, dims)
    return feeds.read_flat_observations(spark, path, {v: k for k, v in dims.items()})


OBS_SQL = f"WITH {sqltext.OBS} SELECT age, sex, region, time_period, obs_value FROM obs"
OBS_IDS = {"age": "AGE", "sex": "SEX", "region": "REGION", "time_period": "TIME_PERIOD"}


def _read_any_layout(spark: SparkSession, path: str) -> DataFrame:
    return feeds.read_observations(spark, path, {v: k for k, v in OBS_IDS.items()})


@query("read_sdmx_obs_full", OBS_SQL)
def read_sdmx_obs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "observations")
    feeds.write_flat_observations(panels.observations(spark, sf_dir), path, OBS_IDS)
    return _read_any_layout(spark, path)


@query("read_sdmx_obs_series", OBS_SQL)
def read_sdmx_obs_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "observations")
    feeds.write_series_observations(panels.observations(spark, sf_dir), path, OBS_IDS, "time_period")
    return _read_any_layout(spark, path)


@query("read_sdmx_obs_compact", OBS_SQL)
def read_sdmx_obs_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "observations")
    feeds.write_compact_observations(panels.observations(spark, sf_dir), path, OBS_IDS)
    return _read_any_layout(spark, path)


@query(
    "read_panel_table",
    f"""WITH {sqltext.MODEL}
    SELECT yr, state, assumption, measure AS outcome, erp_3yr, erp_4yr, erp_5yr, numerator45 FROM model_input""",
)
def read_panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "panel")
    tables.write_text_table(panels.model_input(spark, sf_dir), path)
    schema = (
        "yr int, state string, assumption string, measure double, erp_3yr double, erp_4yr double, "
        "erp_5yr double, numerator double, numerator45 double"
    )
    return tables.read_panel_table(spark, path, schema, {"measure": "outcome"}, drop=["numerator"])


SHEET_NOTES = ["Panel of members and years", "Source: driver tables", "", "Table 1"]
SHEET_SCHEMA = "yr int, state string, assumption string, measure double, erp_3yr double, erp_4yr double, erp_5yr double, numerator double, numerator45 double"


@query(
    "read_panel_range",
    f"""WITH {sqltext.MODEL}
    SELECT yr, state, assumption, measure AS outcome, erp_3yr, erp_4yr, erp_5yr, numerator45 FROM model_input""",
)
def read_panel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tables under four lines of notes, a file for each partition."""
    path = fresh_path(spark, "sheets")
    tables.write_sheets(panels.model_input(spark, sf_dir), path, SHEET_NOTES)
    return tables.read_panel_range(spark, path, SHEET_SCHEMA, "A5:I", {"measure": "outcome"}, drop=["numerator"])


@query(
    "read_panel_range_bounded",
    f"""WITH {sqltext.MODEL}
    SELECT state, assumption, measure FROM (
      SELECT *, row_number() OVER (ORDER BY state, yr, assumption) AS line FROM model_input)
    WHERE line <= 55""",
)
def read_panel_range_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns and 55 rows of one sheet; the panel's rows are members x years x scenarios, few enough for a sheet."""
    path = fresh_path(spark, "sheet")
    sheet = panels.model_input(spark, sf_dir).repartition(1).sortWithinPartitions("state", "yr", "assumption")
    tables.write_sheets(sheet, path, SHEET_NOTES)
    return tables.read_panel_range(spark, path, "state string, assumption string, measure double", "B5:D60")


@query(
    "write_panel_tables",
    f"""WITH {sqltext.MODEL}, {sqltext.SERIES}
    SELECT 'model_input' AS table_name, count(*) AS n_rows, count(measure) AS n_values FROM model_input
    UNION ALL SELECT 'series', count(*), count("value") FROM series_panel""",
)
def write_panel_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"model_input": panels.model_input(spark, sf_dir), "series": panels.series_panel(spark, sf_dir)}
    paths = tables.write_panel_tables(named, fresh_path(spark, "tables"), {"series": ["series"]})
    counts = None
    for (name, _), path, value in zip(named.items(), paths, ("measure", "value")):
        one = spark.read.parquet(path).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values")
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def _published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a set that was published twice, read through the newest manifest."""
    folder = fresh_path(spark, "published")
    named = {"model_input": panels.model_input(spark, sf_dir), "series": panels.series_panel(spark, sf_dir)}
    store.publish_tables({k: df.limit(0) for k, df in named.items()}, folder)
    store.publish_tables(named, folder, {"series": store.Layout(("series",))})
    return store.published_tables(spark, folder)[name]


@query("write_panel_tables_model_input", f"WITH {sqltext.MODEL} SELECT * FROM model_input")
def write_panel_tables_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "model_input")


@query("write_panel_tables_series", f'WITH {sqltext.SERIES} SELECT yr, state, series, "value" FROM series_panel')
def write_panel_tables_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "series")


# ---- projection and filters


@query(
    "select_rename",
    "SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem",
)
def select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"l_orderkey": "order_id", "l_linenumber": "line", "l_quantity": "quantity"}
    return select.select_rename(table(spark, sf_dir, "lineitem"), columns)


@query(
    "filter_predicate",
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_quantity > 25""",
)
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = F.col("l_shipdate")
    inside = (shipped >= F.expr("timestamp_ntz '1997-01-01'")) & (shipped < F.expr("timestamp_ntz '1999-01-01'"))
    lines = table(spark, sf_dir, "lineitem").where(inside & (F.col("l_quantity") > 25))
    return lines.select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "filter_in",
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    builders = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = select.filter_in(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return select.filter_in(orders, "o_custkey", builders).select("o_orderkey", "o_orderpriority")


@query(
    "filter_not_in",
    """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
    WHERE (nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') NOT IN ('F'))
      AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey = o_custkey)""",
)
def filter_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    machinery = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    kept = select.filter_not_in(select.filter_not_in(orders, "status", ["F"]), "o_custkey", machinery)
    return kept.select("o_orderkey", "status")


@query(
    "drop_na",
    f"""WITH {sqltext.MODEL} SELECT yr, state, assumption, measure, erp_4yr FROM model_input
    WHERE measure IS NOT NULL AND erp_4yr IS NOT NULL""",
)
def drop_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.model_input(spark, sf_dir).select("yr", "state", "assumption", "measure", "erp_4yr")
    return select.drop_incomplete(panel)


RATIOS_SQL = f"""{sqltext.SERIES}, ratios AS (
  SELECT d.yr, d.state, d.series, d."value", n.series AS numerator, n."value" AS n,
         {sqltext.rnd('n."value" / nullif(d."value", 0) * 100', 1)} AS percent,
         n.series || ' / ' || d.series AS ratio
  FROM series_panel d JOIN series_panel n ON d.yr = n.yr AND d.state = n.state
  WHERE n.series IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"""

NUMERATORS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(
    "selection_view",
    f"""WITH {RATIOS_SQL}
    SELECT DISTINCT yr AS "year", state, numerator, n AS num_value, series AS denominator, "value" AS denom_value, percent
    FROM ratios
    WHERE state IN ('africa', 'asia', 'europe') AND yr BETWEEN 1996 AND 2000
      AND ratio IN ('1-URGENT / 5-LOW', '2-HIGH / 4-NOT SPECIFIED') AND percent IS NOT NULL""",
)
def selection_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {
        "yr": "year",
        "state": "state",
        "numerator": "numerator",
        "n": "num_value",
        "series": "denominator",
        "value": "denom_value",
        "percent": "percent",
    }
    return select.selection_view(
        ratios.numerator_denominator_ratio(panels.series_panel(spark, sf_dir), NUMERATORS),
        members=["africa", "asia", "europe"],
        period_range=(1996, 2000),
        ratios=["1-URGENT / 5-LOW", "2-HIGH / 4-NOT SPECIFIED"],
        columns=shown,
    )


@query(
    "selection_view_scenario",
    f"""WITH {sqltext.MODEL}
    SELECT DISTINCT yr, state, erp_4yr, measure FROM model_input
    WHERE assumption IN ('N.A.', 'Med') AND state NOT IN ('NATION_3') AND yr IN (1998, 1999, 2000)
      AND measure IS NOT NULL AND erp_4yr IS NOT NULL""",
)
def selection_view_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.selection_view(
        panels.model_input(spark, sf_dir),
        periods=[1998, 1999, 2000],
        scenario="Med",
        exclude_members=["NATION_3"],
        columns={c: c for c in ("yr", "state", "erp_4yr", "measure")},
    )


STORED = store.Layout(("yr",), ("state",), 4)


def stored_series(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The series panel and its periods as stored tables: folders by year, buckets by member."""
    folder = fresh_path(spark, "panels")
    panel = panels.series_panel(spark, sf_dir)
    periods = panel.select("yr", F.when(F.col("yr") % 2 == 0, "even").otherwise("odd").alias("kind")).distinct()
    store.publish_tables({"series": panel, "periods": periods}, folder, {"series": STORED})
    return store.published_tables(spark, folder)


STORED_SQL = f"""WITH {RATIOS_SQL}
    SELECT DISTINCT yr AS "year", state, numerator, n AS num_value, series AS denominator, "value" AS denom_value, percent
    FROM ratios WHERE state IN ('africa', 'asia', 'europe') AND percent IS NOT NULL AND """

SHOWN = {"yr": "year", "state": "state", "numerator": "numerator", "n": "num_value", "series": "denominator", "value": "denom_value", "percent": "percent"}


@query("selection_view_stored", STORED_SQL + "yr BETWEEN 1996 AND 2000")
def selection_view_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window and distinct along the buckets of the stored panel, from its folders 1996 to 2000."""
    fanned = ratios.stored_ratio(stored_series(spark, sf_dir)["series"], NUMERATORS)
    return select.selection_view(fanned, members=["africa", "asia", "europe"], period_range=(1996, 2000), columns=SHOWN)


@query("selection_view_periods", STORED_SQL + "yr % 2 = 0")
def selection_view_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the periods that another table names: folders are pruned at run time."""
    found = stored_series(spark, sf_dir)
    fanned = ratios.stored_ratio(found["series"], NUMERATORS)
    periods = found["periods"].where("kind = 'even'").select("yr")
    return select.selection_view(fanned, members=["africa", "asia", "europe"], periods=periods, columns=SHOWN)


@query("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.distinct_values(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "period_bounds",
    "SELECT min(l_shipdate) AS first_period, max(l_shipdate) AS last_period FROM lineitem",
)
def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.period_bounds(table(spark, sf_dir, "lineitem"), "l_shipdate")


# ---- joins


@query(
    "left_join_keys",
    """SELECT o.o_orderkey, o.o_custkey AS custkey, c.c_mktsegment FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0""",
)
def left_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    # Customers in debt lose their key, so some orders have no partner.
    key = null_where("c_custkey", F.col("c_acctbal") <= 0).alias("custkey")
    return joins.left_join(orders, table(spark, sf_dir, "customer").select(key, "c_mktsegment"), ["custkey"])


@query(
    "left_join_renamed",
    """SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""",
)
def left_join_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = null_where("o_orderkey", F.col("o_orderstatus") == "P").alias("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key, "o_orderpriority")
    return joins.left_join(lines, orders, {"l_orderkey": "o_orderkey"})


@query(
    "right_join_keys",
    f"""WITH {sqltext.CHANGES}
    SELECT c.state, c.yr, c.age, h.chg, c.erp FROM changes h
    RIGHT JOIN cells c ON h.state = c.state AND h.yr = c.yr AND h.age = c.age""",
)
def right_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = panels.changes(spark, sf_dir).select("state", "yr", "age", "chg")
    cells = panels.cells(spark, sf_dir).select("state", "yr", "age", "erp")
    return joins.right_join(changes, cells, ["state", "yr", "age"])


@query(
    "full_join_keys",
    f"""WITH {sqltext.LINES}, {sqltext.ORDERS},
    shipped AS (SELECT n_name AS state, yr, sum(l_quantity) AS quantity FROM lines GROUP BY n_name, yr),
    ordered AS (SELECT n_name AS state, yr, count(*) AS n_orders FROM order_rows GROUP BY n_name, yr)
    SELECT coalesce(s.state, o.state) AS state, coalesce(s.yr, o.yr) AS yr, quantity, n_orders
    FROM shipped s FULL JOIN ordered o ON s.state = o.state AND s.yr = o.yr""",
)
def full_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = panels.per_nation(spark, sf_dir, {"yr": panels.ship_year()}, {"quantity": F.col("l_quantity")})
    ordered = panels.orders_per_nation(spark, sf_dir, {"yr": F.year("o_orderdate")})
    return joins.full_join(
        shipped.select(F.col("n_name").alias("state"), "yr", "quantity"),
        ordered.select(F.col("n_name").alias("state"), "yr", F.col("n").alias("n_orders")),
        ["state", "yr"],
    )


@query(
    "fanout_ratio_join",
    f"""WITH {RATIOS_SQL} SELECT yr, state, series, "value", numerator, n FROM ratios""",
)
def fanout_ratio_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.fanout_ratio_join(panels.series_panel(spark, sf_dir), NUMERATORS)


@query(
    "lagged_self_join",
    f"""WITH {sqltext.LINES}, totals AS (SELECT n_name AS state, yr, sum(l_quantity) AS erp FROM lines GROUP BY n_name, yr)
    SELECT a.state, a.yr, a.erp, b.erp AS erp_before FROM totals a
    LEFT JOIN totals b ON a.state = b.state AND a.yr = b.yr + 1""",
)
def lagged_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = panels.per_nation(spark, sf_dir, {"yr": panels.ship_year()}, {"erp": F.col("l_quantity")})
    totals = sums.select(F.col("n_name").alias("state"), "yr", "erp")
    return joins.lagged_join(totals, totals.withColumnRenamed("erp", "erp_before"), "yr", ["state"])


@query(
    "restrict_own_group",
    f"""WITH fits AS (
      SELECT l_returnflag, l_linestatus, regr_slope(l_extendedprice, l_quantity) AS b,
             regr_intercept(l_extendedprice, l_quantity) AS a
      FROM lineitem GROUP BY l_returnflag, l_linestatus)
    SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
           {sqltext.rnd("f.a + f.b * l.l_quantity", 2)} AS fitted
    FROM lineitem l JOIN fits f ON l.l_returnflag = f.l_returnflag AND l.l_linestatus = f.l_linestatus""",
)
def restrict_own_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *keys, "l_quantity", "l_extendedprice")
    models = [regression.Model("price", ("l_quantity",))]
    fits = regression.fit_linear(lines, keys, "l_extendedprice", models)
    fitted = regression.augment(lines, fits, models, level=None)
    return round_columns(fitted.select("l_orderkey", "l_linenumber", *keys, "fitted"), {"fitted": 2})


@query(
    "replace_series",
    f"""WITH {sqltext.SERIES}, moved AS (
      SELECT yr, {sqltext.case("r_name", panels.REGION_COLUMNS)} AS state, count(*) AS amount
      FROM order_rows WHERE o_orderstatus = 'P' GROUP BY yr, r_name)
    SELECT s.yr, s.state, s.series,
           CASE WHEN s.series = '5-LOW' THEN s."value" - coalesce(m.amount, 0) ELSE s."value" END AS "value"
    FROM series_panel s LEFT JOIN moved m ON s.yr = m.yr AND s.state = m.state""",
)
def replace_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.labels import recode

    counts = panels.orders_per_nation(spark, sf_dir, {"yr": F.year("o_orderdate"), "status": F.col("o_orderstatus")})
    regions = table(spark, sf_dir, "region")
    moved = (
        counts.where("status = 'P'")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("yr", recode("r_name", panels.REGION_COLUMNS).alias("state"))
        .agg(F.sum("n").cast("double").alias("amount"))
    )
    panel = panels.series_panel(spark, sf_dir)
    return joins.subtract_from_series(panel, "series", "5-LOW", "value", moved, ["yr", "state"], "amount")
