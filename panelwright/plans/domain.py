"""Queries: cubes, cohorts, adjusted measures, scenarios, projections, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import round_columns
from ..levels import REGION_LABELS
from ..operators import adjust, cohort, enrolment, ratios, scenario
from ..session import fresh_path
from ..sources import store
from . import panels, sqltext
from .panels import HORIZON
from .registry import query

rnd = sqltext.rnd

# ---- cubes and cohorts


@query("population_cube", f'WITH {sqltext.CUBE} SELECT "year", yr, state, age, erp, cohort FROM cube_')
def population_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.cube(spark, sf_dir)


@query("population_cube_refresh", f'WITH {sqltext.CUBE} SELECT "year", yr, state, age, erp, cohort FROM cube_')
def population_cube_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube stored up to 1998 with wrong last values, then revised and taken on: the same as one built at once."""
    obs = panels.observations(spark, sf_dir)
    yr, path = F.substring("time_period", 1, 4).cast("int"), fresh_path(spark, "cube")
    early = obs.where(yr <= 1998).withColumn("obs_value", F.when(yr == 1998, "-1").otherwise(F.col("obs_value")))
    store.store_cube(cohort.population_cube(early, first_cohort=panels.FIRST_COHORT), path)
    store.refresh_cube(spark, path, obs.where(yr.between(1998, 2000)), first_cohort=panels.FIRST_COHORT)
    store.refresh_cube(spark, path, obs.where(yr > 2000), first_cohort=panels.FIRST_COHORT)
    return store.stored_cube(spark, path)


_ERP_COLUMNS = ", ".join(f"max(erp) FILTER (age = {a}) AS erp{a}" for a in range(6))
COHORTS = f"""cohorts AS (
  SELECT cohort, state, CAST(cohort + 4 AS INTEGER) AS yr_in_erp4, {_ERP_COLUMNS}
  FROM cells WHERE age <= 5 GROUP BY cohort, state HAVING count(*) FILTER (age = 0) > 0)"""


@query("cohort_table", f"WITH {sqltext.CELLS}, {COHORTS} SELECT * FROM cohorts")
def cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_table(panels.cells(spark, sf_dir))


COHORT_LONG = f"""{COHORTS}, cohort_long AS (
  SELECT cohort, state, yr_in_erp4, CAST(substr(a, 4) AS INTEGER) AS age,
         CAST(cohort + CAST(substr(a, 4) AS INTEGER) AS INTEGER) AS yr, erp_at_age
  FROM cohorts UNPIVOT INCLUDE NULLS (erp_at_age FOR a IN (erp0, erp1, erp2, erp3, erp4, erp5)))"""


@query(
    "cohort_table_long",
    f"WITH {sqltext.CELLS}, {COHORT_LONG} SELECT cohort, state, yr_in_erp4, age, yr, erp_at_age FROM cohort_long",
)
def cohort_table_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_long(cohort.cohort_table(panels.cells(spark, sf_dir)))


@query(
    "ages_side_by_side",
    f"""WITH {sqltext.CUBE} SELECT * FROM (
      SELECT yr, state, max(erp) FILTER (age = 4) AS aged_4, max(erp) FILTER (age = 5) AS aged_5
      FROM cube_ WHERE age IN (4, 5) GROUP BY yr, state) WHERE aged_4 IS NOT NULL AND aged_5 IS NOT NULL""",
)
def ages_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.ages_side_by_side(panels.cube(spark, sf_dir), [4, 5], "aged_", complete_only=True)


@query("inverse_change_factors", f"WITH {sqltext.FACTORS} SELECT * FROM factors")
def inverse_change_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.inverse_change_factors(panels.cube(spark, sf_dir))


@query(
    "cohort_change_report",
    f"""WITH {sqltext.FACTORS}
    SELECT state, cohort, age_4, age_5, age_6, inv_chg_4_5, inv_chg_5_6,
           CASE WHEN cohort = 1996 THEN age_5 - age_4 ELSE 0 END AS chg_4_5,
           CASE WHEN cohort = 1995 THEN age_6 - age_5 ELSE 0 END AS chg_5_6
    FROM factors WHERE cohort IN (1995, 1996)""",
)
def cohort_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_change_report(cohort.inverse_change_factors(panels.cube(spark, sf_dir)), 1996, 1995)


# ---- enrolments and measures


@query(
    "enrolment_by_age",
    f"""WITH {sqltext.ENROL} SELECT "year", state, 'a Pre-Year 1 (Foundation Year)' AS grade,
    aged_5, aged_6, all_ages, total_5_6 FROM enrol""",
)
def enrolment_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrolment.enrolment_by_age(panels.school_counts(spark, sf_dir))


@query("age_fraction", f"WITH {sqltext.LAGGED} SELECT yr, state, orig_yr, val, p5, p6 FROM lagged")
def age_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.lagged_enrolments(spark, sf_dir)


@query(
    "migration_adjusted_denominator",
    f"""WITH {sqltext.ADJUSTED}
    SELECT yr, state, orig_yr, val, p5, p6, inv_chg_4_5, inv_chg_5_6, measure FROM adjusted""",
)
def migration_adjusted_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = cohort.inverse_change_factors(panels.cube(spark, sf_dir))
    return enrolment.migration_adjusted_denominator(panels.lagged_enrolments(spark, sf_dir), factors)


@query("measure_panel", f"WITH {sqltext.PANEL} SELECT yr, state, measure, erp_4, erp_5, enrol_lagged FROM panel")
def measure_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.measures(spark, sf_dir)


@query(
    "measure_panel_long",
    f"""WITH {sqltext.PANEL}
    SELECT yr, state, series, "number", make_date(CAST(yr AS BIGINT), 6, 30) AS "date"
    FROM (SELECT yr, state, enrol_lagged, measure, erp_4, erp_5 FROM panel WHERE yr > 1995)
    UNPIVOT INCLUDE NULLS ("number" FOR series IN (enrol_lagged, measure, erp_4, erp_5))""",
)
def measure_panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrolment.measure_panel_long(panels.measures(spark, sf_dir), after=1995)


# ---- adjustments

REBASED = f"""{sqltext.PANEL}, based AS (
  SELECT *, (erp_4 + erp_5) / 2 AS avg_4_5,
         (measure - (erp_4 + erp_5) / 2) / nullif((erp_4 + erp_5) / 2, 0) * 100 AS diff_pc
  FROM panel WHERE yr < 2001),
gaps AS (
  SELECT state, CASE WHEN count(diff_pc) FILTER (yr < 1998) = count(*) FILTER (yr < 1998)
                     THEN avg(diff_pc) FILTER (yr < 1998) END AS gap
  FROM based GROUP BY state),
rebased AS (
  SELECT b.*, g.gap,
         CASE WHEN yr < 1998 THEN measure - g.gap / 100 * measure WHEN yr = 1998 THEN measure END AS measure_adj
  FROM based b LEFT JOIN gaps g ON b.state = g.state)"""


def _rebase_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.measures(spark, sf_dir)


@query(
    "rebase_segment",
    f"""WITH {REBASED}
    SELECT yr, state, measure, erp_4, erp_5, avg_4_5, {rnd("gap", 4)} AS gap, {rnd("measure_adj", 4)} AS measure_adj,
           {rnd("CASE WHEN yr BETWEEN 1996 AND 1997 THEN measure_adj ELSE measure END", 4)} AS measure_new
    FROM rebased""",
)
def rebase_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebased = adjust.rebase_segment(_rebase_input(spark, sf_dir), ["state"], split=1998, first=1996, before=2001)
    kept = rebased.select(
        "yr", "state", "measure", "erp_4", "erp_5", "avg_4_5", "gap", "measure_adj", "measure_new"
    )
    return round_columns(kept, {"gap": 4, "measure_adj": 4, "measure_new": 4})


@query(
    "append_rebased_member",
    f"""WITH {REBASED}
    SELECT yr, state, measure, erp_4, erp_5, enrol_lagged FROM panel
    UNION ALL
    SELECT yr, 'SA (adj)', trunc(coalesce(CASE WHEN yr >= 1998 THEN measure END, measure_adj)),
           erp_4, erp_5, enrol_lagged FROM rebased WHERE state = 'SA'""",
)
def append_rebased_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.append_rebased_member(_rebase_input(spark, sf_dir), "SA", "SA (adj)", split=1998, before=2001)


_RULES = [
    ("NATION_1", 1995, 1996, "drop_first"),
    ("NATION_1", 1998, 1998, "smooth"),
    ("NATION_2", 1995, 2001, "smooth"),
    ("NATION_2", 1999, 1999, "drop_last"),
    ("NATION_4", 1997, 1998, "drop_first"),
]


REPAIRED = f"""{sqltext.MODEL}, first_ AS (
  SELECT *, CASE WHEN state = 'NATION_1' AND yr <= 1996 THEN NULL
                 WHEN state = 'NATION_4' AND yr IN (1997, 1998) THEN NULL ELSE measure END AS v FROM model_input),
mean_ AS (SELECT *, CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END AS m FROM first_
  WINDOW w AS (PARTITION BY state ORDER BY yr, assumption ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
repaired_rows AS (
  SELECT *, CASE WHEN state = 'NATION_2' AND yr = 1999 THEN NULL ELSE
    {rnd("CASE WHEN (state = 'NATION_1' AND yr = 1998) OR state = 'NATION_2' THEN m ELSE v END", 0)} END AS repaired
  FROM mean_)"""


def repair_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "state string, first int, last int, action string")


@query(
    "outlier_repair",
    f"WITH {REPAIRED} SELECT yr, state, assumption, measure, repaired FROM repaired_rows",
)
def outlier_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.model_input(spark, sf_dir).select("yr", "state", "assumption", "measure")
    return adjust.outlier_repair(rows, repair_rules(spark), "measure", ["state"], ["yr", "assumption"])


@query(
    "migration_merge",
    f"WITH {sqltext.LINES}, {sqltext.MIGRATION} SELECT yr, age_grp, state_code, nom, imig, net_mig_grp FROM migration",
)
def migration_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.migration(spark, sf_dir)


@query(
    "apportion_by_share",
    f"""WITH {sqltext.APPORTIONED}
    SELECT yr, state_code, age, age_grp, net_mig_sya, net_mig_grp, erp_sya, erp_grp, p FROM apportioned""",
)
def apportion_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.apportion_by_share(panels.single_ages(spark, sf_dir), panels.migration(spark, sf_dir))


@query(
    "revise_denominator",
    f"""WITH {sqltext.APPORTIONED}, {sqltext.LAGGED.replace(sqltext.LINES + ", ", "")}, moved AS (
      SELECT yr + 1 AS yr, {sqltext.case("state_code", {k: v for k, v in REGION_LABELS.items() if k in "AUS12345"})} AS state,
             net_mig_sya AS net_mig FROM apportioned WHERE age = 5)
    SELECT l.yr, l.state, l.val AS first_yr_sch, l.val - m.net_mig AS first_yr_sch_revised
    FROM lagged l LEFT JOIN moved m ON l.yr = m.yr AND l.state = m.state""",
)
def revise_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    apportioned = adjust.apportion_by_share(panels.single_ages(spark, sf_dir), panels.migration(spark, sf_dir))
    schools = panels.lagged_enrolments(spark, sf_dir).select("yr", "state", F.col("val").alias("first_yr_sch"))
    return adjust.revise_denominator(schools, apportioned, REGION_LABELS)


# ---- ratios


@query(
    "numerator_denominator_ratio",
    f"""WITH {sqltext.SERIES}
    SELECT d.yr, d.state, d.series, d."value", n.series AS numerator, n."value" AS n,
           {rnd('n."value" / nullif(d."value", 0) * 100', 1)} AS percent, n.series || ' / ' || d.series AS ratio
    FROM series_panel d JOIN series_panel n ON d.yr = n.yr AND d.state = n.state
    WHERE n.series IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def numerator_denominator_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.numerator_denominator_ratio(panels.series_panel(spark, sf_dir), ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "wide_ratio",
    f"""WITH {sqltext.PRIORITY}
    SELECT yr, state, urgent AS numerator, series, "value", {rnd('urgent / nullif("value", 0) * 100', 1)} AS percent,
           'urgent / ' || series AS ratio
    FROM (SELECT *, urgent AS u FROM priority_panel)
    UNPIVOT INCLUDE NULLS ("value" FOR series IN (high, medium, not_specified, low))""",
)
def wide_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = ["high", "medium", "not_specified", "low"]
    return ratios.wide_ratio(panels.priority_panel(spark, sf_dir), ["yr", "state"], series, "urgent")


@query(
    "stacked_ratios",
    f"""WITH {sqltext.MODEL}, tall AS (
      SELECT * FROM (SELECT yr, state, assumption, numerator, numerator45, erp_3yr, erp_4yr, erp_5yr FROM model_input)
      UNPIVOT INCLUDE NULLS ("value" FOR series IN (erp_3yr, erp_4yr, erp_5yr)))
    SELECT *, 'All / ' || series AS ratio, {rnd('numerator / nullif("value", 0) * 100', 1)} AS percent FROM tall
    UNION ALL
    SELECT *, 'Ages 4-5 / ' || series, {rnd('numerator45 / nullif("value", 0) * 100', 1)} FROM tall""",
)
def stacked_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reshape import pivot_longer

    ids = ["yr", "state", "assumption", "numerator", "numerator45"]
    tall = pivot_longer(panels.model_input(spark, sf_dir), ids, ["erp_3yr", "erp_4yr", "erp_5yr"], "series", "value")
    return ratios.stacked_ratios(tall, {"numerator": "All", "numerator45": "Ages 4-5"})


@query(
    "out_of_state_adjust",
    f"""WITH {sqltext.PRIORITY}, away AS (
      SELECT yr, {sqltext.case("r_name", panels.REGION_COLUMNS)} AS state, count(*) AS child_oth_state
      FROM order_rows WHERE o_orderstatus = 'P' GROUP BY yr, r_name)
    SELECT s.yr, s.state, s.series,
           CASE WHEN s.series = '1-URGENT' THEN s."value" - coalesce(a.child_oth_state, 0) ELSE s."value" END AS "value"
    FROM series_panel s LEFT JOIN away a ON s.yr = a.yr AND s.state = a.state""",
)
def out_of_state_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.labels import recode
    from ..operators.joins import subtract_from_series

    counts = panels.orders_per_nation(spark, sf_dir, {"yr": F.year("o_orderdate"), "status": F.col("o_orderstatus")})
    regions = panels.table(spark, sf_dir, "region")
    away = (
        counts.where("status = 'P'")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("yr", recode("r_name", panels.REGION_COLUMNS).alias("state"))
        .agg(F.sum("n").cast("double").alias("child_oth_state"))
    )
    return subtract_from_series(
        panels.series_panel(spark, sf_dir), "series", "1-URGENT", "value", away, ["yr", "state"], "child_oth_state"
    )


# ---- scenarios and projections


def _mean(c: str, keep: str) -> str:
    return rnd(f"avg({c}) FILTER ({keep})", 5)


RATES = f"""rates AS (
  SELECT state, age, {_mean("p_chg", "yr > 2000")} AS recent, {_mean("p_chg * 0.5", "yr > 2000")} AS recent_half,
         {_mean("p_chg", "yr > 1996 AND yr < 2000")} AS usual, {_mean("p_chg * 0.5", "yr > 1996 AND yr < 2000")} AS usual_half
  FROM changes GROUP BY state, age HAVING count(*) FILTER (yr > 2000) > 0),
signs AS (
  SELECT state, CASE WHEN {rnd("100 * sum(chg) / sum(erp)", 1)} > 0 THEN 'pos' ELSE 'neg' END AS sign
  FROM changes WHERE yr = 2001 GROUP BY state),
scen_a AS (SELECT state, age, recent AS "A_2002", recent_half AS "A_2003", usual AS "A_2004", usual AS "A_2005" FROM rates),
scen_b AS (
  SELECT r.state, r.age, recent AS "B_2002", CASE sign WHEN 'neg' THEN recent_half WHEN 'pos' THEN usual_half END AS "B_2003",
         usual AS "B_2004", usual AS "B_2005"
  FROM rates r LEFT JOIN signs s ON r.state = s.state),
scen AS (
  SELECT state, age, substr(nm, 1, 1) AS scenario, CAST(substr(nm, 3, 4) AS INTEGER) AS yr, rate FROM (
    SELECT * FROM scen_a UNPIVOT INCLUDE NULLS (rate FOR nm IN ("A_2002", "A_2003", "A_2004", "A_2005"))
    UNION ALL
    SELECT * FROM scen_b UNPIVOT INCLUDE NULLS (rate FOR nm IN ("B_2002", "B_2003", "B_2004", "B_2005"))))"""


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = panels.changes(spark, sf_dir)
    return scenario.scenario_long(
        scenario.scenario_rates_a(changes, HORIZON), scenario.scenario_rates_b(changes, HORIZON)
    )


@query("scenario_rates_a", f"WITH {sqltext.CHANGES}, {RATES} SELECT * FROM scen_a")
def scenario_rates_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.scenario_rates_a(panels.changes(spark, sf_dir), HORIZON)


@query("scenario_rates_b", f"WITH {sqltext.CHANGES}, {RATES} SELECT * FROM scen_b")
def scenario_rates_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.scenario_rates_b(panels.changes(spark, sf_dir), HORIZON)


@query(
    "scenario_long",
    f"""WITH {sqltext.CHANGES}, {RATES}
    SELECT state, age, scenario, yr, rate, {rnd("rate * 100", 2)} AS percent,
           {sqltext.case("age", {i: f"{i - 1} to {i} yr" for i in range(1, 7)})} AS age_turn FROM scen""",
)
def scenario_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenarios(spark, sf_dir)


def _step(a: int, s: str) -> str:
    """Value at age a under scenario s, and the length of the run of filled ages."""
    prior, run = f"{s}{a - 1}", f"run{a - 1}"
    return f"coalesce(k{a}, CASE WHEN {run} < 4 THEN {prior} + {prior} * r{s}{a} END) AS {s}{a}"


def _projected() -> str:
    cells = ", ".join(
        f"max(erp_at_age) FILTER (age = {a}) AS k{a}, max(rate_a) FILTER (age = {a}) AS ra{a}, max(rate_b) FILTER (age = {a}) AS rb{a}"
        for a in range(6)
    )
    out = f"""joined AS (
      SELECT c.cohort, c.state, c.age, c.erp_at_age, a.rate AS rate_a, b.rate AS rate_b FROM cohort_long c
      LEFT JOIN scen a ON a.scenario = 'A' AND c.state = a.state AND c.yr = a.yr AND c.age = a.age
      LEFT JOIN scen b ON b.scenario = 'B' AND c.state = b.state AND c.yr = b.yr AND c.age = b.age),
    s0 AS (SELECT *, k0 AS a0, k0 AS b0, 0 AS run0 FROM (SELECT cohort, state, {cells} FROM joined GROUP BY cohort, state))"""
    for a in range(1, 6):
        out += f""", s{a} AS (SELECT *, {_step(a, "a")}, {_step(a, "b")},
          CASE WHEN k{a} IS NOT NULL THEN 0 ELSE run{a - 1} + 1 END AS run{a} FROM s{a - 1})"""
    parts = " UNION ALL ".join(
        f"""SELECT cohort, state, {a} AS age, CAST(cohort + {a} AS INTEGER) AS yr, k{a} AS erp_at_age,
        CAST(trunc(a{a}) AS BIGINT) AS erp_a, CAST(trunc(b{a}) AS BIGINT) AS erp_b FROM s5"""
        for a in range(6)
    )
    return f"{out}, projected AS (SELECT * FROM ({parts}) WHERE yr < 2006)"


PROJECTED = f"{sqltext.CHANGES}, {RATES}, {COHORT_LONG}, {_projected()}"


@query(
    "project_cohorts",
    f"WITH {PROJECTED} SELECT cohort, state, age, yr, erp_at_age, erp_a, erp_b FROM projected",
)
def project_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.project_cohorts(
        cohort_table_long(spark, sf_dir), _scenarios(spark, sf_dir), last_year=2005
    )


PROJECTION = f"""{PROJECTED}, by_age AS (
  SELECT yr, state, assumption,
         max(erp) FILTER (age = 5) AS erp_5yr, max(erp) FILTER (age = 4) AS erp_4yr
  FROM (SELECT yr, state, age, 'ERP_A' AS assumption, erp_a AS erp FROM projected
        UNION ALL SELECT yr, state, age, 'ERP_B', erp_b FROM projected)
  WHERE yr > 1996 AND age IN (4, 5) GROUP BY yr, state, assumption HAVING count(*) FILTER (age = 5) > 0),
merged AS (SELECT DISTINCT yr, state, CASE WHEN yr < 2002 THEN 'NA' ELSE assumption END AS assumption, erp_5yr, erp_4yr FROM by_age)"""


@query(
    "projection_by_age",
    f"""WITH {PROJECTION}
    SELECT yr, state, assumption, erp_5yr, erp_4yr FROM merged
    UNION ALL SELECT yr, state, 'NA', erp_5yr, erp_4yr FROM merged WHERE yr = 2002""",
)
def projection_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.projection_by_age(project_cohorts(spark, sf_dir), first_year=1997, latest=2001)


@query(
    "seed_new_cohort",
    f"""WITH {sqltext.CELLS}
    SELECT state, CAST(2002 AS INTEGER) AS yr, CAST(0 AS INTEGER) AS age, {rnd("avg(erp)", 4)} AS erp, CAST(2002 AS INTEGER) AS cohort
    FROM cells WHERE age = 0 AND yr BETWEEN 1999 AND 2001 GROUP BY state""",
)
def seed_new_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(scenario.seed_new_cohort(panels.cells(spark, sf_dir), 2002), {"erp": 4})


@query(
    "scaled_rates",
    f"""WITH {sqltext.CHANGES}, m AS (SELECT state, age, avg(p_chg) AS u FROM changes WHERE yr BETWEEN 1997 AND 1999 GROUP BY state, age)
    SELECT state, age, scenario, {rnd("u * share", 5)} AS rate
    FROM m, (VALUES ('Zero', 0.0::DOUBLE), ('Med', 0.5::DOUBLE), ('High', 1.0::DOUBLE)) t(scenario, share)""",
)
def scaled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.scaled_rates(panels.changes(spark, sf_dir), HORIZON)


def _scaled_projection_sql() -> str:
    names = ("zero", "med", "high")
    steps = ""
    cells = ", ".join(
        [f"max(erp_at_age) FILTER (age = {a}) AS k{a}" for a in range(6)]
        + [f"max(rate_{s}) FILTER (age = {a}) AS r{s}{a}" for s in names for a in range(6)]
    )
    start = ", ".join(f"k0 AS {s}0" for s in names)
    joins = " ".join(
        f"LEFT JOIN scaled {s} ON {s}.scenario = '{s.title()}' AND c.state = {s}.state AND c.yr = {s}.yr AND c.age = {s}.age" for s in names
    )
    for a in range(1, 6):
        grown = ", ".join(
            f"coalesce(k{a}, CASE WHEN run{a - 1} < 4 THEN {s}{a - 1} + {s}{a - 1} * r{s}{a} END) AS {s}{a}" for s in names
        )
        steps += f", p{a} AS (SELECT *, {grown}, CASE WHEN k{a} IS NOT NULL THEN 0 ELSE run{a - 1} + 1 END AS run{a} FROM p{a - 1})"
    parts = " UNION ALL ".join(
        f"SELECT cohort, state, {a} AS age, CAST(cohort + {a} AS INTEGER) AS yr, k{a} AS erp_at_age, "
        + ", ".join(f"CAST(trunc({s}{a}) AS BIGINT) AS erp_{s}" for s in names)
        + " FROM p5"
        for a in range(6)
    )
    seeded = COHORT_LONG.replace("FROM cells", "FROM seeded")
    return f"""WITH {sqltext.CHANGES}, seeded AS (
      SELECT state, yr, age, erp, cohort FROM cells UNION ALL
      SELECT state, 2002, 0, avg(erp), 2002 FROM cells WHERE age = 0 AND yr BETWEEN 1999 AND 2001 GROUP BY state),
    usual AS (SELECT state, age, avg(p_chg) AS u FROM changes WHERE yr BETWEEN 1997 AND 1999 GROUP BY state, age),
    scaled AS (
      SELECT state, age, scenario, yr, {rnd("u * share", 5)} AS rate FROM usual,
      (VALUES ('Zero', 0.0::DOUBLE), ('Med', 0.5::DOUBLE), ('High', 1.0::DOUBLE)) t(scenario, share), (VALUES (2002), (2003), (2004), (2005)) y(yr)),
    {seeded}, j AS (SELECT c.cohort, c.state, c.age, c.erp_at_age, {", ".join(f"{s}.rate AS rate_{s}" for s in names)} FROM cohort_long c {joins}),
    p0 AS (SELECT *, {start}, 0 AS run0 FROM (SELECT cohort, state, {cells} FROM j GROUP BY cohort, state)){steps}
    SELECT * FROM ({parts}) WHERE yr <= 2005"""


@query("scenario_projection", _scaled_projection_sql())
def scenario_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeded = scenario.with_new_cohort(panels.cells(spark, sf_dir), 2002)
    rates = scenario.scaled_rates(panels.changes(spark, sf_dir), HORIZON, years=[2002, 2003, 2004, 2005])
    long = cohort.cohort_long(cohort.cohort_table(seeded))
    return scenario.project_cohorts(long, rates, scenarios=("Zero", "Med", "High"), last_year=2005)


def _member_sum_sql() -> str:
    labels = ("Zero", "Med", "High")
    cells = ", ".join(
        f"max({m}) FILTER (assumption = '{s}') AS {m}_{s.lower()}" for s in labels for m in scenario.RANGE_MEASURES
    )
    return f"""WITH {sqltext.MODEL}, fitted AS (
      SELECT DISTINCT yr, state, assumption, erp_4yr, erp_5yr AS fitted, erp_5yr - erp_3yr AS "lower", erp_5yr + erp_3yr AS "upper"
      FROM model_input),
    cloned AS (
      SELECT yr, state, t.s AS assumption, erp_4yr, fitted, "lower", "upper"
      FROM fitted, (VALUES ('Zero'), ('Med'), ('High')) t(s) WHERE assumption = 'N.A.' OR assumption = t.s),
    stacked AS (
      SELECT * FROM cloned UNION ALL
      SELECT yr, 'Aust', assumption, {", ".join(sqltext.strict_sum(m) for m in ("erp_4yr", "fitted", '"lower"', '"upper"'))} FROM cloned GROUP BY yr, assumption)
    SELECT yr, state, {cells} FROM stacked GROUP BY yr, state"""


@query("member_sum_projection", _member_sum_sql())
def member_sum_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.model_input(spark, sf_dir).select(
        "yr",
        "state",
        "assumption",
        "erp_4yr",
        F.col("erp_5yr").alias("fitted"),
        (F.col("erp_5yr") - F.col("erp_3yr")).alias("lower"),
        (F.col("erp_5yr") + F.col("erp_3yr")).alias("upper"),
    )
    return scenario.member_sum_projection(rows)
