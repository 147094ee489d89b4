"""Queries: the three batches on the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.rounding import round_columns
from ..operators.regression import Model
from ..operators.scenario import RANGE_MEASURES
from . import batches, domain, models, panels, sqltext
from .registry import query

rnd = sqltext.rnd

# Region cells take the place of the nation cells in the projection.
REGION_CELLS = f"{sqltext.CUBE}, cells AS (SELECT state, yr, age, erp, cohort FROM cube_), {sqltext.CHANGES_STEP}"
REGION_PROJECTION = domain.PROJECTION.replace(sqltext.CHANGES, REGION_CELLS)
PROJECTION_TABLE = f"""{REGION_PROJECTION}, projection AS (
  SELECT yr, state, assumption, erp_5yr, erp_4yr FROM merged
  UNION ALL SELECT yr, state, 'NA', erp_5yr, erp_4yr FROM merged WHERE yr = 2002)"""


def _projection(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return batches.projection_batch(
        panels.observations(spark, sf_dir),
        panels.HORIZON,
        first_cohort=panels.FIRST_COHORT,
        growth_from_cohort=panels.FIRST_COHORT,
        shown_from=1997,
    )


@query("projection_batch", f"WITH {PROJECTION_TABLE} SELECT yr, state, assumption, erp_5yr, erp_4yr FROM projection")
def projection_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir)["projection_4_5"]


_PROJECTION_TABLES = {
    "cohorts_to_project": "SELECT * FROM cohorts",
    "cohort_growth": f"""SELECT state, yr, sum(chg) AS chg, {rnd("100 * sum(chg) / sum(erp)", 1)} AS chg_p FROM changes GROUP BY state, yr""",
    "cohort_rates": f"""SELECT CAST(yr AS VARCHAR) AS "year", yr, state, age, erp, cohort, chg, p_chg,
        {sqltext.case("age", {i: f"{i - 1} to {i} yr" for i in range(1, 7)})} AS age_turn, {rnd("p_chg * 100", 2)} AS percent
        FROM changes WHERE yr <> cohort AND yr > 1991""",
    "cohort_assumptions": f"""SELECT state, age, scenario, yr, rate, {rnd("rate * 100", 2)} AS percent,
        {sqltext.case("age", {i: f"{i - 1} to {i} yr" for i in range(1, 7)})} AS age_turn FROM scen""",
    "population_and_projection": "SELECT cohort, state, age, yr, erp_at_age, erp_a, erp_b FROM projected",
}


def _register_projection_tables() -> None:
    """One query for each further table of the projection batch."""
    for name, sql in _PROJECTION_TABLES.items():

        def of(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
            return _projection(spark, sf_dir)[name]

        query(f"projection_batch_{name}", f"WITH {REGION_PROJECTION} {sql}")(of)


_register_projection_tables()


_MEASURE_MODELS = [
    Model("ERP 4yrs", ("erp_4",)),
    Model("ERP 5yrs", ("erp_5",)),
    Model("ERP 4yrs + 5yrs", ("erp_4", "erp_5")),
]


_PREPARED_X = "(CASE b.model WHEN 'ERP 5yrs' THEN n.erp_5 ELSE n.erp_4 END)"


def _preparation_ctes() -> str:
    """The batch up to the fitted values of the best models, ``applied``."""
    # The panel's parts are already there after the projection's own.
    panel = domain.REBASED.removeprefix(sqltext.CUBE + ", ")
    x1 = _PREPARED_X
    return f"""{PROJECTION_TABLE}, {panel},
    panel2 AS (
      SELECT yr, state, measure, erp_4, erp_5 FROM panel
      UNION ALL SELECT yr, 'SA (adj)', trunc(coalesce(CASE WHEN yr >= 1998 THEN measure END, measure_adj)), erp_4, erp_5
      FROM rebased WHERE state = 'SA'),
    training AS (SELECT * FROM panel2 WHERE yr <> 2001),
    {models.fits_sql("training", "state", "measure", _MEASURE_MODELS)},
    newdat AS (
      SELECT yr, s AS state, CASE assumption WHEN 'NA' THEN 'N.A.' ELSE assumption END AS assumption, erp_4yr AS erp_4, erp_5yr AS erp_5
      FROM (SELECT *, state AS s FROM projection UNION ALL SELECT *, 'SA (adj)' FROM projection WHERE state = 'SA')),
    applied AS (
      SELECT n.yr, n.state, n.assumption, n.erp_4, n.erp_5, p.measure, b.model, b0 + b1 * {x1} + CASE WHEN k = 2 THEN b2 * n.erp_5 ELSE 0 END AS fitted,
             sigma * sqrt({models.leverage(x1, "n.erp_5")}) AS se
      FROM newdat n JOIN best b ON n.state = b.state LEFT JOIN panel2 p ON n.yr = p.yr AND n.state = p.state)"""


def _preparation_sql(skip: str = "ERP_B") -> str:
    return f"""WITH {_preparation_ctes()},
    bands AS (SELECT *, {rnd("measure - fitted", 0)} AS res FROM applied WHERE assumption <> '{skip}')
    SELECT DISTINCT state, yr, erp_4, erp_5, measure, {rnd("fitted", 0)} AS fitted_round, {rnd("se", 4)} AS se_fit,
           {rnd("fitted - 1.96 * se", 0)} AS "lower", {rnd("fitted + 1.96 * se", 0)} AS "upper", res AS residual,
           {rnd("res / nullif(measure, 0) * 100", 1)} AS residual_pc FROM bands"""


def _preparation(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return batches.preparation_batch(
        panels.school_counts(spark, sf_dir),
        panels.observations(spark, sf_dir),
        _projection(spark, sf_dir)["projection_4_5"],
        first_cohort=panels.FIRST_COHORT,
        skip_years=(1994,),
        split=1998,
        before=2001,
        long_after=1995,
        windows_=_PREPARED_WINDOWS,
    )


@query("preparation_batch", _preparation_sql())
def preparation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_preparation(spark, sf_dir)["fitted_a"], {"se_fit": 4}).distinct()


@query("preparation_batch_fitted_b", _preparation_sql("ERP_A"))
def preparation_fitted_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_preparation(spark, sf_dir)["fitted_b"], {"se_fit": 4}).distinct()


@query("preparation_batch_derived_measure", f"WITH {sqltext.ADJUSTED} SELECT * FROM adjusted")
def preparation_derived_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["derived_measure"]


@query(
    "preparation_batch_measure_panel",
    f"""WITH {domain.REBASED}
    SELECT yr, state, measure, erp_4, erp_5, enrol_lagged FROM panel
    UNION ALL SELECT yr, 'SA (adj)', trunc(coalesce(CASE WHEN yr >= 1998 THEN measure END, measure_adj)), erp_4, erp_5, enrol_lagged
    FROM rebased WHERE state = 'SA'""",
)
def preparation_measure_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["measure_panel"]


def _correlations_sql(source: str, y: str, x4: str, x5: str, windows_: dict[str, tuple[int, int]]) -> str:
    """r and stars of y against two covariates in windows of years, from a CTE."""
    parts = [
        f"""SELECT state, '{name}' AS "window", count(*) AS n, CASE WHEN var_pop({x4}) > 0 AND var_pop({y}) > 0 THEN corr({x4}, {y}) END AS r4,
        CASE WHEN var_pop({x5}) > 0 AND var_pop({y}) > 0 THEN corr({x5}, {y}) END AS r5 FROM {source}
        WHERE {y} IS NOT NULL AND {x4} IS NOT NULL AND {x5} IS NOT NULL AND yr BETWEEN {lo} AND {hi} GROUP BY state"""
        for name, (lo, hi) in windows_.items()
    ]
    p4, p5 = (rnd(sqltext.t_p(f"(r{i} * sqrt(CAST(n - 2 AS DOUBLE)) / sqrt(1 - r{i} * r{i}))", "(n - 2)"), 4) for i in (4, 5))
    return f"""SELECT state, "window", n, {rnd("r4", 2)} AS r_4yrs, {sqltext.stars("p4")} AS sig_4yrs, {rnd("r5", 2)} AS r_5yrs,
    {sqltext.stars("p5")} AS sig_5yrs FROM (SELECT *, {p4} AS p4, {p5} AS p5 FROM ({" UNION ALL ".join(parts)}))"""


_SUMMARY = f"""SELECT state, model, {rnd("r2", 2)} AS r_squared, {rnd("adj_r2", 2)} AS adj_r_squared, {rnd("p", 4)} AS p_value,
    {sqltext.stars("p")} AS sig, df AS df_residual FROM (SELECT *, {models.F_P} AS p FROM best)"""
_SUMMARY_COLUMNS = ["state", "model", "r_squared", "adj_r_squared", "p_value", "sig", "df_residual"]


def _coefficients_sql(fitted: list[Model], response: str) -> str:
    """The coefficient table of the CTE ``best``; begins with further CTEs."""
    return f"""{models.tidy_sql("state", "best", fitted)}, r AS (SELECT *, {rnd("p", 3)} AS p_value FROM tidy)
    SELECT state, model, term, '{response} ~ ' || model AS call, {rnd("estimate", 3)} AS estimate, {rnd("se", 3)} AS std_error,
           {rnd("statistic", 3)} AS statistic, p_value, {sqltext.stars("p_value")} AS sig FROM r WHERE term <> '(Intercept)'"""


_PREPARED_WINDOWS = {"1995-00": (1995, 2000), "1997-00": (1997, 2000)}


@query("preparation_batch_correlations", f"WITH {_preparation_ctes()} {_correlations_sql('training', 'measure', 'erp_4', 'erp_5', _PREPARED_WINDOWS)}")
def preparation_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["correlations"]


@query("preparation_batch_model_summary", f"WITH {_preparation_ctes()} {_SUMMARY}")
def preparation_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["model_summary"].select(*_SUMMARY_COLUMNS)


@query("preparation_batch_coefficients", f"WITH {_preparation_ctes()}, {_coefficients_sql(_MEASURE_MODELS, 'measure')}")
def preparation_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["coefficients"]


@query(
    "preparation_batch_prediction",
    f"""WITH {_preparation_ctes()}, tall AS (
      SELECT yr, state, assumption, se, 'Measured' AS series, {rnd("measure", 0)} AS v FROM applied
      UNION ALL SELECT yr, state, assumption, se, 'Predicted', {rnd("fitted", 0)} FROM applied),
    bounds AS (
      SELECT *, CASE series WHEN 'Predicted' THEN {rnd("v - 1.96 * se", 2)} END AS lo,
             CASE series WHEN 'Predicted' THEN {rnd("v + 1.96 * se", 2)} END AS hi FROM tall)
    SELECT state, yr, assumption, {rnd("se", 4)} AS se_fit, series, v AS "value", lo AS "lower", hi AS "upper",
           {rnd("(hi - lo) / nullif(v, 0) * 100", 1)} AS ci_pc FROM bounds""",
)
def preparation_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_preparation(spark, sf_dir)["prediction"], {"se_fit": 4})


def _prepared_scores_sql() -> str:
    """The chosen models fitted again on the rows with measure and projection; their residuals' normal scores.

    Few rows have both, so slopes that they do not bear are left out of the fit.
    """
    again = re.sub(r"\b(mom|slopes|fit|best)\b", r"\1_2", models.fits_sql("known", "state", "measure", _MEASURE_MODELS))
    x1 = "(CASE f.model WHEN 'ERP 5yrs' THEN i.erp_5 ELSE i.erp_4 END)"
    half = "CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END"
    return f"""WITH {_preparation_ctes()},
    known AS (SELECT DISTINCT yr, state, assumption, erp_4, erp_5, measure FROM applied WHERE yr < 2001 AND measure IS NOT NULL), {again},
    errors AS (
      SELECT i.yr, i.state, i.assumption, f.model, f.sigma, i.measure - CASE WHEN f.det > 0 THEN f.b0 + f.b1 * {x1} + CASE WHEN f.k = 2 THEN f.b2 * i.erp_5 ELSE 0 END
               WHEN f.s11 > 0 THEN f.my + f.s1y / f.s11 * ({x1} - f.m1) ELSE f.my END AS e,
             {models.leverage(x1, "i.erp_5")} AS h
      FROM known i JOIN fit_2 f ON i.state = f.state JOIN (SELECT state AS s, model AS chosen FROM best) ON s = f.state AND chosen = f.model),
    std AS (SELECT *, e / (sigma * sqrt(1 - h)) AS std_resid FROM errors),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY std_resid NULLS LAST, yr, assumption) AS DOUBLE) AS i,
             CAST(count(std_resid) OVER (PARTITION BY state) AS DOUBLE) AS n FROM std),
    points AS (SELECT *, (i - {half}) / (n + 1 - 2 * {half}) AS pt FROM ranked)
    SELECT state, yr, assumption, model, {rnd("e", 4)} AS resid, {rnd("std_resid", 4)} AS std_resid,
           CASE WHEN std_resid IS NOT NULL THEN {rnd(sqltext.normal_quantile("pt"), 6)} END AS theoretical FROM points"""


@query("preparation_batch_residual_scores", _prepared_scores_sql())
def preparation_residual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_preparation(spark, sf_dir)["residual_scores"], {"resid": 4, "std_resid": 4, "theoretical": 6})


@query(
    "preparation_batch_change_report",
    f"""WITH {sqltext.FACTORS} SELECT state, cohort, age_4, age_5, age_6, inv_chg_4_5, inv_chg_5_6,
    CASE WHEN cohort = 1996 THEN age_5 - age_4 ELSE 0.0::DOUBLE END AS chg_4_5, CASE WHEN cohort = 1995 THEN age_6 - age_5 ELSE 0.0::DOUBLE END AS chg_5_6
    FROM factors WHERE cohort IN (1995, 1996)""",
)
def preparation_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["change_report"]


@query(
    "preparation_batch_measure_long",
    f"""WITH {sqltext.PANEL} SELECT yr, state, series, "number", make_date(yr, 6, 30) AS "date" FROM (
      SELECT yr, state, enrol_lagged, measure, erp_4, erp_5 FROM panel WHERE yr > 1995)
      UNPIVOT INCLUDE NULLS ("number" FOR series IN (enrol_lagged, measure, erp_4, erp_5))""",
)
def preparation_measure_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preparation(spark, sf_dir)["measure_long"]


@query(
    "preparation_batch_measured_on_fitted",
    f"""WITH {_preparation_ctes()}, pairs AS (SELECT state, measure AS y, fitted AS x FROM applied WHERE yr < 2001 AND measure IS NOT NULL AND state <> 'Aust'),
    sums AS (SELECT state, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS c, avg(x) AS mx, avg(y) AS my FROM pairs GROUP BY state)
    SELECT state, n, CASE WHEN vx > 0 THEN {rnd("c / vx", 4)} END AS slope, CASE WHEN vx > 0 THEN {rnd("my - c / vx * mx", 3)} END AS intercept,
           CASE WHEN vx > 0 THEN CASE WHEN vy > 0 THEN {rnd("c * c / (vx * vy)", 6)} ELSE 1.0 END END AS r_squared FROM sums""",
)
def preparation_measured_on_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_preparation(spark, sf_dir)["measured_on_fitted"], {"slope": 4, "intercept": 3, "r_squared": 6})


_REPORT_MODELS = [
    Model("ERP 4yrs", ("erp_4yr",)),
    Model("ERP 5yrs", ("erp_5yr",)),
    Model("ERP 4yrs + 5yrs", ("erp_4yr", "erp_5yr")),
]
_REPORT_WINDOW = (1996, 2000)


def _report_ctes() -> str:
    """The report up to the rounded bands of the best models, ``bands``."""
    x1 = "(CASE b.model WHEN 'ERP 5yrs' THEN i.erp_5yr ELSE i.erp_4yr END)"
    return f"""{domain.REPAIRED}, {models.fits_sql("repaired_rows", "state", "repaired", _REPORT_MODELS)},
    on_rows AS (
      SELECT i.*, b.model, b0 + b1 * {x1} + CASE WHEN k = 2 THEN b2 * i.erp_5yr ELSE 0 END AS f, sigma * sqrt({models.leverage(x1, "i.erp_5yr")}) AS se
      FROM repaired_rows i JOIN best b ON i.state = b.state),
    bands AS (
      SELECT *, {rnd("f", 0)} AS fitted, {rnd("f - 1.96 * se", 0)} AS lower, {rnd("f + 1.96 * se", 0)} AS upper, {rnd("1.96 * se", 0)} AS ci,
             {rnd("2 * 1.96 * se / nullif(f, 0) * 100", 1)} AS rse FROM on_rows)"""


@query("report_batch_correlations", f"WITH {_report_ctes()} {_correlations_sql('repaired_rows', 'repaired', 'erp_4yr', 'erp_5yr', {'window': _REPORT_WINDOW})}")
def report_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["correlations"]


@query("report_batch_model_summary", f"WITH {_report_ctes()} {_SUMMARY.replace(rnd('p', 4), rnd('p', 3))}")
def report_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["model_summary"].select(*_SUMMARY_COLUMNS)


@query("report_batch_coefficients", f"WITH {_report_ctes()}, {_coefficients_sql(_REPORT_MODELS, 'measure')}")
def report_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["coefficients"]


@query("report_batch_fitted", f"""WITH {_report_ctes()} SELECT yr, state, assumption, model, repaired, fitted, lower, upper, ci, rse FROM bands""")
def report_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["fitted"].select("yr", "state", "assumption", "model", "repaired", "fitted", "lower", "upper", "ci", "rse")


@query(
    "report_batch_series",
    f"""WITH {_report_ctes()}, tall AS (
      SELECT yr, state, assumption, model, numerator, numerator45, series, {rnd('"value"', 0)} AS "value"
      FROM (SELECT yr, state, assumption, model, numerator, numerator45, erp_3yr, erp_4yr, erp_5yr, repaired, fitted FROM bands)
      UNPIVOT INCLUDE NULLS ("value" FOR series IN (erp_3yr, erp_4yr, erp_5yr, repaired, fitted)))
    SELECT *, 'All / ' || series AS ratio, {rnd('numerator / nullif("value", 0) * 100', 1)} AS percent FROM tall
    UNION ALL SELECT *, 'Ages 4-5 / ' || series, {rnd('numerator45 / nullif("value", 0) * 100', 1)} FROM tall""",
)
def report_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["series"]


# ---- the denominator batch and the ratio report on the assembled sheet

SHEET_MEMBERS = {"africa": "NSW", "america": "Vic", "asia": "Qld", "europe": "SA", "middle_east": "WA"}
SHEET_ITEMS = panels.PRIORITY_COLUMNS
_STATES = sqltext.case("state", SHEET_MEMBERS)
_REVISED = f"""{sqltext.APPORTIONED}, {sqltext.SERIES}, moved AS (
      SELECT yr + 1 AS yr, {sqltext.REGION_CASE.replace("CASE region", "CASE state_code")} AS state, net_mig_sya AS net_mig FROM apportioned WHERE age = 5),
    named AS (SELECT yr, {_STATES} AS state, series, "value" FROM series_panel),
    sheet AS (SELECT yr, state, {", ".join(f"CAST(max({chr(34)}value{chr(34)}) FILTER (series = '{k}') AS BIGINT) AS {v}" for k, v in SHEET_ITEMS.items())} FROM named GROUP BY yr, state),
    revised AS (SELECT s.*, s.low - m.net_mig AS low_revised FROM sheet s LEFT JOIN moved m ON s.yr = m.yr AND s.state = m.state)"""


def _denominators(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    feeds = [panels.migration_observations(spark, sf_dir, feed) for feed in ("overseas", "interstate")]
    return batches.denominator_batch(
        panels.assembled(spark, sf_dir), panels.observations(spark, sf_dir), *feeds, SHEET_MEMBERS, SHEET_ITEMS, school="low", numerator="urgent"
    )


@query("denominator_batch", f"WITH {_REVISED} SELECT * FROM revised")
def denominator_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _denominators(spark, sf_dir)["revised"]


@query(
    "denominator_batch_apportioned",
    f"WITH {sqltext.APPORTIONED} SELECT yr, state_code, age, age_grp, net_mig_sya, net_mig_grp, erp_sya, erp_grp, p FROM apportioned",
)
def denominator_apportioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _denominators(spark, sf_dir)["apportioned"]


@query(
    "denominator_batch_ratios",
    f"""WITH {_REVISED}, tall AS (
      SELECT yr, state, u AS numerator, series, "value" FROM (
        SELECT yr, state, CAST(urgent AS DOUBLE) AS u, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*SHEET_ITEMS.values(), "low_revised"])} FROM revised)
      UNPIVOT INCLUDE NULLS ("value" FOR series IN ({", ".join([*SHEET_ITEMS.values(), "low_revised"])})))
    SELECT *, {rnd('numerator / nullif("value", 0) * 100', 1)} AS percent, 'urgent / ' || series AS ratio FROM tall""",
)
def denominator_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _denominators(spark, sf_dir)["ratios"]


_NUMERATORS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_STACKED = f"""{sqltext.SERIES}, named AS (SELECT yr, {_STATES} AS state, series, {rnd('"value"', 0)} AS "value" FROM series_panel),
    stacked AS (
      SELECT d.yr, d.state, d.series, d."value", n.series AS numerator, n."value" AS n,
             {rnd('n."value" / nullif(d."value", 0) * 100', 1)} AS percent, n.series || ' / ' || d.series AS ratio
      FROM named d JOIN named n ON d.yr = n.yr AND d.state = n.state WHERE n.series IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"""
_CHOICE = dict(members=["NSW", "Qld", "WA"], periods=[1996, 1997, 2000], series=["4-NOT SPECIFIED", "5-LOW"], shown=["1-URGENT / 5-LOW", "2-HIGH / 4-NOT SPECIFIED"])
_CHOSEN = "state IN ('NSW', 'Qld', 'WA') AND yr IN (1996, 1997, 2000)"
_CHOSEN_SERIES = "series IN ('4-NOT SPECIFIED', '5-LOW')"
_CHOSEN_RATIOS = "ratio IN ('1-URGENT / 5-LOW', '2-HIGH / 4-NOT SPECIFIED')"


def _ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.ratio_report(panels.assembled(spark, sf_dir), SHEET_MEMBERS, _NUMERATORS)["ratios"]


@query("ratio_report", f"WITH {_STACKED} SELECT * FROM stacked")
def ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio_report(spark, sf_dir)


_SLICES = {
    "count_chart": f"SELECT * FROM stacked WHERE {_CHOSEN} AND {_CHOSEN_SERIES}",
    "ratio_chart": f"SELECT * FROM stacked WHERE {_CHOSEN} AND {_CHOSEN_RATIOS}",
    "count_table": f'SELECT DISTINCT yr, state, series, "value" FROM stacked WHERE {_CHOSEN} AND {_CHOSEN_SERIES} AND "value" IS NOT NULL',
    "ratio_table": f"""SELECT yr, state, numerator, n AS num_value, series AS denominator, "value" AS denom_value, percent
        FROM stacked WHERE {_CHOSEN} AND {_CHOSEN_RATIOS} AND percent IS NOT NULL""",
}


def _register_slices() -> None:
    """One query for each slice of the ratio report."""
    for name, sql in _SLICES.items():

        def of(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
            return batches.report_slices(_ratio_report(spark, sf_dir), **_CHOICE)[name]

        query(f"ratio_report_{name}", f"WITH {_STACKED} {sql}")(of)


_register_slices()


def _report_sql() -> str:
    labels = ("Zero", "Med", "High")
    cells = ", ".join(f"max({m}) FILTER (assumption = '{s}') AS {m}_{s.lower()}" for s in labels for m in RANGE_MEASURES)
    x1 = "(CASE b.model WHEN 'ERP 5yrs' THEN i.erp_5yr ELSE i.erp_4yr END)"
    report_models = [
        Model("ERP 4yrs", ("erp_4yr",)),
        Model("ERP 5yrs", ("erp_5yr",)),
        Model("ERP 4yrs + 5yrs", ("erp_4yr", "erp_5yr")),
    ]
    sums = ", ".join(sqltext.strict_sum(m) for m in RANGE_MEASURES)
    return f"""WITH {domain.REPAIRED}, {models.fits_sql("repaired_rows", "state", "repaired", report_models)},
    applied AS (
      SELECT i.yr, i.state, i.assumption, i.erp_4yr, b0 + b1 * {x1} + CASE WHEN k = 2 THEN b2 * i.erp_5yr ELSE 0 END AS f,
             sigma * sqrt({models.leverage(x1, "i.erp_5yr")}) AS se
      FROM repaired_rows i JOIN best b ON i.state = b.state WHERE i.yr >= 1996),
    fitted_rows AS (
      SELECT DISTINCT yr, state, assumption, erp_4yr, {rnd("f", 0)} AS fitted, {rnd("f - 1.96 * se", 0)} AS lower, {rnd("f + 1.96 * se", 0)} AS upper
      FROM applied),
    cloned AS (
      SELECT yr, state, t.s AS assumption, erp_4yr, fitted, lower, upper
      FROM fitted_rows, (VALUES ('Zero'), ('Med'), ('High')) t(s) WHERE assumption = 'N.A.' OR assumption = t.s),
    stacked AS (SELECT * FROM cloned UNION ALL SELECT yr, 'Aust', assumption, {sums} FROM cloned GROUP BY yr, assumption)
    SELECT yr, state, {cells} FROM stacked GROUP BY yr, state"""


def _report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return batches.report_batch(
        panels.model_input(spark, sf_dir),
        domain.repair_rules(spark),
        ["erp_3yr", "erp_4yr", "erp_5yr"],
        {"numerator": "All", "numerator45": "Ages 4-5"},
        range_from=1996,
        corr_window=_REPORT_WINDOW,
    )


@query("report_batch", _report_sql())
def report_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["ranges"]


@query("report_batch_repaired", f"WITH {domain.REPAIRED} SELECT yr, state, assumption, measure, repaired FROM repaired_rows")
def report_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["repaired"].select("yr", "state", "assumption", "measure", "repaired")
