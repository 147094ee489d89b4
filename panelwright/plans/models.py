"""Queries: linear models per group, on panel cells and on whole fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import round_columns
from ..operators import regression, windows
from ..operators.regression import Model
from ..session import hold
from . import panels, sqltext
from .panels import table
from .registry import query

rnd = sqltext.rnd

PANEL_MODELS = [
    Model("4yrs", ("erp_4yr",)),
    Model("5yrs", ("erp_5yr",)),
    Model("4yrs + 5yrs", ("erp_4yr", "erp_5yr")),
]
ROW_MODELS = [
    Model("quantity", ("l_quantity",)),
    Model("discount", ("l_discount",)),
    Model("quantity + discount", ("l_quantity", "l_discount")),
]
ROW_KEYS = ["l_returnflag", "l_linestatus"]


def panel_fits(rows: DataFrame) -> DataFrame:
    return regression.fit_linear(rows, ["state"], "measure", PANEL_MODELS)


def row_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.fit_linear(table(spark, sf_dir, "lineitem"), ROW_KEYS, "l_extendedprice", ROW_MODELS)


# ---- SQL twin of the fits, from the textbook formulas


def fits_sql(source: str, keys: str, y: str, models: list[Model]) -> str:
    """CTE ``fit``: one row per (keys, model) with slopes, errors and leverage terms."""
    parts = []
    for m in models:
        x1 = m.covariates[0]
        if len(m.covariates) == 1:
            parts.append(
                f"""SELECT {keys}, '{m.name}' AS model, 1 AS k, CAST(regr_count({y}, {x1}) AS BIGINT) AS n, regr_avgy({y}, {x1}) AS my,
                regr_avgx({y}, {x1}) AS m1, 0.0::DOUBLE AS m2, regr_sxx({y}, {x1}) AS s11, 1.0::DOUBLE AS s22, 0.0::DOUBLE AS s12,
                regr_sxy({y}, {x1}) AS s1y, 0.0::DOUBLE AS s2y, regr_syy({y}, {x1}) AS syy FROM {source} GROUP BY {keys}"""
            )
        else:
            x2 = m.covariates[1]
            parts.append(
                f"""SELECT {keys}, '{m.name}', 2, CAST(regr_count({y}, {x1}) AS BIGINT), regr_avgy({y}, {x1}), regr_avgx({y}, {x1}),
                regr_avgx({y}, {x2}), regr_sxx({y}, {x1}), regr_sxx({y}, {x2}), regr_sxy({x1}, {x2}), regr_sxy({y}, {x1}),
                regr_sxy({y}, {x2}), regr_syy({y}, {x1})
                FROM {source} WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL GROUP BY {keys}"""
            )
    return f"""mom AS ({" UNION ALL ".join(parts)}),
    slopes AS (
      SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, n - k - 1 AS df FROM mom),
    fit AS (
      SELECT *, my - b1 * m1 - b2 * m2 AS b0, syy - b1 * s1y - b2 * s2y AS ssr,
             CASE WHEN df > 0 THEN sqrt((syy - b1 * s1y - b2 * s2y) / df) END AS sigma,
             1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2,
             CASE WHEN df > 0 THEN 1 - (syy - b1 * s1y - b2 * s2y) / syy * (n - 1) / df END AS adj_r2,
             CASE WHEN k = 1 THEN 1 - (syy - b1 * s1y - b2 * s2y) / syy
                  WHEN df > 0 THEN 1 - (syy - b1 * s1y - b2 * s2y) / syy * (n - 1) / df END AS criterion
      FROM slopes),
    best AS (
      SELECT * FROM (
        SELECT *, max(criterion) OVER g AS top, count(*) OVER g - count(criterion) OVER g AS missing
        FROM fit WINDOW g AS (PARTITION BY {keys}))
      WHERE criterion = top AND missing = 0)"""


def leverage(x1: str, x2: str) -> str:
    """Leverage of a point; with one covariate the second one is switched off."""
    d1 = f"({x1} - m1)"
    d2 = f"(CASE WHEN k = 1 THEN 0 ELSE {x2} - m2 END)"
    one, two = f"{d1} * {d1} / s11", f"({d1} * {d1} * s22 - 2 * {d1} * {d2} * s12 + {d2} * {d2} * s11) / det"
    return f"(1.0 / n + CASE WHEN k = 1 THEN {one} ELSE {two} END)"


def tidy_sql(keys: str, source: str, models: list[Model]) -> str:
    first = sqltext.case("model", {m.name: m.covariates[0] for m in models})
    second = sqltext.case("model", {m.name: m.covariates[1] for m in models if len(m.covariates) > 1})
    return f"""terms AS (
      SELECT {keys}, model, df, '(Intercept)' AS term, b0 AS estimate, sigma * sqrt({leverage("0.0", "0.0")}) AS se FROM {source}
      UNION ALL SELECT {keys}, model, df, {first}, b1, sigma * sqrt(s22 / det) FROM {source}
      UNION ALL SELECT {keys}, model, df, {second}, b2, sigma * sqrt(s11 / det) FROM {source} WHERE k = 2),
    tidy AS (SELECT *, estimate / se AS statistic, {sqltext.t_p("(estimate / se)", "df")} AS p FROM terms)"""


ROWS_SQL = fits_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice", ROW_MODELS)
# One covariate tests F through t; two covariates have the exact form (1 + 2F/df)^(-df/2).
F_STATISTIC = "((syy - ssr) / k / (ssr / df))"
F_P = f"CASE k WHEN 1 THEN {sqltext.t_p(f'sqrt({F_STATISTIC})', 'df')} ELSE pow(1 + 2 * {F_STATISTIC} / df, -df / 2.0) END"
PANEL_SQL = f"{sqltext.MODEL}, {fits_sql('model_input', 'state', 'measure', PANEL_MODELS)}"


@query(
    "ols_tidy",
    f"""WITH {ROWS_SQL}, {tidy_sql("l_returnflag, l_linestatus", "fit", ROW_MODELS)}
    SELECT l_returnflag, l_linestatus, model, term, {rnd("estimate", 3)} AS estimate, {rnd("se", 3)} AS std_error,
           {rnd("statistic", 4)} AS statistic, {rnd("p", 6)} AS p_value FROM tidy""",
)
def ols_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(
        regression.tidy(row_fits(spark, sf_dir)), {"estimate": 3, "std_error": 3, "statistic": 4, "p_value": 6}
    )


@query(
    "ols_tidy_panel",
    f"""WITH {PANEL_SQL}, {tidy_sql("state", "fit", PANEL_MODELS)}
    SELECT state, model, term, {rnd("estimate", 4)} AS estimate, {rnd("se", 4)} AS std_error,
           {rnd("statistic", 4)} AS statistic, {rnd("p", 6)} AS p_value FROM tidy""",
)
def ols_tidy_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidied = regression.tidy(panel_fits(panels.model_input(spark, sf_dir)))
    return round_columns(tidied, {"estimate": 4, "std_error": 4, "statistic": 4, "p_value": 6})


FOUR = Model("four", ("x1", "x2", "x3", "x4"))


def _four_sql() -> str:
    """Least squares by orthogonal columns: each covariate less what the ones before it say of it, on the rows themselves."""
    g = "PARTITION BY l_returnflag, l_linestatus"
    whole = lambda term: f"sum({term}) OVER ({g})"
    steps = [
        f"""base AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2,
        CASE l_returnflag WHEN 'A' THEN 2 * l_quantity + 3 ELSE l_tax END AS x3, CAST(l_linenumber AS DOUBLE) AS x4 FROM lineitem),
        z0 AS (SELECT *, {", ".join(f"x{j} - avg(x{j}) OVER ({g}) AS c{j}" for j in range(1, 5))} FROM base)"""
    ]
    for j in range(1, 5):
        shares = [f"CASE WHEN {whole(f'z{i} * z{i}')} > 0 THEN {whole(f'c{j} * z{i}')} / {whole(f'z{i} * z{i}')} ELSE 0 END AS r{i}{j}" for i in range(1, j)]
        steps.append(f"r{j} AS (SELECT *{''.join(', ' + s for s in shares)} FROM z{j - 1})")
        steps.append(f"o{j} AS (SELECT *, c{j}{''.join(f' - r{i}{j} * z{i}' for i in range(1, j))} AS e{j} FROM r{j})")
        steps.append(f"z{j} AS (SELECT *, CASE WHEN {whole(f'e{j} * e{j}')} > 1e-12 * {whole(f'c{j} * c{j}')} THEN e{j} ELSE 0 END AS z{j} FROM o{j})")
    cells = ["count(*) AS n", "avg(y) AS my", "regr_syy(y, y) AS syy"]
    cells += [f"avg(x{j}) AS m{j}, sum(z{j} * z{j}) AS s{j}, sum(y * z{j}) AS q{j}" for j in range(1, 5)]
    cells += [f"max(r{i}{j}) AS r{i}{j}" for j in range(1, 5) for i in range(1, j)]
    steps.append(f"sums AS (SELECT l_returnflag, l_linestatus, {', '.join(cells)} FROM z4 GROUP BY l_returnflag, l_linestatus)")
    # w: the inverse of the unit triangle of shares, aliased columns left out.
    for i in range(4, 0, -1):
        terms = [f"CASE WHEN s{j} > 0 THEN -(" + " + ".join(f"r{i}{m} * CASE WHEN s{m} > 0 THEN {'1' if m == j else f'w{m}{j}'} ELSE 0 END" for m in range(i + 1, j + 1)) + f") ELSE 0 END AS w{i}{j}" for j in range(i + 1, 5)]
        steps.append(f"w{i} AS (SELECT *{''.join(', ' + t for t in terms)} FROM {'sums' if i == 4 else f'w{i + 1}'})")
    w = lambda i, j: "1" if i == j else f"w{i}{j}"
    gain = lambda j: f"CASE WHEN s{j} > 0 THEN q{j} / s{j} ELSE 0 END"
    slopes = [f"CASE WHEN s{i} > 0 THEN {' + '.join(f'{w(i, j)} * {gain(j)}' for j in range(i, 5))} END AS b{i}" for i in range(1, 5)]
    parts = [f"CASE WHEN s{i} > 0 THEN {' + '.join(f'CASE WHEN s{j} > 0 THEN {w(i, j)} * {w(i, j)} / s{j} ELSE 0 END' for j in range(i, 5))} END AS v{i}" for i in range(1, 5)]
    origin = [f"CASE WHEN s{j} > 0 THEN pow({' + '.join(f'CASE WHEN s{i} > 0 THEN m{i} * {w(i, j)} ELSE 0 END' for i in range(1, j + 1))}, 2) / s{j} ELSE 0 END" for j in range(1, 5)]
    rank = " + ".join(f"CASE WHEN s{j} > 0 THEN 1 ELSE 0 END" for j in range(1, 5))
    left = "syy" + "".join(f" - CASE WHEN s{j} > 0 THEN q{j} * q{j} / s{j} ELSE 0 END" for j in range(1, 5))
    steps.append(f"solved AS (SELECT *, {', '.join(slopes + parts)}, 1.0 / n + {' + '.join(origin)} AS v0, sqrt(({left}) / (n - ({rank}) - 1)) AS sigma FROM w1)")
    rows = ["SELECT l_returnflag, l_linestatus, '(Intercept)' AS term, my" + "".join(f" - coalesce(b{i} * m{i}, 0)" for i in range(1, 5)) + " AS estimate, sigma * sqrt(v0) AS se FROM solved"]
    rows += [f"SELECT l_returnflag, l_linestatus, 'x{i}', b{i}, sigma * sqrt(v{i}) FROM solved" for i in range(1, 5)]
    return (
        f"WITH {', '.join(steps)}, terms AS ({' UNION ALL '.join(rows)}) SELECT l_returnflag, l_linestatus, term, "
        f"{rnd('estimate', 3)} AS estimate, {rnd('se', 3)} AS std_error, {rnd('estimate / se', 3)} AS statistic FROM terms"
    )


@query("ols_tidy_aliased", _four_sql())
def ols_tidy_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four covariates; in the groups of flag A the third one repeats the first."""
    rows = table(spark, sf_dir, "lineitem").select(
        *ROW_KEYS, "l_extendedprice", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
        F.when(F.col("l_returnflag") == "A", 2 * F.col("l_quantity") + 3).otherwise(F.col("l_tax")).alias("x3"), F.col("l_linenumber").alias("x4"),
    )
    tidied = regression.tidy(regression.fit_linear(rows, ROW_KEYS, "l_extendedprice", [FOUR]))
    return round_columns(tidied.select(*ROW_KEYS, "term", "estimate", "std_error", "statistic"), {"estimate": 3, "std_error": 3, "statistic": 3})


GLANCE_DIGITS = {
    "r_squared": 6,
    "adj_r_squared": 6,
    "sigma": 4,
    "statistic": 4,
    "p_value": 6,
    "log_lik": 3,
    "aic": 3,
    "bic": 3,
    "deviance": 0,
}


@query(
    "ols_glance",
    f"""WITH {ROWS_SQL}, g AS (
      SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll, {F_STATISTIC} AS f, {F_P} AS p FROM fit)
    SELECT l_returnflag, l_linestatus, model, {rnd("r2", 6)} AS r_squared, {rnd("adj_r2", 6)} AS adj_r_squared,
           {rnd("sigma", 4)} AS sigma, {rnd("f", 4)} AS statistic, {rnd("p", 6)} AS p_value, CAST(k AS INTEGER) AS df,
           {rnd("ll", 3)} AS log_lik, {rnd("-2 * ll + 2 * (k + 2)", 3)} AS aic, {rnd("-2 * ll + ln(n) * (k + 2)", 3)} AS bic,
           round(ssr / 1e6) AS deviance, df AS df_residual, n AS nobs FROM g""",
)
def ols_glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = regression.glance(row_fits(spark, sf_dir)).drop("criterion")
    return round_columns(table_.withColumn("deviance", F.col("deviance") / 1e6), GLANCE_DIGITS)


@query(
    "ols_glance_panel",
    f"""WITH {PANEL_SQL}, g AS (
      SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll, {F_STATISTIC} AS f, {F_P} AS p FROM fit)
    SELECT state, model, {rnd("r2", 6)} AS r_squared, {rnd("adj_r2", 6)} AS adj_r_squared,
           {rnd("sigma", 4)} AS sigma, {rnd("f", 4)} AS statistic, {rnd("p", 6)} AS p_value,
           {rnd("ll", 3)} AS log_lik, df AS df_residual, n AS nobs FROM g""",
)
def ols_glance_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = regression.glance(panel_fits(panels.model_input(spark, sf_dir)))
    return round_columns(
        table_.drop("criterion", "df", "aic", "bic", "deviance"),
        {c: d for c, d in GLANCE_DIGITS.items() if c not in ("aic", "bic", "deviance")},
    )


_T975 = f"""list_reduce(list_concat([0.0::DOUBLE], range(1, 47)), lambda lo, halving:
    CASE WHEN {sqltext.t_p("(lo + 16.0 / pow(2, halving))", "df", 100)} > 0.05 THEN lo + 16.0 / pow(2, halving) ELSE lo END)"""


@query(
    "ols_augment_new",
    f"""WITH {PANEL_SQL}, q AS (SELECT *, {_T975} AS t975 FROM fit),
    applied AS (
      SELECT i.yr, i.state, i.assumption, q.model, b0 + b1 * (CASE q.model WHEN '5yrs' THEN erp_5yr ELSE erp_4yr END)
               + CASE WHEN k = 2 THEN b2 * erp_5yr ELSE 0 END AS fitted, sigma, t975,
             {leverage("(CASE q.model WHEN '5yrs' THEN erp_5yr ELSE erp_4yr END)", "erp_5yr")} AS lev
      FROM model_input i JOIN q ON i.state = q.state)
    SELECT yr, state, assumption, model, {rnd("fitted", 3)} AS fitted, {rnd("sigma * sqrt(lev)", 3)} AS se_fit,
           {rnd("fitted - t975 * sigma * sqrt(1 + lev)", 3)} AS pred_lower,
           {rnd("fitted + t975 * sigma * sqrt(1 + lev)", 3)} AS pred_upper FROM applied""",
)
def ols_augment_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.model_input(spark, sf_dir)
    out = regression.augment(rows, panel_fits(rows), PANEL_MODELS)
    columns = ["fitted", "se_fit", "pred_lower", "pred_upper"]
    return round_columns(out.select("yr", "state", "assumption", "model", *columns), {c: 3 for c in columns})


_PRICE_FIT = "b0 + b1 * (CASE model WHEN 'discount' THEN l_discount ELSE l_quantity END) + CASE WHEN k = 2 THEN b2 * l_discount ELSE 0 END"
_PRICE_LEV = leverage("(CASE model WHEN 'discount' THEN l_discount ELSE l_quantity END)", "l_discount")


@query(
    "ols_augment_resid",
    f"""WITH {ROWS_SQL}, applied AS (
      SELECT l_orderkey, l_linenumber, model, k, sigma, df, ssr, l_extendedprice - ({_PRICE_FIT}) AS e, {_PRICE_LEV} AS h
      FROM lineitem JOIN fit USING (l_returnflag, l_linestatus))
    SELECT l_orderkey, l_linenumber, model, {rnd("e", 2)} AS resid, {rnd("h", 7)} AS hat,
           {rnd("e / (sigma * sqrt(1 - h))", 5)} AS std_resid,
           {rnd("sqrt((ssr - e * e / (1 - h)) / (df - 1))", 2)} AS loo_sigma,
           {rnd("e * e * h / ((k + 1) * sigma * sigma * (1 - h) * (1 - h))", 7)} AS cooksd FROM applied""",
)
def ols_augment_resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *ROW_KEYS, "l_quantity", "l_discount", "l_extendedprice"
    )
    out = regression.residuals(lines, row_fits(spark, sf_dir), ROW_MODELS, "l_extendedprice")
    digits = {"resid": 2, "hat": 7, "std_resid": 5, "loo_sigma": 2, "cooksd": 7}
    return round_columns(out.select("l_orderkey", "l_linenumber", "model", *digits), digits)


@query(
    "select_best_model",
    f"WITH {PANEL_SQL} SELECT state, model, {rnd('criterion', 6)} AS criterion FROM best",
)
def select_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = regression.best_fits(panel_fits(panels.model_input(spark, sf_dir)))
    return round_columns(regression.fits_long(best).select("state", "model", "criterion"), {"criterion": 6})


ASSIGNMENT = {
    "4yrs": [f"NATION_{i}" for i in range(0, 10)],
    "4yrs + 5yrs": [f"NATION_{i}" for i in range(10, 20)],
}


@query(
    "assign_model_fixed",
    f"""WITH {PANEL_SQL}
    SELECT state, model, {rnd("b0", 3)} AS intercept, {rnd("r2", 6)} AS r_squared FROM fit
    WHERE model = CASE WHEN CAST(substr(state, 8) AS INTEGER) < 10 THEN '4yrs'
                       WHEN CAST(substr(state, 8) AS INTEGER) < 20 THEN '4yrs + 5yrs' END""",
)
def assign_model_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = regression.assigned_fits(panel_fits(panels.model_input(spark, sf_dir)), "state", ASSIGNMENT)
    rows = regression.fits_long(kept).select("state", "model", F.col("coef")[0].alias("intercept"), "r_squared")
    return round_columns(rows, {"intercept": 3, "r_squared": 6})


@query(
    "model_summary_table",
    f"""WITH {PANEL_SQL}, g AS (SELECT *, {F_P} AS p FROM best)
    SELECT state, model, {rnd("r2", 2)} AS r_squared, {rnd("adj_r2", 2)} AS adj_r_squared, {rnd("p", 4)} AS p_value,
           {sqltext.stars("p")} AS sig, df AS df_residual FROM g""",
)
def model_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = regression.best_fits(panel_fits(panels.model_input(spark, sf_dir)))
    summary = regression.model_summary_table(regression.glance(best))
    return summary.select("state", "model", "r_squared", "adj_r_squared", "p_value", "sig", "df_residual")


@query(
    "coefficient_table",
    f"""WITH {PANEL_SQL}, {tidy_sql("state", "best", PANEL_MODELS)}, r AS (SELECT *, {rnd("p", 3)} AS p_value FROM tidy)
    SELECT state, model, term, 'measure ~ ' || model AS call, {rnd("estimate", 3)} AS estimate, {rnd("se", 3)} AS std_error,
           {rnd("statistic", 3)} AS statistic, p_value, {sqltext.stars("p_value")} AS sig FROM r WHERE term <> '(Intercept)'""",
)
def coefficient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = regression.best_fits(panel_fits(panels.model_input(spark, sf_dir)))
    return regression.coefficient_table(regression.tidy(best), "measure")


_BEST_APPLIED = f"""applied AS (
  SELECT i.yr, i.state, i.assumption, i.measure, b.model,
         b0 + b1 * (CASE b.model WHEN '5yrs' THEN erp_5yr ELSE erp_4yr END) + CASE WHEN k = 2 THEN b2 * erp_5yr ELSE 0 END AS fitted,
         sigma * sqrt({leverage("(CASE b.model WHEN '5yrs' THEN erp_5yr ELSE erp_4yr END)", "erp_5yr")}) AS se
  FROM model_input i JOIN best b ON i.state = b.state)"""


def best_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.model_input(spark, sf_dir)
    return regression.augment(rows, regression.best_fits(panel_fits(rows)), PANEL_MODELS, level=None)


@query(
    "fitted_band",
    f"""WITH {PANEL_SQL}, {_BEST_APPLIED}, bands AS (
      SELECT *, {rnd("fitted - 1.96 * se", 0)} AS lo, {rnd("fitted + 1.96 * se", 0)} AS hi, {rnd("measure - fitted", 0)} AS res FROM applied)
    SELECT yr, state, assumption, model, measure, {rnd("fitted", 0)} AS fitted_round, lo AS "lower", hi AS "upper",
           {rnd("(hi - lo) / nullif(fitted, 0) * 100", 1)} AS ci_pc, res AS residual,
           {rnd("res / nullif(measure, 0) * 100", 1)} AS residual_pc FROM bands""",
)
def fitted_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = regression.fitted_band(best_augmented(spark, sf_dir), "measure")
    return bands.select(
        "yr", "state", "assumption", "model", "measure", "fitted_round", "lower", "upper", "ci_pc", "residual", "residual_pc"
    )


@query(
    "prediction_long",
    f"""WITH {PANEL_SQL}, {_BEST_APPLIED}, tall AS (
      SELECT yr, state, assumption, se, 'Measured' AS series, {rnd("measure", 0)} AS v FROM applied
      UNION ALL SELECT yr, state, assumption, se, 'Predicted', {rnd("fitted", 0)} FROM applied),
    bounds AS (
      SELECT *, CASE series WHEN 'Predicted' THEN {rnd("v - 1.96 * se", 2)} END AS lo,
             CASE series WHEN 'Predicted' THEN {rnd("v + 1.96 * se", 2)} END AS hi FROM tall)
    SELECT yr, state, assumption, {rnd("se", 4)} AS se_fit, series, v AS "value", lo AS "lower", hi AS "upper",
           {rnd("(hi - lo) / nullif(v, 0) * 100", 1)} AS ci_pc FROM bounds""",
)
def prediction_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = regression.prediction_long(best_augmented(spark, sf_dir), ["yr", "state", "assumption"], "measure")
    return round_columns(tall, {"se_fit": 4})


@query(
    "fit_r2_by_group",
    f"""SELECT l_suppkey, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, {rnd("regr_slope(l_extendedprice, l_quantity)", 3)} AS slope,
    {rnd("regr_intercept(l_extendedprice, l_quantity)", 2)} AS intercept,
    {rnd("regr_r2(l_extendedprice, l_quantity)", 7)} AS r_squared FROM lineitem GROUP BY l_suppkey""",
)
def fit_r2_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regression.fit_r2_by_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return round_columns(out, {"slope": 3, "intercept": 2, "r_squared": 7})


@query(
    "residual_scores",
    f"""WITH {PANEL_SQL}, applied AS (
      SELECT i.yr, i.state, i.assumption, model, sigma,
             measure - (b0 + b1 * (CASE b.model WHEN '5yrs' THEN erp_5yr ELSE erp_4yr END) + CASE WHEN k = 2 THEN b2 * erp_5yr ELSE 0 END) AS e,
             {leverage("(CASE b.model WHEN '5yrs' THEN erp_5yr ELSE erp_4yr END)", "erp_5yr")} AS h
      FROM model_input i JOIN best b ON i.state = b.state WHERE measure IS NOT NULL),
    std AS (SELECT *, {rnd("e / (sigma * sqrt(1 - h))", 6)} AS std_resid FROM applied),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY std_resid, yr, assumption) AS DOUBLE) AS i,
             CAST(count(*) OVER (PARTITION BY state) AS DOUBLE) AS n FROM std WHERE std_resid IS NOT NULL),
    points AS (SELECT *, (i - CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END)
      / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END) AS pt FROM ranked)
    SELECT yr, state, assumption, model, std_resid, {rnd(sqltext.normal_quantile("pt"), 6)} AS theoretical FROM points""",
)
def residual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.model_input(spark, sf_dir)
    best = regression.best_fits(panel_fits(rows))
    diagnostics = regression.residuals(rows, best, PANEL_MODELS, "measure")
    std = hold(round_columns(diagnostics.select("yr", "state", "assumption", "model", "std_resid"), {"std_resid": 6}))
    return round_columns(windows.normal_scores(std, ["state"], "std_resid", ["yr", "assumption"]), {"theoretical": 6})


def _kfold_sql() -> str:
    y, xs = "l_extendedprice", ("l_quantity", "l_discount", "l_tax")
    cells = [f"avg({y}) AS my", *[f"avg({x}) AS m{i}" for i, x in enumerate(xs)]]
    cells += [f"regr_sxy({y}, {x}) AS c{i}" for i, x in enumerate(xs)]
    cells += [f"regr_sxy({xs[j]}, {xs[i]}) AS s{i}{j}" for i in range(3) for j in range(i, 3)]
    det = "(s00*(s11*s22-s12*s12) - s01*(s01*s22-s12*s02) + s02*(s01*s12-s11*s02))"
    b0 = f"(c0*(s11*s22-s12*s12) - s01*(c1*s22-s12*c2) + s02*(c1*s12-s11*c2)) / {det}"
    b1 = f"(s00*(c1*s22-c2*s12) - c0*(s01*s22-s12*s02) + s02*(s01*c2-c1*s02)) / {det}"
    b2 = f"(s00*(s11*c2-s12*c1) - s01*(s01*c2-c1*s02) + c0*(s01*s12-s11*s02)) / {det}"
    return f"""WITH r AS (SELECT *, CAST(l_orderkey % 5 AS INTEGER) AS fold FROM lineitem),
    mom AS (SELECT f.fold, {", ".join(cells)} FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY f.fold),
    fit AS (SELECT *, {b0} AS b0, {b1} AS b1, {b2} AS b2 FROM mom),
    e AS (SELECT r.fold, {y} AS y, my + b0 * (l_quantity - m0) + b1 * (l_discount - m1) + b2 * (l_tax - m2) AS f
          FROM r JOIN fit ON r.fold = fit.fold),
    per AS (SELECT fold, count(*) AS n, sqrt(avg((y - f) * (y - f))) AS rmse, pow(corr(f, y), 2) AS r2, avg(abs(y - f)) AS mae FROM e GROUP BY fold)
    SELECT fold, n, {rnd("rmse", 3)} AS rmse, {rnd("r2", 7)} AS r_squared, {rnd("mae", 3)} AS mae FROM per
    UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), {rnd("avg(rmse)", 3)}, {rnd("avg(r2)", 7)}, {rnd("avg(mae)", 3)} FROM per"""


@query("kfold_cv", _kfold_sql())
def kfold_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    scores = regression.kfold_cv(
        lines, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], F.pmod("l_orderkey", F.lit(5)), 5
    )
    return round_columns(scores, {"rmse": 3, "r_squared": 7, "mae": 3})
