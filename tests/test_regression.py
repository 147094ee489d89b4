import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.rounding import round_columns
from panelwright.operators import regression as reg
from panelwright.operators.regression import Model

MODELS = [Model("x1", ("x1",)), Model("x2", ("x2",)), Model("both", ("x1", "x2"))]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    out = []
    for g, n in (("a", 14), ("b", 300)):
        x1 = rng.normal(80_000, 3_000, n)
        x2 = 0.9 * x1 + rng.normal(0, 1_500, n)
        y = 0.4 * x1 + 0.3 * x2 + rng.normal(0, 800, n)
        out += [(g, i, float(x1[i]), float(x2[i]), float(y[i])) for i in range(n)]
    out += [("a", 900, 1.0, None, 5.0), ("a", 901, 80_000.0, 70_000.0, None)]
    out += [("few", 0, 1.0, 2.0, 3.0), ("few", 1, 2.0, 5.0, 4.0)]
    out += [("flat", i, 1.0, 2.0, float(i)) for i in range(6)]
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "g string, i int, x1 double, x2 double, y double").repartition(5)


@pytest.fixture(scope="module")
def fits(df):
    return reg.fit_linear(df, ["g"], "y", MODELS)


def lstsq(data, g, names):
    at = {"x1": 2, "x2": 3}
    rows = [r for r in data if r[0] == g and r[4] is not None and all(r[at[n]] is not None for n in names)]
    x = np.array([[1.0] + [r[at[n]] for n in names] for r in rows])
    y = np.array([r[4] for r in rows])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    s2 = e @ e / (len(y) - x.shape[1])
    cov = s2 * np.linalg.inv((x / x.std(axis=0).clip(1)).T @ (x / x.std(axis=0).clip(1)))
    se = np.sqrt(np.diag(cov)) / x.std(axis=0).clip(1)
    return rows, x, y, b, e, s2, se


@pytest.mark.parametrize("g", ["a", "b"])
@pytest.mark.parametrize("model", MODELS, ids=lambda m: m.name)
def test_against_least_squares(data, fits, g, model):
    rows, x, y, b, e, s2, se = lstsq(data, g, model.covariates)
    terms = reg.tidy(fits).where((F.col("g") == g) & (F.col("model") == model.name)).collect()
    assert [t.term for t in terms] == ["(Intercept)", *model.covariates]
    for t, want, err in zip(terms, b, se):
        assert t.estimate == pytest.approx(want, rel=1e-7)
        assert t.std_error == pytest.approx(err, rel=1e-7)
        assert t.statistic == pytest.approx(want / err, rel=1e-6)
    one = reg.glance(fits).where((F.col("g") == g) & (F.col("model") == model.name)).first()
    n, k, ssr = len(y), len(model.covariates), float(e @ e)
    r2 = 1 - ssr / float(((y - y.mean()) ** 2).sum())
    assert one.nobs == n and one.df == k and one.df_residual == n - k - 1
    assert one.r_squared == pytest.approx(r2, rel=1e-9)
    assert one.adj_r_squared == pytest.approx(1 - (1 - r2) * (n - 1) / (n - k - 1), rel=1e-9)
    assert one.sigma == pytest.approx(math.sqrt(s2), rel=1e-9)
    assert one.deviance == pytest.approx(ssr, rel=1e-8)
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    assert (one.log_lik, one.aic) == (pytest.approx(ll, rel=1e-9), pytest.approx(-2 * ll + 2 * (k + 2), rel=1e-9))
    assert one.bic == pytest.approx(-2 * ll + math.log(n) * (k + 2), rel=1e-9)


def test_slope_of_one_covariate_has_the_p_value_of_the_correlation(df, fits):
    from panelwright.operators.aggregates import corr_test

    p = {r.g: r.p_value for r in corr_test(df, ["g"], "x1", "y", digits=12).collect()}
    for t in reg.tidy(fits).where("model = 'x1' and term = 'x1' and g in ('a', 'b')").collect():
        assert t.p_value == pytest.approx(p[t.g], abs=1e-9)


def test_too_few_rows_and_flat_covariates(fits):
    by = {(r.g, r.model): r for r in reg.glance(fits).collect()}
    assert by["few", "x1"].r_squared == 1.0 and by["few", "x1"].sigma is None
    # Two rows bear one covariate; the second is aliased.
    assert by["few", "both"].r_squared == 1.0 and by["few", "both"].sigma is None
    # A covariate that does not vary is aliased and explains nothing.
    assert by["flat", "x1"].r_squared == 0.0 and by["flat", "x1"].df == 0
    flat = {t.term: t.estimate for t in reg.tidy(fits).where("g = 'flat' and model = 'x1'").collect()}
    assert flat == {"(Intercept)": 2.5, "x1": None}


def test_diagnostics(data, df, fits):
    rows, x, y, b, e, s2, se = lstsq(data, "a", ("x1", "x2"))
    hat = np.diag(x @ np.linalg.pinv(x))
    out = reg.residuals(df, fits, MODELS, "y").where("g = 'a' and model = 'both'").orderBy("i").collect()
    order = np.argsort([r[1] for r in rows])
    assert len(out) == len(rows)
    for r, j in zip(out, order):
        assert r.resid == pytest.approx(e[j], rel=1e-6, abs=1e-6)
        assert r.hat == pytest.approx(hat[j], rel=1e-6)
        std = e[j] / math.sqrt(s2 * (1 - hat[j]))
        assert r.std_resid == pytest.approx(std, rel=1e-6)
        assert r.cooksd == pytest.approx(std**2 * hat[j] / (3 * (1 - hat[j])), rel=1e-5)
    assert sum(r.hat for r in out) == pytest.approx(3.0)
    assert sum(r.resid for r in out) == pytest.approx(0.0, abs=1e-4)


def test_new_rows_meet_their_own_model_only(data, df, fits):
    out = reg.augment(df, fits, MODELS)
    assert out.where("g = 'a'").count() == 16 * 3
    rows, x, y, b, e, s2, se = lstsq(data, "a", ("x1",))
    r = out.where("g = 'a' and i = 901 and model = 'x1'").first()
    assert r.fitted == pytest.approx(b[0] + b[1] * 80_000, rel=1e-9)
    q = 1 / len(y) + (80_000 - x[:, 1].mean()) ** 2 / ((x[:, 1] - x[:, 1].mean()) ** 2).sum()
    assert r.se_fit == pytest.approx(math.sqrt(s2 * q), rel=1e-8)
    # 97.5% point of t with 13 degrees of freedom.
    assert r.pred_upper - r.fitted == pytest.approx(2.160369 * math.sqrt(s2 * (1 + q)), rel=1e-6)
    assert out.where("g = 'a' and i = 900 and model = 'both'").first().fitted is None


def test_best_model_ties_and_gaps(spark, fits):
    best = reg.fits_long(reg.best_fits(fits))
    got = {r.g: r.model for r in best.collect()}
    by = {(r.g, r.model): r.criterion for r in reg.glance(fits).collect()}
    for g in ("a", "b"):
        assert by[g, got[g]] == max(by[g, m.name] for m in MODELS)
    # A model without criterion ("few" has no adjusted one) leaves its group without a best one.
    assert set(got) == {"a", "b", "flat"}
    twice = spark.createDataFrame([("t", float(i), float(i), float(i * i)) for i in range(6)], "g string, x1 double, x2 double, y double")
    ties = reg.best_fits(reg.fit_linear(twice, ["g"], "y", MODELS[:2]))
    assert {r.model for r in reg.fits_long(ties).collect()} == {"x1", "x2"}


def test_assigned_models(fits):
    kept = reg.fits_long(reg.assigned_fits(fits, "g", {"x1": ["a"], "both": ["b"]}))
    assert {(r.g, r.model) for r in kept.collect()} == {("a", "x1"), ("b", "both")}


def test_bands_and_long_predictions(spark, rows):
    augmented = spark.createDataFrame([("s", 100.0, 103.26, 10.0), ("s", None, 50.0, 1.0)], "g string, y double, fitted double, se_fit double")
    band = reg.fitted_band(augmented, "y").orderBy("fitted", ascending=False).first()
    assert (band.fitted_round, band.lower, band.upper, band.residual) == (103.0, 84.0, 123.0, -3.0)
    assert (band.ci_pc, band.residual_pc) == (37.8, -3.0)
    narrow = reg.fitted_band(augmented, "y", multiplier=1.0, digits=1).orderBy("fitted", ascending=False).first()
    assert (narrow.fitted_round, narrow.lower, narrow.upper) == (103.3, 93.0, 113.0)
    tall = reg.prediction_long(augmented, ["g"], "y")
    # The bounds lie around the rounded prediction and only there.
    assert rows(tall.select("series", "value", "lower", "upper")) == [
        ("Measured", 100.0, None, None),
        ("Measured", None, None, None),
        ("Predicted", 103.0, 83.4, 122.6),
        ("Predicted", 50.0, 48.04, 51.96),
    ]


def test_stars_from_rounded_p(spark):
    tidied = spark.createDataFrame(
        [("a", "m", "x", 1.0, 1.0, 1.0, 0.0496), ("a", "m", "(Intercept)", 1.0, 1.0, 1.0, 0.5)],
        "g string, model string, term string, estimate double, std_error double, statistic double, p_value double",
    )
    first = reg.coefficient_table(tidied, "y").first()
    assert (first.call, first.p_value, first.sig) == ("y ~ m", 0.05, "Not sig")
    assert reg.coefficient_table(tidied, "y", round_first=False).first().sig == "*"


def test_folds_against_least_squares(data, df):
    part = df.where("g = 'b'")
    got = {r.fold: r for r in reg.kfold_cv(part.withColumn("x3", F.sqrt("i")), "y", ["x1", "x2", "x3"], F.col("i") % 4, 4).collect()}
    rows = [r for r in data if r[0] == "b"]
    x = np.array([[1, r[2], r[3], math.sqrt(r[1])] for r in rows])
    y = np.array([r[4] for r in rows])
    fold = np.array([r[1] % 4 for r in rows])
    for f in range(4):
        b = np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]
        p = x[fold == f] @ b
        e = y[fold == f] - p
        assert got[f].n == len(e)
        assert got[f].rmse == pytest.approx(math.sqrt((e**2).mean()), rel=1e-7)
        assert got[f].mae == pytest.approx(abs(e).mean(), rel=1e-7)
        assert got[f].r_squared == pytest.approx(np.corrcoef(p, y[fold == f])[0, 1] ** 2, rel=1e-7)


def plain_least_squares(y, columns):
    """Columns taken in order, one that the ones before it determine left out; (kept, coefficients, std errors, sigma)."""
    kept, x = [], np.ones((len(y), 1))
    for j, c in enumerate(columns):
        rest = c - x @ np.linalg.lstsq(x, c, rcond=None)[0]
        if (rest**2).sum() > max(1e-12 * ((c - c.mean()) ** 2).sum(), 1e-14 * (c**2).sum()):
            kept.append(j)
            x = np.column_stack([x, c])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    free = len(y) - x.shape[1]
    sigma = math.sqrt(((y - x @ b) ** 2).sum() / free) if free > 0 else None
    errors = sigma * np.sqrt(np.diag(np.linalg.inv(x.T @ x))) if sigma else None
    return kept, b, errors, sigma


def test_aliased_terms_and_four_covariates_agree_with_a_plain_solver(spark):
    draw = np.random.default_rng(5)
    cases = {}
    for name in ("full", "sum", "twice", "constant", "short"):
        n = 4 if name == "short" else 60
        x = draw.normal(100, 20, (n, 4)) * np.array([1, 50, 0.01, 3])
        if name == "sum":
            x[:, 2] = 2 * x[:, 0] - 0.1 * x[:, 1] + 7
        if name == "twice":
            x[:, 1], x[:, 3] = x[:, 0] / 3, 1000 - x[:, 2]
        if name == "constant":
            x[:, 0] = 0.1
        cases[name] = x, x @ np.array([3, 0.2, 400, -1]) + draw.normal(0, 9, n)
    data = [(g, *map(float, x), float(y)) for g, (xs, ys) in cases.items() for x, y in zip(xs, ys)]
    df = spark.createDataFrame(data, "g string, x1 double, x2 double, x3 double, x4 double, y double").repartition(6)
    models = [reg.Model("four", ("x1", "x2", "x3", "x4")), reg.Model("one", ("x1",))]
    fits = reg.fit_linear(df, ["g"], "y", models)
    tidied = {(r.g, r.term): r for r in reg.tidy(fits).where("model = 'four'").collect()}
    glanced = {r.g: r for r in reg.glance(fits).where("model = 'four'").collect()}
    out = {}
    for g, (xs, ys) in cases.items():
        kept, b, errors, sigma = plain_least_squares(ys, list(xs.T))
        out[g] = {f"x{j + 1}" for j in range(4)} - {f"x{j + 1}" for j in kept}
        for place, term in enumerate(["(Intercept)", *[f"x{j + 1}" for j in kept]]):
            r = tidied[g, term]
            assert r.estimate == pytest.approx(b[place], rel=1e-6, abs=1e-5), (g, term)
            assert (r.std_error is None) if errors is None else r.std_error == pytest.approx(errors[place], rel=1e-6)
        for term in out[g]:
            assert tidied[g, term][3:] == (None, None, None, None)
        assert (glanced[g].df, glanced[g].df_residual) == (len(kept), len(ys) - len(kept) - 1)
        fitted = b[0] + xs[:, kept] @ b[1:]
        got = [r.fitted for r in reg.augment(df.where(F.col("g") == g), fits, models).where("model = 'four'").orderBy("x2", "x1").collect()]
        assert got == pytest.approx(fitted[np.lexsort((xs[:, 0], xs[:, 1]))].tolist(), rel=1e-7)
    assert out == {"full": set(), "sum": {"x3"}, "twice": {"x2", "x4"}, "constant": {"x1"}, "short": {"x4"}}
    named = {(r.g, r.term) for r in reg.aliased_terms(fits).where("model = 'four'").collect()}
    assert named == {(g, t) for g, terms in out.items() for t in terms}


def test_applied_models_move_no_rows_and_compile(spark):
    """Few groups: the models are broadcast although Spark takes their source for large, and the row formulas stay below 8,000 bytes."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(200_000).select(
            F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("g"), F.col("id").alias("i"), (F.col("id") % 101).cast("double").alias("x1"),
            (F.col("id") % 37).cast("double").alias("x2"), (F.col("id") % 101 * 3 + F.col("id") % 11).cast("double").alias("y"),
        )
        out = reg.residuals(rows, reg.fit_linear(rows, ["g"], "y", MODELS), MODELS, "y")
        digits = {"resid": 2, "hat": 7, "std_resid": 5, "loo_sigma": 2, "cooksd": 7}
        plan = round_columns(out.select("i", "model", *digits), digits)._jdf.queryExecution().executedPlan()
        assert "BroadcastHashJoin" in plan.toString() and "SortMergeJoin" not in plan.toString()
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
        assert 0 < max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
        assert out.count() == 3 * 200_000  # a null group has models as well
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
