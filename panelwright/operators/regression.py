"""Small linear models for every group, from one aggregation of moments.

``fit_linear`` turns the rows into one row per group that holds an array of
fitted models. Only centred moments are shuffled, merged map-side first, so a
group's size does not matter. All other functions read the ``fits`` array:

* ``tidy``, ``glance``: tables of coefficients and of fit statistics
* ``augment``: fitted values and bands on any rows of the same groups
* ``residuals``: diagnostics on the training rows
* ``best_fits``, ``assigned_fits``: keep some of a group's models
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import percent, ratio
from ..functions.labels import call_label, recode, significance_stars
from ..functions.nulls import complete
from ..functions.rounding import round_columns, round_half_even
from ..functions.tails import f_upper_p, t_quantile_sql, t_two_sided_p
from ..session import hold
from .groups import attach_groups

SINGULAR = 1e-12
"""A covariate of which the ones before it leave less than this share is aliased."""
FLAT = 1e-14
"""A covariate whose squares around the mean are below this share of its squares does not vary."""


@dataclass(frozen=True)
class Model:
    """A named linear model: response ~ covariates."""

    name: str
    covariates: tuple[str, ...]


def _products(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _masked(df: DataFrame, keys: list[str], response: str, models: list[Model]) -> DataFrame:
    """Per model: its variables as doubles, null wherever one of them is missing."""
    cols = {}
    for t, m in enumerate(models):
        whole = " AND ".join(f"`{c}` IS NOT NULL" for c in (response, *m.covariates))
        for name, source in (("y", response), *((f"x{i}", c) for i, c in enumerate(m.covariates))):
            cols[f"_{t}_{name}"] = F.expr(f"CASE WHEN {whole} THEN CAST(`{source}` AS DOUBLE) END")
    return df.select(*keys, *[c.alias(n) for n, c in cols.items()])


def _moments(t: int, model: Model) -> list[Column]:
    """Count, means and centred products of one model's masked variables."""
    y, k = f"_{t}_y", len(model.covariates)
    cells = {f"_{t}_n": f"count({y})", f"_{t}_my": f"avg({y})", f"_{t}_syy": f"regr_sxx({y}, {y})"}
    for i in range(k):
        cells[f"_{t}_m{i}"] = f"avg(_{t}_x{i})"
        cells[f"_{t}_s{i}y"] = f"regr_sxy({y}, _{t}_x{i})"
    for i, j in _products(k):
        cells[f"_{t}_s{i}_{j}"] = f"regr_sxy(_{t}_x{j}, _{t}_x{i})"
    return [F.expr(c).alias(n) for n, c in cells.items()]


def fit_linear(df: DataFrame, keys: list[str], response: str, models: list[Model]) -> DataFrame:
    """One row per group: ``fits``, an array with a struct per model, and ``n_rows``.

    Each model uses the rows that are complete for its own variables. A
    covariate that the ones before it determine in a group is aliased there: its
    coefficient is null, the others are those of the model without it. A model
    without rows has null coefficients.
    """
    cols = [F.count(F.lit(1)).alias("n_rows")]
    for t, model in enumerate(models):
        cols += _moments(t, model)
    return _fits_from_moments(_masked(df, keys, response, models).groupBy(*keys).agg(*cols), keys, models)


def _swept(s: str, k: str, n: str, means: str) -> str:
    """Cholesky steps over the flat matrix ``s`` of centred products of k covariates and the response.

    Each covariate in turn is swept out of all others, unless next to nothing of
    it is left by those before it: then it is aliased and stays out, as the
    pivoting of least-squares programs has it. Of the covariates that are in,
    the matrix ends up with their inverse, their slopes in the last column and
    what they leave of the response in the last cell. Gives (a: matrix, kept).
    """
    row, col, size = f"(c div ({k} + 1))", f"(c % ({k} + 1))", f"({k} + 1)"
    at = lambda i, j: f"get(acc.a, CAST({i} * {size} + {j} AS INT))"
    pivot = at("j", "j")
    cell = (
        f"CASE WHEN {row} = j AND {col} = j THEN 1D / {pivot} WHEN {row} = j THEN v / {pivot} WHEN {col} = j THEN -v / {pivot} "
        f"ELSE v - {at(row, 'j')} * {at('j', col)} / {pivot} END"
    )
    first = f"get({s}, CAST(j * {size} + j AS INT))"
    step = (
        f"CASE WHEN {first} > {FLAT}D * {n} * get({means}, j) * get({means}, j) AND {pivot} > {SINGULAR}D * {first} "
        f"THEN named_struct('a', transform(acc.a, (v, c) -> {cell}), 'kept', concat(acc.kept, array(true))) "
        "ELSE named_struct('a', acc.a, 'kept', concat(acc.kept, array(false))) END"
    )
    start = f"named_struct('a', {s}, 'kept', CAST(array() AS ARRAY<BOOLEAN>))"
    return f"aggregate(sequence(0, {k} - 1), {start}, (acc, j) -> {step})"


def _fits_from_moments(wide: DataFrame, keys: list[str], models: list[Model]) -> DataFrame:
    """Solve the normal equations of every model: one formula over arrays, whatever the number of covariates."""

    def moments(t: int, model: Model) -> str:
        k = len(model.covariates)
        name = lambda i, j: f"_{t}_syy" if i == j == k else f"_{t}_s{min(i, j)}y" if max(i, j) == k else f"_{t}_s{min(i, j)}_{max(i, j)}"
        cells = ", ".join(name(i, j) for i in range(k + 1) for j in range(k + 1))
        return (
            f"named_struct('model', '{model.name}', 'k', {k}, 'covariates', array({', '.join(repr(c) for c in model.covariates)}), "
            f"'n', _{t}_n, 'my', _{t}_my, 'syy', _{t}_syy, 'means', array({', '.join(f'_{t}_m{i}' for i in range(k))}), 's', array({cells}))"
        )

    def struct(**fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {c}" for n, c in fields.items()) + ")"

    at = "get(w.a, CAST({0} * (m.k + 1) + {1} AS INT))"
    slopes = f"transform(w.kept, (x, i) -> CASE WHEN x THEN {at.format('i', 'm.k')} END)"
    both = f"CASE WHEN x AND z THEN {at.format('i', 'j')} ELSE 0D END"
    solved = struct(
        model="m.model", k="m.k", covariates="m.covariates", n="m.n", my="m.my", syy="m.syy", means="m.means", kept="w.kept",
        rank="size(filter(w.kept, x -> x))", slopes=slopes, inverse=f"transform(w.kept, (x, i) -> transform(w.kept, (z, j) -> {both}))",
        ssr=f"greatest({at.format('m.k', 'm.k')}, 0D)",
    )
    rest = struct(
        model="m.model", k="m.k", rank="m.rank", covariates="m.covariates", aliased="filter(m.covariates, (c, i) -> NOT get(m.kept, i))", n="m.n",
        df_residual="m.n - m.rank - 1",
        coef="concat(array(aggregate(zip_with(m.slopes, m.means, (b, x) -> coalesce(b * x, 0D)), m.my, (a, e) -> a - e)), m.slopes)",
        means="m.means", inverse="m.inverse", syy="m.syy", ssr="m.ssr", sigma="CASE WHEN m.n - m.rank - 1 > 0 THEN sqrt(m.ssr / (m.n - m.rank - 1)) END",
        r_squared="1 - try_divide(m.ssr, m.syy)",
    )
    adjusted = "CASE WHEN m.df_residual > 0 THEN 1 - (1 - m.r_squared) * (m.n - 1) / m.df_residual END"
    full = {c: f"m.{c}" for c in re.findall(r"'(\w+)', ", rest) if c != "k"} | {"k": "m.k"}
    last = struct(**full, adj_r_squared=adjusted, criterion=f"CASE WHEN m.k = 1 THEN m.r_squared ELSE {adjusted} END")
    steps = {
        "_m": f"array({', '.join(moments(t, m) for t, m in enumerate(models))})",
        "_s": f"transform(_m, m -> transform(array({_swept('m.s', 'm.k', 'm.n', 'm.means')}), w -> {solved})[0])",
        "_r": f"transform(_s, m -> {rest})",
        "fits": f"transform(_r, m -> {last})",
    }
    for name, text in steps.items():
        wide = wide.withColumn(name, F.expr(text))
    return wide.select(*keys, "n_rows", "fits")


def _keys(fits: DataFrame) -> list[str]:
    return [c for c in fits.columns if c not in ("fits", "n_rows")]


def fits_long(fits: DataFrame) -> DataFrame:
    """One row per (group, model)."""
    keys = _keys(fits)
    return fits.select(*keys, F.explode("fits").alias("fit")).select(*keys, "fit.*")


def aliased_terms(fits: DataFrame) -> DataFrame:
    """(keys, model, term) of the covariates that the ones before them determine in their group."""
    keys = _keys(fits)
    return fits_long(fits).select(*keys, "model", F.explode("aliased").alias("term"))


def tidy(fits: DataFrame) -> DataFrame:
    """Coefficient table: term, estimate, std_error, statistic, p_value; nulls for an aliased term."""
    keys = _keys(fits)
    rows = fits_long(fits)
    # Variance factor of the intercept: the leverage of the origin.
    origin = (
        "aggregate(zip_with(means, inverse, (m, row) -> m * aggregate(zip_with(row, means, (v, n) -> v * n), 0D, "
        "(a, e) -> a + e)), 1D / n, (a, e) -> a + e)"
    )
    terms = (
        "transform(coef, (b, i) -> named_struct('term', CASE WHEN i = 0 THEN '(Intercept)' ELSE get(covariates, i - 1) END, "
        "'estimate', b, 'std_error', CASE WHEN b IS NOT NULL THEN sigma * sqrt(CASE WHEN i = 0 THEN origin ELSE get(get(inverse, i - 1), i - 1) END) END))"
    )
    flat = (
        rows.withColumn("origin", F.expr(origin))
        .select(*keys, "model", "df_residual", F.explode(F.expr(terms)).alias("t"))
        .select(*keys, "model", "df_residual", "t.*")
    )
    stat = flat.withColumn("statistic", ratio("estimate", "std_error"))
    return stat.withColumn("p_value", t_two_sided_p("statistic", "df_residual")).drop("df_residual")


def glance(fits: DataFrame) -> DataFrame:
    """Fit statistics per (group, model)."""
    keys = _keys(fits)
    rows = fits_long(fits)
    n, k, df, ssr = F.col("n"), F.col("rank"), F.col("df_residual"), F.col("ssr")
    f = F.when((df > 0) & (k > 0), ratio((F.col("syy") - ssr) / F.greatest(k, F.lit(1)), ssr / df))
    p = f_upper_p("statistic", "rank", "df_residual")
    loglik = F.when(ssr > 0, -n / 2 * (F.log(ssr / n) + math.log(2 * math.pi) + 1))
    return (
        rows.withColumn("statistic", f)
        .withColumns({"p_value": p, "log_lik": loglik})
        .select(
            *keys,
            "model",
            "r_squared",
            "adj_r_squared",
            "sigma",
            "statistic",
            "p_value",
            k.alias("df"),
            "log_lik",
            (-2 * F.col("log_lik") + 2 * (k + 2)).alias("aic"),
            (-2 * F.col("log_lik") + F.log(n.cast("double")) * (k + 2)).alias("bic"),
            ssr.alias("deviance"),
            df.alias("df_residual"),
            n.alias("nobs"),
            "criterion",
        )
    )


def _flat(fits: DataFrame, models: list[Model], extra: tuple[str, ...]) -> DataFrame:
    """One row per (group, model), its numbers in plain columns ``_f_..``; ``_f_t`` is the model's place in ``models``.

    Coefficients, means and inverse are filled up with zeros to the longest
    model. A fit that is not of ``models`` has no base and no share.
    """
    width = max(len(m.covariates) for m in models)
    known = f"f.model IN ({', '.join(f"'{m.name}'" for m in models)})"
    cells = {
        "model": "f.model",
        "t": "CASE " + " ".join(f"WHEN f.model = '{m.name}' THEN {t}" for t, m in enumerate(models)) + " END",
        "k": "CASE " + " ".join(f"WHEN f.model = '{m.name}' THEN {len(m.covariates)}" for m in models) + " ELSE 0 END",
        "base": f"CASE WHEN {known} THEN get(f.coef, 0) END",
        "share": f"CASE WHEN {known} THEN try_divide(1D, f.n) END",
    }
    cells |= {f"b{i}": f"coalesce(get(f.coef, {i + 1}), 0D)" for i in range(width)}
    cells |= {f"m{i}": f"CASE WHEN size(f.means) > {i} THEN get(f.means, {i}) ELSE 0D END" for i in range(width)}
    cells |= {f"v{i}_{j}": f"coalesce(get(get(f.inverse, {i}), {j}), 0D)" for i, j in _products(width)}
    cells |= {c: f"f.{c}" for c in extra}
    each = fits.select(*_keys(fits), F.explode("fits").alias("f"))
    return each.select(*_keys(fits), *[F.expr(c).alias(f"_f_{n}") for n, c in cells.items()])


def _covariate(models: list[Model], i: int) -> Column:
    """The column that the model of the row's fit has for its covariate ``i``; zero if it has fewer."""
    places: dict[str, list[str]] = {}
    for t, m in enumerate(models):
        if i < len(m.covariates):
            places.setdefault(m.covariates[i], []).append(str(t))
    branches = " ".join(f"WHEN _f_t IN ({', '.join(ts)}) THEN CAST(`{c}` AS DOUBLE)" for c, ts in places.items())
    return F.expr(f"CASE {branches} ELSE 0D END")


def _leverage(width: int) -> str:
    """Products that a shorter model has not are zero; guarded, as an infinite covariate times zero is no number."""
    square = lambda i: f"_f_d{i} * _f_d{i} * _f_v{i}_{i}"
    cross = lambda i, j: f"CASE WHEN _f_k > {j} THEN 2D * _f_d{i} * _f_d{j} * _f_v{i}_{j} ELSE 0D END"
    return " + ".join(["_f_share", *[square(i) if i == j else cross(i, j) for i, j in _products(width)]])


def _applied(rows: DataFrame, fits: DataFrame, models: list[Model], extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows x models of their own group, with fitted value, leverage and the ``extra`` fields of the fit as ``_f_..``.

    An equi join on the group: no row meets the model of another group. The
    models, one row each, are held and counted before the join is planned:
    their own long formulas run once, and Spark knows their bytes, so it does
    not first move all rows to the few tasks that the groups make. Models
    differ in the columns that they take for x0, x1, .. only; one formula
    serves them all. Written out for every model it makes a method that is too
    long for the JVM to compile, and every row is interpreted.
    """
    table = hold(_flat(fits, models, extra))
    table.count()
    width = max(len(m.covariates) for m in models)
    joined = attach_groups(rows, table, _keys(fits), "inner")
    joined = joined.withColumns({f"_f_x{i}": _covariate(models, i) for i in range(width)})
    centred = joined.withColumns({f"_f_d{i}": F.col(f"_f_x{i}") - F.col(f"_f_m{i}") for i in range(width)})
    fitted = " + ".join(["_f_base", *[f"_f_b{i} * _f_x{i}" for i in range(width)]])
    return centred.withColumns({"fitted": F.expr(fitted), "_lev": F.expr(_leverage(width))})


def _without_fit(applied: DataFrame) -> DataFrame:
    return applied.drop("_lev", *[c for c in applied.columns if c.startswith("_f_")])


def augment(
    rows: DataFrame,
    fits: DataFrame,
    models: list[Model],
    level: float | None = 0.95,
) -> DataFrame:
    """Fitted value, its standard error and prediction interval on new rows.

    The interval's t-quantile is worked out once per model, not per row.
    """
    if level is not None:
        quantiles = F.expr(f"transform(fits, f -> {t_quantile_sql(level, 'f.df_residual')})")
        zipped = fits.select(*_keys(fits), "n_rows", "fits", quantiles.alias("_q"))
        fits = zipped.withColumn(
            "fits", F.zip_with("fits", "_q", lambda f, q: f.withField("quantile", q))
        ).drop("_q")
    out = _applied(rows, fits, models, ("sigma",) if level is None else ("sigma", "quantile"))
    columns = {"model": F.col("_f_model"), "se_fit": F.expr("_f_sigma * sqrt(_lev)")}
    if level is not None:
        reach = "_f_quantile * _f_sigma * sqrt(1 + _lev)"
        columns |= {"pred_lower": F.expr(f"fitted - {reach}"), "pred_upper": F.expr(f"fitted + {reach}")}
    return _without_fit(out.withColumns(columns))


def residuals(rows: DataFrame, fits: DataFrame, models: list[Model], response: str) -> DataFrame:
    """Residual diagnostics of the training rows: resid, hat, std_resid, loo_sigma, cooksd."""
    out = _applied(rows.where(F.col(response).isNotNull()), fits, models, ("sigma", "df_residual", "ssr", "rank"))
    h, sigma, df = F.col("_lev"), F.col("_f_sigma"), F.col("_f_df_residual")
    known = out.where(F.col("fitted").isNotNull())
    e, free = F.col("_f_e"), F.col("_f_free")
    steps = known.withColumns({"_f_e": F.col(response) - F.col("fitted"), "_f_free": F.when(1 - h > 1e-12, 1 - h)})
    others = F.greatest(F.col("_f_ssr") - e * e / free, F.lit(0.0))
    without = F.when((df > 1) & free.isNotNull(), F.sqrt(others / (df - 1)))
    done = steps.withColumns(
        {
            "model": F.col("_f_model"),
            "resid": e,
            "hat": h,
            "std_resid": ratio(e, sigma * F.sqrt(free)),
            "loo_sigma": without,
            "cooksd": ratio(e * e * h, (F.col("_f_rank") + 1) * sigma * sigma * free * free),
        }
    )
    return _without_fit(done)


def best_fits(fits: DataFrame) -> DataFrame:
    """Keep the models that reach the group's best criterion, ties included.

    R-squared counts for one covariate, adjusted R-squared for more. A model
    without criterion leaves the group without a best one.
    """
    criteria = F.transform("fits", lambda f: f["criterion"])
    known = ~F.exists(criteria, lambda c: c.isNull())
    kept = F.filter("fits", lambda f: known & (f["criterion"] == F.array_max(criteria)))
    return fits.withColumn("fits", kept).where(F.size("fits") > 0)


def assigned_fits(fits: DataFrame, key: str, assignment: dict[str, list[str]]) -> DataFrame:
    """Keep the model that is assigned to the group: model name -> groups."""
    chosen = recode(key, {group: model for model, groups in assignment.items() for group in groups})
    kept = F.filter("fits", lambda f: f["model"] == chosen)
    return fits.withColumn("fits", kept).where(F.size("fits") > 0)


def model_summary_table(glanced: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Rounded fit statistics; the stars are taken from the unrounded p-value."""
    digits = digits or {"r_squared": 2, "adj_r_squared": 2, "p_value": 4}
    return round_columns(glanced.withColumn("sig", significance_stars("p_value")), digits)


def coefficient_table(
    tidied: DataFrame, response: str, digits: dict[str, int] | None = None, round_first: bool = True
) -> DataFrame:
    """Slopes with the model call; the stars are taken from the already rounded p-value."""
    digits = digits or {c: 3 for c in ("estimate", "std_error", "statistic", "p_value")}
    slopes = tidied.where(F.col("term") != "(Intercept)").withColumn("call", call_label(response, "model"))
    if round_first:
        return round_columns(slopes, digits).withColumn("sig", significance_stars("p_value"))
    return round_columns(slopes.withColumn("sig", significance_stars("p_value")), digits)


def fitted_band(
    augmented: DataFrame, response: str, multiplier: float = 1.96, digits: int = 0
) -> DataFrame:
    """Rounded fit, fit +- multiplier standard errors, width in percent, residual and residual percent."""
    fit, se = F.col("fitted"), F.col("se_fit")
    bands = augmented.withColumns(
        {
            "fitted_round": round_half_even(fit, digits),
            "lower": round_half_even(fit - multiplier * se, 0),
            "upper": round_half_even(fit + multiplier * se, 0),
            "residual": round_half_even(F.col(response) - fit, 0),
        }
    )
    return bands.withColumns(
        {
            "ci_pc": percent(F.col("upper") - F.col("lower"), "fitted"),
            "residual_pc": percent("residual", response),
        }
    )


def prediction_long(augmented: DataFrame, ids: list[str], response: str, multiplier: float = 1.96) -> DataFrame:
    """Measured and predicted values as rows; bounds around the rounded prediction only."""
    tall = augmented.select(
        *ids, "se_fit", F.col(response).cast("double").alias("Measured"), F.col("fitted").alias("Predicted")
    ).unpivot([*ids, "se_fit"], ["Measured", "Predicted"], "series", "_value")
    tall = tall.withColumn("value", round_half_even("_value", 0)).drop("_value")
    reach = multiplier * F.col("se_fit")
    predicted = F.col("series") == "Predicted"
    bounds = tall.withColumns(
        {
            "lower": F.when(predicted, round_half_even(F.col("value") - reach, 2)),
            "upper": F.when(predicted, round_half_even(F.col("value") + reach, 2)),
        }
    )
    return bounds.withColumn("ci_pc", percent(F.col("upper") - F.col("lower"), "value"))


def fit_r2_by_group(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Line of y on x per group and how much it explains."""
    return df.groupBy(*keys).agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r_squared"),
    )


def _merge_moments(table: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Moments of several parts -> moments of their union, one row per key.

    The parts of a key are few (folds), so they are gathered and combined
    around the merged means, which keeps the precision of centred moments.
    """
    names = [c for c in table.columns if c not in keys]
    means = ["_0_my", *[f"_0_m{i}" for i in range(k)]]

    def total(term: str) -> Column:
        return F.expr(f"aggregate(_parts, 0D, (acc, p) -> acc + {term})")

    def product(cell: str, a: str, b: str) -> Column:
        return total(f"p.{cell} + p._0_n * (p.{a} - {a}) * (p.{b} - {b})")

    gathered = table.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_parts"))
    sized = gathered.withColumn("_0_n", total("p._0_n"))
    centred = sized.withColumns({m: total(f"p._0_n * p.{m}") / F.col("_0_n") for m in means})
    cells = {"_0_syy": product("_0_syy", "_0_my", "_0_my")}
    cells |= {f"_0_s{i}y": product(f"_0_s{i}y", f"_0_m{i}", "_0_my") for i in range(k)}
    cells |= {f"_0_s{i}_{j}": product(f"_0_s{i}_{j}", f"_0_m{i}", f"_0_m{j}") for i, j in _products(k)}
    return centred.withColumns(cells).withColumn("_0_n", F.col("_0_n").cast("bigint")).drop("_parts")


def kfold_cv(df: DataFrame, response: str, covariates: list[str], fold: Column, folds: int) -> DataFrame:
    """RMSE, R-squared and mean absolute error of a linear model, per held-out fold and (null fold) their means.

    The rows are read once for the moments of each fold. The training set of a
    fold is the union of the other folds, so its moments are merged from
    theirs, and the models, one row per fold, are joined to the held-out rows.
    """
    model = Model("cv", tuple(covariates))
    rows = df.where(complete(response, *covariates)).withColumn("fold", fold.cast("int"))
    parts = _masked(rows, ["fold"], response, [model]).groupBy("fold").agg(*_moments(0, model))
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))
    training = _merge_moments(parts.withColumn("fold", F.explode(others)), ["fold"], len(covariates))
    fits = _fits_from_moments(training.withColumn("n_rows", F.col("_0_n")), ["fold"], [model])
    tested = _applied(rows, fits, [model]).withColumn("_e", F.col(response) - F.col("fitted"))
    scores = tested.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.regr_r2(F.col(response), F.col("fitted")).alias("r_squared"),
        F.avg(F.abs("_e")).alias("mae"),
    )
    # Each fold counts for itself and for the whole.
    both = scores.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))))
    means = [F.avg(c).alias(c) for c in ("rmse", "r_squared", "mae")]
    return both.groupBy("fold").agg(F.sum("n").alias("n"), *means)
