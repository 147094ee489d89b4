"""Tail probabilities and quantiles as Spark SQL expressions.

The functions take column names (or other SQL text) and build one SQL
expression each, so a formula of a few hundred nodes costs one call to the JVM.

One method serves all degrees of freedom. With y = sqrt(n ln(1 + k f / n)) the
density of F(k, n) is in proportion to
``y (n (1 - exp(-y^2 / n)))^(k/2 - 1) exp(-y^2 / 2)``, close to a normal curve
for every n; t is the case k = 1, f = t^2. The tail is the ratio of two
integrals of it. For t the whole is known, sqrt(n pi) / 2 times a ratio of
gamma functions, and the tail is one sum over 32 Gauss nodes, held as a literal
array; for F both are summed by the double-exponential rule. Errors are below
1e-11.
"""

from __future__ import annotations

import math

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column
from pyspark.sql import functions as F

_FIRST, _STEP, _NODES = -4.5, 0.05, 152
"""Nodes s = exp(x - exp(-x)) of the rule, x from _FIRST in steps of _STEP."""
_NEWTON = 8

_REACH = 62.0
"""A t tail from y on is cut where exp(-(z^2 - y^2) / 2) is exp(-31)."""
_GAUSS = "array(" + ", ".join(f"named_struct('x', {(x + 1) / 2!r}D, 'w', {w / 2!r}D)" for x, w in zip(*(a.tolist() for a in leggauss(32)))) + ")"
_SHIFT = 16
# gamma(z + 1/2) / gamma(z) = sqrt(z) times this series in 1 / z.
_GAMMA_SERIES = (1, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)


def _let(name: str, value: str, body: str) -> str:
    """Bind a value once and use it by name, so that formulas do not multiply when they nest."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _density_sql(y: str, k: str, n: str) -> str:
    return f"({y}) * pow({n} * -expm1(-({y}) * ({y}) / {n}), {k} / 2D - 1D) * exp(-({y}) * ({y}) / 2D)"


def _mass_sql(start: str, k: str, n: str) -> str:
    """Integral of the density from ``start`` on; all three are names or numbers."""
    node = _let(
        "x",
        f"{_FIRST!r}D + {_STEP!r}D * i",
        _let("s", "exp(x - exp(-x))", f"{_density_sql(f'({start} + s)', k, n)} * s * (1D + exp(-x))"),
    )
    return f"({_STEP!r}D * aggregate(sequence(0, {_NODES - 1}), 0D, (sum, i) -> sum + {node}))"


def f_upper_sql(f: str, df1: str, df2: str) -> str:
    """P(F > f); null when f is null or a degree of freedom is below 1."""
    tail = f"least({_mass_sql('y0', 'k', 'n')} / {_mass_sql('0D', 'k', 'n')}, 1D)"
    start = _let("y0", "sqrt(n * log1p(k * f / n))", tail)
    choice = f"CASE WHEN f IS NULL OR k < 1D OR n < 1D OR k IS NULL OR n IS NULL THEN NULL WHEN f <= 0D THEN 1D ELSE {start} END"
    return _let("f", f"CAST({f} AS DOUBLE)", _let("k", f"CAST({df1} AS DOUBLE)", _let("n", f"CAST({df2} AS DOUBLE)", choice)))


def _t_tail_sql(y: str, n: str) -> str:
    """Integral of the density for k = 1 from ``y`` on."""
    z = f"({y} + d * p.x)"
    term = f"p.w * {z} / sqrt({n} * -expm1(-{z} * {z} / {n})) * exp(-{z} * {z} / 2D)"
    return _let("d", f"sqrt({y} * {y} + {_REACH!r}D) - {y}", f"(d * aggregate({_GAUSS}, 0D, (sum, p) -> sum + {term}))")


def _t_whole_sql(n: str) -> str:
    """Integral of the density for k = 1 over all y: the gamma ratio is taken at n/2 + 16, where its series is short, and carried back."""
    back = " * ".join(f"(({n} + {2 * j + 1}D) / ({n} + {2 * j}D))" for j in range(_SHIFT))
    z = f"({n} / 2D + {_SHIFT}D)"
    series = repr(_GAMMA_SERIES[-1]) + "D"
    for c in reversed(_GAMMA_SERIES[:-1]):
        series = f"({series} / {z} + {float(c)!r}D)"
    return f"({math.sqrt(math.pi) / 2!r}D * sqrt({n} / {z}) * {back} / {series})"


def t_two_sided_sql(t: str, df: str) -> str:
    """P(|T| > |t|); null when df < 1."""
    tail = _let("y", "sqrt(n * log1p(t * t / n))", f"least({_t_tail_sql('y', 'n')} / {_t_whole_sql('n')}, 1D)")
    choice = f"CASE WHEN t IS NULL OR n IS NULL OR n < 1D THEN NULL WHEN t = 0D THEN 1D ELSE {tail} END"
    return _let("t", f"CAST({t} AS DOUBLE)", _let("n", f"CAST({df} AS DOUBLE)", choice))


def t_quantile_sql(level: float, df: str) -> str:
    """The t with P(|T| > t) = 1 - level (0.95 -> the usual 97.5% point), by Newton's rule on the scale of y."""
    alpha = 1 - level
    density = "y / sqrt(n * -expm1(-y * y / n)) * exp(-y * y / 2D)"
    ahead = f"y + ({_t_tail_sql('y', 'n')} - {alpha!r}D * whole) / ({density})"
    start = normal_quantile_sql(f"{1 - alpha / 2!r}D")
    root = f"aggregate(sequence(1, {_NEWTON}), {start}, (y, j) -> {ahead}, y -> sqrt(n * expm1(y * y / n)))"
    choice = f"CASE WHEN n >= 1D THEN {_let('whole', _t_whole_sql('n'), root)} END"
    return _let("n", f"CAST({df} AS DOUBLE)", choice)


# Wichura's algorithm AS 241 (PPND16), numerator and denominator
# of the central, middle and far range, lowest power first.
CENTRAL = (
    (
        3.3871328727963666080e0,
        1.3314166789178437745e2,
        1.9715909503065514427e3,
        1.3731693765509461125e4,
        4.5921953931549871457e4,
        6.7265770927008700853e4,
        3.3430575583588128105e4,
        2.5090809287301226727e3,
    ),
    (
        1.0,
        4.2313330701600911252e1,
        6.8718700749205790830e2,
        5.3941960214247511077e3,
        2.1213794301586595867e4,
        3.9307895800092710610e4,
        2.8729085735721942674e4,
        5.2264952788528545610e3,
    ),
)
MIDDLE = (
    (
        1.42343711074968357734e0,
        4.63033784615654529590e0,
        5.76949722146069140550e0,
        3.64784832476320460504e0,
        1.27045825245236838258e0,
        2.41780725177450611770e-1,
        2.27238449892691845833e-2,
        7.74545014278341407640e-4,
    ),
    (
        1.0,
        2.05319162663775882187e0,
        1.67638483018380384940e0,
        6.89767334985100004550e-1,
        1.48103976427480074590e-1,
        1.51986665636164571966e-2,
        5.47593808499534494600e-4,
        1.05075007164441684324e-9,
    ),
)
FAR = (
    (
        6.65790464350110377720e0,
        5.46378491116411436990e0,
        1.78482653991729133580e0,
        2.96560571828504891230e-1,
        2.65321895265761230930e-2,
        1.24266094738807843860e-3,
        2.71155556874348757815e-5,
        2.01033439929228813265e-7,
    ),
    (
        1.0,
        5.99832206555887937690e-1,
        1.36929880922735805310e-1,
        1.48753612908506148525e-2,
        7.86869131145613259100e-4,
        1.84631831751005468180e-5,
        1.42151175831644588870e-7,
        2.04426310338993978564e-15,
    ),
)


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}D)"
    return out


def _quotient(pair: tuple, x: str) -> str:
    return f"({_polynomial(pair[0], x)} / {_polynomial(pair[1], x)})"


def normal_quantile_sql(p: str) -> str:
    """The z with P(Z < z) = p, for 0 < p < 1; null otherwise."""
    # Written out, not bound by name: this one runs on every row and compiles.
    q = f"(({p}) - 0.5D)"
    r = f"sqrt(-ln(CASE WHEN {q} < 0D THEN ({p}) ELSE 1D - ({p}) END))"
    size = f"CASE WHEN {r} <= 5D THEN {_quotient(MIDDLE, f'({r} - 1.6D)')} ELSE {_quotient(FAR, f'({r} - 5D)')} END"
    inner = f"{q} * {_quotient(CENTRAL, f'(0.180625D - {q} * {q})')}"
    return (
        f"CASE WHEN NOT (({p}) > 0D AND ({p}) < 1D) THEN NULL WHEN abs({q}) <= 0.425D THEN {inner} "
        f"WHEN {q} < 0D THEN -({size}) ELSE {size} END"
    )


def t_two_sided_p(t: str, df: str) -> Column:
    return F.expr(t_two_sided_sql(t, df))


def t_quantile(level: float, df: str) -> Column:
    return F.expr(t_quantile_sql(level, df))


def normal_quantile(p: str) -> Column:
    return F.expr(normal_quantile_sql(p))


def f_upper_p(f: str, df1: int | str, df2: str) -> Column:
    """P(F > f) for any numerator degrees of freedom."""
    return F.expr(f_upper_sql(f, str(df1), df2))
