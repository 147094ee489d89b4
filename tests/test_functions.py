import math
import statistics

import pytest
from pyspark.sql import functions as F

from panelwright.functions import arith, calendar, labels, nulls, rounding, tails


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "value,digits,want",
    [(2.5, 0, 2.0), (3.5, 0, 4.0), (-2.5, 0, -2.0), (0.15, 1, 0.2), (0.25, 1, 0.2), (2.675, 2, 2.68), (1234.5, -2, 1200.0)],
)
def test_half_even(spark, value, digits, want):
    assert one(spark, rounding.round_half_even(F.lit(value), digits)) == want


def test_rounding_ignores_summation_noise(spark):
    # 0.1 + 0.2 style noise around a tie must not decide the result.
    assert one(spark, rounding.round_half_even(F.lit(0.125 + 1e-12), 2)) == 0.12
    assert one(spark, rounding.round_half_even(F.lit(0.125 - 1e-12), 2)) == 0.12


@pytest.mark.parametrize("value,digits,want", [(1.49999996, 0, 1.0), (1.50000004, 0, 2.0), (2.4999999, 0, 2.0), (2.5000001, 0, 3.0), (1e8 + 0.45, 0, 1e8), (0.12499996, 2, 0.12), (-0.4, 0, 0.0), (None, 1, None)])
def test_values_beside_a_tie_are_rounded_once(spark, value, digits, want):
    got = spark.createDataFrame([(value,)], "x double").select(rounding.round_half_even("x", digits), rounding.round_half_even(F.col("x"), digits)).first()
    assert tuple(got) == (want, want) and (want != 0 or math.copysign(1, got[0]) == 1)


def test_truncation_goes_to_zero_and_overflow_raises(spark):
    assert one(spark, rounding.truncate_int(F.lit(-2.7))) == -2
    assert one(spark, rounding.truncate_int(F.lit(2.7))) == 2
    assert one(spark, rounding.truncate_int(F.lit(3e9))) == 3_000_000_000
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        one(spark, rounding.truncate_int(F.lit(1e20)))


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    out = {
        r.g: (r.s, r.m, r.x)
        for r in df.groupBy("g")
        .agg(nulls.strict_sum("x").alias("s"), nulls.strict_mean("x").alias("m"), nulls.strict_max("x").alias("x"))
        .collect()
    }
    assert out == {"a": (None, None, None), "b": (6.0, 3.0, 4.0)}


def test_strict_mean_where(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None)], "k int, x double")
    keep = lambda k: F.col("k") == k
    row = df.agg(
        nulls.strict_mean_where("x", keep(1)).alias("one"),
        nulls.strict_mean_where("x", keep(2)).alias("two"),
        nulls.strict_mean_where("x", keep(3)).alias("none"),
    ).first()
    assert tuple(row) == (2.0, None, None)


def test_only_value_stops_on_duplicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, x double")
    with pytest.raises(Exception, match="more than one value"):
        df.groupBy("g").agg(nulls.only_value(F.col("x"), "x").alias("x")).collect()


def test_null_is_not_in(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.where(nulls.is_not_in("x", ["a"])).collect()} == {"b", None}


def test_zero_divisor_is_null(spark):
    assert one(spark, arith.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, arith.percent(F.lit(1.0), F.lit(8.0))) == 12.5


@pytest.mark.parametrize(
    "p,want", [(0.05, "Not sig"), (0.0499, "*"), (0.01, "*"), (0.0099, "**"), (0.001, "**"), (0.0009, "***"), (None, "")]
)
def test_stars(spark, p, want):
    assert one(spark, labels.significance_stars(F.lit(p).cast("double"))) == want


def test_sign_of_zero_and_missing_growth_is_negative(spark):
    got = [one(spark, labels.sign_indicator(F.lit(g).cast("double"))) for g in (0.1, 0.0, -0.1, None)]
    assert got == ["pos", "neg", "neg", "neg"]


def test_age_bands(spark):
    assert [one(spark, labels.age_band(F.lit(a))) for a in (0, 4, 5, 9, 10)] == ["0-4", "0-4", "5-9", "5-9", None]


def test_call_label_round_trip(spark):
    for covariates in ("ERP 4yrs + 5 yrs", "erp_4yr + erp_5yr_adjusted + x"):
        call = labels.call_label("y", F.lit(covariates))
        assert one(spark, labels.covariates_of_call(call, "y")) == covariates


def test_periods(spark):
    assert one(spark, calendar.period_year(F.lit("2013-Q2"))) == 2013
    assert one(spark, calendar.period_quarter(F.lit("2013-Q2"))) == "Q2"
    assert str(one(spark, calendar.reference_date(F.lit(2013)))) == "2013-06-30"
    assert one(spark, calendar.year_text(calendar.reference_date(F.lit(2013)))) == "2013"


def test_normal_quantile(spark):
    exact = statistics.NormalDist()
    points = [1e-12, 1e-6, 0.001, 0.0249, 0.074, 0.076, 0.3, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in points], "p double")
    for r in df.select("p", tails.normal_quantile("p").alias("z")).collect():
        assert r.z == pytest.approx(exact.inv_cdf(r.p), abs=1e-12)
    assert one(spark, tails.normal_quantile("1D")) is None


def t_tail(t, df, n=20000):
    """Reference by Simpson's rule on the angle."""
    top = math.atan(t / math.sqrt(df))
    h = top / n
    f = lambda x: math.cos(x) ** (df - 1)
    area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1)) * h / 3
    return 1 - 2 / math.sqrt(math.pi) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) * area


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10, 199, 200, 201, 202, 500, 5000])
def test_t_tail_and_quantile(spark, df):
    for t in (0.0, 0.5, 2.0, 3.5):
        assert one(spark, tails.t_two_sided_p(f"{t}D", str(df))) == pytest.approx(t_tail(t, df), abs=1e-9)
    q = one(spark, tails.t_quantile(0.95, str(df)))
    assert t_tail(q, df) == pytest.approx(0.05, abs=1e-9)


def test_tails_without_degrees_of_freedom(spark):
    assert one(spark, tails.t_two_sided_p("1D", "0")) is None
    assert one(spark, tails.t_quantile(0.95, "0")) is None


@pytest.mark.parametrize("f,df", [(4.102821, 10), (5.786135, 5)])
def test_f_tail(spark, f, df):
    assert one(spark, tails.f_upper_p(f"{f}D", 2, str(df))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, tails.f_upper_p(f"{2.0 ** 2}D", 1, "10")) == pytest.approx(t_tail(2.0, 10), abs=1e-9)


def test_f_tail_of_more_covariates(spark):
    # 5 % points from published tables; k = 4, n = 2 has the closed form 1 - x^2.
    for k, n, f in ((3, 10, 3.708265), (4, 20, 2.866081), (6, 60, 2.254053)):
        assert one(spark, tails.f_upper_p(f"{f}D", k, str(n))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, tails.f_upper_p("3D", 4, "2")) == pytest.approx(1 - (6 / 7) ** 2, abs=1e-12)


def test_recode_quotes_labels(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), ("other",)], "x string")
    got = [r.v for r in df.select(labels.recode("x", {"it's": "o'k", "a\\b": "c\\d"}).alias("v")).collect()]
    assert got == ["o'k", "c\\d", None]


@pytest.mark.parametrize("digits", [-2, 0, 3])
def test_rounding_by_name_and_by_column_agree(spark, digits):
    df = spark.createDataFrame([(v,) for v in (1250.0, -0.3, 0.0005, 2.5, None, 123456.7895)], "x double")
    both = df.select(rounding.round_half_even("x", digits).alias("a"), rounding.round_half_even(F.col("x"), digits).alias("b"))
    for r in both.collect():
        assert r.a == r.b
        assert r.a is None or math.copysign(1, r.a) == math.copysign(1, r.a + 0.0)
