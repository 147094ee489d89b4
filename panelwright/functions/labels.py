"""Recoding and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import column


def recode(c: Column | str, mapping: dict, otherwise: Column | None = None) -> Column:
    """Code -> label; codes outside the mapping become ``otherwise`` or null."""
    if isinstance(c, str) and otherwise is None:
        whens = " ".join(f"WHEN {_literal(code)} THEN {_literal(label)}" for code, label in mapping.items())
        return F.expr(f"CASE `{c}` {whens} END")
    c = column(c)
    out: Column | None = None
    for code, label in mapping.items():
        out = F.when(c == code, label) if out is None else out.when(c == code, label)
    return out if otherwise is None else out.otherwise(otherwise)


def _literal(value: str | int) -> str:
    """A label or code as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def ordinal(c: Column | str, levels: list[str]) -> Column:
    """Position of a label in its level list; null outside the list."""
    return recode(c, {label: i for i, label in enumerate(levels)})


def age_band(age: Column | str) -> Column:
    """Five-year band of a single year of age below ten."""
    age = column(age)
    return F.when(age.between(0, 4), "0-4").when(age.between(5, 9), "5-9")


def significance_stars(p: Column | str) -> Column:
    """Stars of a p-value; a missing p-value has an empty label."""
    p = column(p)
    return (
        F.when(p >= 0.05, "Not sig")
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .otherwise("")
    )


def sign_indicator(growth: Column | str) -> Column:
    """"pos" above zero, "neg" for everything else, missing growth included."""
    return F.when(column(growth) > 0, "pos").otherwise("neg")


def ratio_label(numerator: Column | str, denominator: Column | str) -> Column:
    return F.concat(column(numerator), F.lit(" / "), column(denominator))


def call_label(response: str, covariates: Column | str) -> Column:
    return F.concat(F.lit(f"{response} ~ "), column(covariates))


def covariates_of_call(call: Column | str, response: str) -> Column:
    """Inverse of :func:`call_label`."""
    return F.substr(column(call), F.lit(len(response) + 4))
