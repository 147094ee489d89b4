"""The batches end to end: input tables -> named result tables.

Each batch holds the panels that several steps read, so the observations and
counts are scanned once. Write the results with ``write_panel_tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import percent
from ..functions.rounding import round_half_even
from ..levels import AGE_STEPS, NO_SCENARIO, REGION_LABELS
from ..operators import adjust, aggregates, cohort, enrolment, ratios, regression, scenario, select, windows
from ..operators.joins import left_join
from ..operators.regression import Model
from ..operators.reshape import clone_member, melt_cast, pivot_longer
from ..operators.scenario import Horizon
from ..session import checkpointed


def projection_batch(
    obs: DataFrame,
    horizon: Horizon = Horizon(),
    regions: dict[str, str] = REGION_LABELS,
    first_cohort: int = 2001,
    growth_from_cohort: int = 2010,
    shown_from: int = 2006,
) -> dict[str, DataFrame]:
    """Observations -> cohorts, growth, scenarios and the projected population."""
    cube = checkpointed(cohort.population_cube(obs, regions, first_cohort=first_cohort))
    table = cohort.cohort_table(cube)
    rates = windows.lag_change(cube)
    changes = checkpointed(windows.lag_change(cube, first_cohort=growth_from_cohort))
    assumed = scenario.scenario_long(
        scenario.scenario_rates_a(changes, horizon), scenario.scenario_rates_b(changes, horizon)
    )
    projected = checkpointed(
        scenario.project_cohorts(cohort.cohort_long(table), assumed, last_year=horizon.years[-1], steps=horizon.steps)
    )
    return {
        "cohorts_to_project": table,
        "cohort_growth": aggregates.aggregate_growth(changes, ["state", "yr"], "chg", "erp"),
        "cohort_rates": windows.transition_rates(rates, AGE_STEPS, after=growth_from_cohort),
        "cohort_assumptions": assumed,
        "population_and_projection": projected,
        "projection_4_5": scenario.projection_by_age(projected, first_year=shown_from, latest=horizon.latest),
    }


def preparation_batch(
    counts: DataFrame,
    obs: DataFrame,
    projection: DataFrame,
    regions: dict[str, str] = REGION_LABELS,
    first_cohort: int = 2001,
    skip_years: tuple[int, ...] = (2005,),
    rebased: tuple[str, str] = ("SA", "SA (adj)"),
    split: int = 2013,
    before: int = 2021,
    long_after: int = 2006,
    total_label: str = "Aust",
    windows_: dict[str, tuple[int, int]] | None = None,
) -> dict[str, DataFrame]:
    """School counts, observations and projection -> adjusted measure, correlations, models, bands."""
    windows_ = windows_ or {"2006-20": (2006, 2020), "2013-20": (2013, 2020)}
    models = [
        Model("ERP 4yrs", ("erp_4",)),
        Model("ERP 5yrs", ("erp_5",)),
        Model("ERP 4yrs + 5yrs", ("erp_4", "erp_5")),
    ]
    cube = checkpointed(cohort.population_cube(obs, regions, first_cohort=first_cohort))
    lagged = checkpointed(enrolment.age_fraction(enrolment.enrolment_by_age(counts)))
    factors = cohort.inverse_change_factors(cube)
    derived = checkpointed(enrolment.migration_adjusted_denominator(lagged, factors))
    plain = checkpointed(enrolment.measure_panel(derived, cube, lagged, skip_years))
    panel = checkpointed(adjust.append_rebased_member(plain, *rebased, split=split, before=before))

    training = panel.where(F.col("yr") != before)
    fits = regression.fit_linear(training, ["state"], "measure", models)
    best = checkpointed(regression.best_fits(fits))
    ahead = clone_member(projection, "state", rebased[0], [rebased[1]]).select(
        "yr",
        "state",
        F.when(F.col("assumption") == "NA", NO_SCENARIO).otherwise(F.coalesce("assumption", F.lit(NO_SCENARIO))).alias("assumption"),
        F.col("erp_4yr").alias("erp_4"),
        F.col("erp_5yr").alias("erp_5"),
    )
    fitted = regression.augment(ahead, best, models, level=None)
    joined = checkpointed(left_join(fitted, panel.select("yr", "state", "measure"), ["yr", "state"]))
    bands = regression.fitted_band(joined, "measure")
    shown = [
        "state", "yr", "erp_4", "erp_5", "measure", "fitted_round", "se_fit", "lower", "upper", "residual", "residual_pc",
    ]
    known = joined.where((F.col("yr") < before) & F.col("measure").isNotNull())
    diagnostics = checkpointed(_refitted_residuals(known, best, models))
    scores = windows.normal_scores(
        diagnostics.select("state", "yr", "assumption", "model", "resid", "std_resid"), ["state"], "std_resid", ["yr", "assumption"]
    )
    return {
        "change_report": cohort.cohort_change_report(factors, younger=before - 5, older=before - 6),
        "derived_measure": derived,
        "measure_panel": panel,
        "measure_long": enrolment.measure_panel_long(plain, long_after),
        "measured_on_fitted": regression.fit_r2_by_group(known.where(F.col("state") != total_label), ["state"], "measure", "fitted"),
        "correlations": aggregates.corr_table(
            training, ["state"], "measure", {"erp_4": "4yrs", "erp_5": "5yrs"}, "yr", windows_
        ),
        "model_summary": regression.model_summary_table(regression.glance(best)),
        "coefficients": regression.coefficient_table(regression.tidy(best), "measure"),
        "fitted_a": bands.where(F.col("assumption") != "ERP_B").select(*shown).distinct(),
        "fitted_b": bands.where(F.col("assumption") != "ERP_A").select(*shown).distinct(),
        "prediction": regression.prediction_long(joined, ["state", "yr", "assumption"], "measure"),
        "residual_scores": scores,
    }


def _refitted_residuals(known: DataFrame, best: DataFrame, models: list[Model]) -> DataFrame:
    """Residuals of the chosen models, fitted again on the rows that carry both measure and projection."""
    base = known.drop("model", "fitted", "se_fit").distinct()
    again = regression.fit_linear(base, ["state"], "measure", models)
    chosen = regression.fits_long(best).groupBy("state").agg(F.collect_set("model").alias("_chosen"))
    kept = left_join(again, chosen, ["state"]).withColumn(
        "fits", F.filter("fits", lambda f: F.array_contains("_chosen", f["model"]))
    )
    return regression.residuals(base, kept.drop("_chosen"), models, "measure")


def report_batch(
    rows: DataFrame,
    rules: DataFrame,
    series: list[str],
    numerators: dict[str, str],
    total_label: str = "Aust",
    range_from: int = 2013,
    corr_window: tuple[int, int] = (2013, 2019),
    assignment: dict[str, list[str]] | None = None,
    multiplier: float = 1.96,
) -> dict[str, DataFrame]:
    """Model input (yr, state, assumption, measure, erp_4yr, erp_5yr, ..) -> the frames behind the reports.

    With an ``assignment`` (model -> members) the members get their fixed
    model instead of the best one.
    """
    models = [
        Model("ERP 4yrs", ("erp_4yr",)),
        Model("ERP 5yrs", ("erp_5yr",)),
        Model("ERP 4yrs + 5yrs", ("erp_4yr", "erp_5yr")),
    ]
    repaired = checkpointed(adjust.outlier_repair(rows, rules, "measure", ["state"], ["yr", "assumption"]))
    all_fits = regression.fit_linear(repaired, ["state"], "repaired", models)
    chosen = regression.assigned_fits(all_fits, "state", assignment) if assignment else regression.best_fits(all_fits)
    fits = checkpointed(chosen)
    augmented = regression.augment(repaired, fits, models, level=None)
    bands = checkpointed(
        augmented.select(
            *repaired.columns,
            "model",
            round_half_even("fitted", 0).alias("fitted"),
            round_half_even(F.col("fitted") - multiplier * F.col("se_fit"), 0).alias("lower"),
            round_half_even(F.col("fitted") + multiplier * F.col("se_fit"), 0).alias("upper"),
            round_half_even(multiplier * F.col("se_fit"), 0).alias("ci"),
            percent(2 * multiplier * F.col("se_fit"), "fitted").alias("rse"),
        )
    )
    ids = ["yr", "state", "assumption", "model", *numerators]
    tall = pivot_longer(bands, ids, [*series, "repaired", "fitted"], "series", "value")
    rounded = tall.withColumn("value", round_half_even("value", 0))
    # Tied best models: the first of the list stands for its member in the ranges.
    ids = ["yr", "state", "assumption"]
    rank = F.array_position(F.array(*[F.lit(m.name) for m in models]), F.col("model")).alias("_rank")
    first = F.min(F.struct(rank, *scenario.RANGE_MEASURES)).alias("_f")
    ranged = bands.where(F.col("yr") >= range_from).groupBy(*ids).agg(first).select(*ids, *[f"_f.{m}" for m in scenario.RANGE_MEASURES])
    return {
        "repaired": repaired,
        "correlations": aggregates.corr_table(
            repaired, ["state"], "repaired", {"erp_4yr": "4yrs", "erp_5yr": "5yrs"}, "yr", {"window": corr_window}
        ),
        "model_summary": regression.model_summary_table(
            regression.glance(fits),
            {"r_squared": 2, "adj_r_squared": 2, "statistic": 2, "sigma": 1, "log_lik": 1, "aic": 1, "bic": 1, "p_value": 3},
        ),
        "coefficients": regression.coefficient_table(regression.tidy(fits), "measure"),
        "fitted": bands,
        "series": ratios.stacked_ratios(rounded, numerators),
        "ranges": scenario.member_sum_projection(ranged, total_label),
    }


def denominator_batch(
    assembled: DataFrame,
    obs: DataFrame,
    overseas: DataFrame,
    interstate: DataFrame,
    members: dict[str, str],
    items: dict[str, str],
    school: str,
    numerator: str,
    regions: dict[str, str] = REGION_LABELS,
    age: int = 5,
    sex: str = "3",
    quarter: str = "Q2",
    max_age: int = 9,
) -> dict[str, DataFrame]:
    """Assembled sheet, population and migration feeds -> school series less the migration of their age, and ratios to it.

    assembled: (yr, data_item, a column for each member). ``members``: column ->
    member, ``items``: data item -> column; ``school`` and ``numerator``: two of
    these columns. Migration of an age band is split over single years by
    population; what came in the year before is taken out of the school series.
    """
    wide = melt_cast(assembled, ["yr"], members, "state", "data_item", items)
    kept = obs.where((F.col("sex") == sex) & (F.substring("time_period", 6, 2) == quarter)).select(
        F.substring("time_period", 1, 4).try_cast("int").alias("yr"), F.col("region").alias("state_code"),
        F.col("age").try_cast("int").alias("age"), F.col("obs_value").try_cast("double").alias("erp_sya"),
    )
    migration = adjust.migration_merge(overseas, interstate)
    apportioned = checkpointed(adjust.apportion_by_share(kept.where(F.col("age") <= max_age), migration))
    named = wide.withColumnRenamed(school, "first_yr_sch")
    revised = checkpointed(adjust.revise_denominator(named, apportioned, regions, age).withColumnsRenamed({"first_yr_sch": school, "first_yr_sch_revised": f"{school}_revised"}))
    series = [*items.values(), f"{school}_revised"]
    typed = revised.select("yr", "state", *[F.col(c).cast("double").alias(c) for c in series])
    return {
        "migration": migration,
        "apportioned": apportioned,
        "revised": revised,
        "ratios": ratios.wide_ratio(typed, ["yr", "state"], series, numerator),
    }


def ratio_report(assembled: DataFrame, members: dict[str, str], numerators: list[str]) -> dict[str, DataFrame]:
    """Assembled sheet (yr, data_item, a column for each member) -> rounded series, and every numerator over every series."""
    tall = pivot_longer(assembled.withColumnRenamed("data_item", "series"), ["yr", "series"], members, "state", "value")
    series = checkpointed(tall.select("yr", "state", "series", round_half_even("value", 0).alias("value")))
    return {"series": series, "ratios": ratios.numerator_denominator_ratio(series, numerators)}


def report_slices(
    stacked: DataFrame, members: list[str], periods: list[int], series: list[str], shown: list[str]
) -> dict[str, DataFrame]:
    """What the report shows of :func:`ratio_report` ratios for a choice: two chart frames, two tables without gaps.

    ``series``: the chosen series, ``shown``: the chosen ratios.
    """
    chosen = stacked.where(F.col("state").isin(members) & F.col("yr").isin(periods))
    counts = {"yr": "yr", "state": "state", "series": "series", "value": "value"}
    cells = {"yr": "yr", "state": "state", "numerator": "numerator", "n": "num_value", "series": "denominator", "value": "denom_value", "percent": "percent"}
    return {
        "count_chart": chosen.where(F.col("series").isin(series)),
        "ratio_chart": chosen.where(F.col("ratio").isin(shown)),
        "count_table": select.selection_view(chosen, series=series, columns=counts),
        "ratio_table": select.selection_view(chosen, ratios=shown, columns=cells, distinct=False),
    }
