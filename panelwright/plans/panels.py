"""Panels made from the driver tables.

The fact table meets the joined dimensions first and is summed once, by panel
keys: partial sums on the map side leave few rows to shuffle. The dimension
files carry their sizes; Spark broadcasts them when they fit, so no fact row
moves, and otherwise the adaptive skew join splits a hot supplier or customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import recode
from ..levels import FOUNDATION_GRADE
from ..operators.adjust import migration_merge
from ..operators.cohort import inverse_change_factors, population_cube
from ..operators.enrolment import age_fraction, enrolment_by_age, migration_adjusted_denominator, measure_panel
from ..operators.reshape import pivot_longer, pivot_wider
from ..operators.scenario import Horizon
from ..operators.windows import lag_change
from ..session import hold

# How the driver tables stand in for the panel's labels.
SEXES = {"A": "1", "N": "2", "R": "3"}
PRIORITY_AGES = {
    "1-URGENT": "a 4 years and under",
    "2-HIGH": "b 5 years",
    "3-MEDIUM": "c 6 years",
    "4-NOT SPECIFIED": "d 7 years",
    "5-LOW": "e 8 years",
}
REGION_SHEET = {0: "a NSW", 1: "b Vic.", 2: "c Qld", 3: "d SA", 4: "e WA"}
REGION_COLUMNS = {
    "AFRICA": "africa",
    "AMERICA": "america",
    "ASIA": "asia",
    "EUROPE": "europe",
    "MIDDLE EAST": "middle_east",
}
PRIORITY_COLUMNS = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "not_specified",
    "5-LOW": "low",
}
FIRST_COHORT = 1991
HORIZON = Horizon(latest=2001, usual_first=1997, usual_last=1999)
MIGRATION_CODES = {"F": "overseas", "O": "interstate"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_year() -> Column:
    return F.year("l_shipdate")


def line_age() -> Column:
    return (F.col("l_linenumber") - 1).cast("int")


def per_nation(
    spark: SparkSession, sf_dir: str, keys: dict[str, Column], sums: dict[str, Column], where: Column | None = None
) -> DataFrame:
    """Sums of lineitem expressions per supplier nation and the given keys."""
    lines = table(spark, sf_dir, "lineitem")
    if where is not None:
        lines = lines.where(where)
    lines = lines.select("l_suppkey", *[c.alias(k) for k, c in keys.items()], *[c.alias(k) for k, c in sums.items()])
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    homes = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = lines.join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("n_name", "n_regionkey", *keys).agg(*[F.sum(k).alias(k) for k in sums])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, yr, age, erp, cohort) with nations as members."""
    sums = per_nation(
        spark, sf_dir, {"yr": ship_year(), "age": line_age()}, {"erp": F.col("l_quantity")}
    )
    return hold(
        sums.select(F.col("n_name").alias("state"), "yr", "age", "erp", (F.col("yr") - F.col("age")).alias("cohort"))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation rows as text: regions and their total, three "sexes", quarters.

    Rows are grouped by the raw columns; the text labels are made from the sums.
    """
    sums = per_nation(
        spark,
        sf_dir,
        {"n_age": line_age(), "flag": F.col("l_returnflag"), "yr": ship_year(), "qtr": F.quarter("l_shipdate")},
        {"v": F.col("l_quantity")},
    )
    grouped = _with_total_region(sums, "v", ["n_age", "flag", "yr", "qtr"])
    return grouped.select(
        F.col("n_age").cast("string").alias("age"),
        recode("flag", SEXES).alias("sex"),
        "region",
        F.concat("yr", F.lit("-Q"), "qtr").alias("time_period"),
        F.col("v").cast("bigint").cast("string").alias("obs_value"),
    )


def _with_total_region(sums: DataFrame, value: str, dims: list[str], total: str | None = "AUS") -> DataFrame:
    """Nation sums -> region codes, and all regions together under the total code."""
    code = (F.col("n_regionkey") + 1).cast("string")
    region = F.explode(F.array(code, F.lit(total))) if total else code
    return sums.withColumn("region", region).groupBy("region", *dims).agg(F.sum(value).alias(value))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hold(population_cube(observations(spark, sf_dir), first_cohort=FIRST_COHORT))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within-cohort changes of the nation cells."""
    return hold(lag_change(cells(spark, sf_dir), first_cohort=FIRST_COHORT))


def orders_per_nation(spark: SparkSession, sf_dir: str, keys: dict[str, Column]) -> DataFrame:
    """Order counts per customer nation and the given keys."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", *[c.alias(k) for k, c in keys.items()])
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    homes = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "n_regionkey", *keys).agg(F.count(F.lit(1)).alias("n"))


def school_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, state, age, grade, all_ages) with sheet labels."""
    counts = orders_per_nation(
        spark,
        sf_dir,
        {"year": F.year("o_orderdate"), "priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")},
    )
    grade = F.when(F.col("status") == "F", FOUNDATION_GRADE).otherwise("b Year 1")
    return counts.select(
        "year",
        recode("n_regionkey", REGION_SHEET).alias("state"),
        recode("priority", PRIORITY_AGES).alias("age"),
        grade.alias("grade"),
        F.col("n").cast("double").alias("all_ages"),
    )


def lagged_enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hold(age_fraction(enrolment_by_age(school_counts(spark, sf_dir))))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure panel of the regions."""
    population = cube(spark, sf_dir)
    lagged = lagged_enrolments(spark, sf_dir)
    adjusted = migration_adjusted_denominator(lagged, inverse_change_factors(population))
    return hold(measure_panel(adjusted, population, lagged, skip_years=(1994,)))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide sheet: (yr, data_item) with one column per region."""
    counts = orders_per_nation(
        spark, sf_dir, {"yr": F.year("o_orderdate"), "data_item": F.col("o_orderpriority")}
    )
    regions = table(spark, sf_dir, "region")
    named = counts.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    sums = named.groupBy("yr", "data_item", "r_name").agg(F.sum("n").cast("double").alias("value"))
    return pivot_wider(sums, ["yr", "data_item"], "r_name", "value", REGION_COLUMNS)


def series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sheet: (yr, state, series, value)."""
    wide = assembled(spark, sf_dir).withColumnRenamed("data_item", "series")
    tall = pivot_longer(wide, ["yr", "series"], list(REGION_COLUMNS.values()), "state", "value")
    return hold(tall.select("yr", "state", "series", "value"))


def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (yr, state, assumption): a measure, populations by age and two numerators.

    The last year has no measure yet; years from 2000 have one row per scenario.
    """
    scenario = recode("l_returnflag", {"A": "Zero", "N": "Med", "R": "High"})
    quantity, age = F.col("l_quantity"), line_age()
    sums = per_nation(
        spark,
        sf_dir,
        {"yr": ship_year(), "assumption": F.when(ship_year() < 2000, "N.A.").otherwise(scenario)},
        {
            "m": F.when(age == 6, quantity),
            "erp_3yr": F.when(age == 3, quantity),
            "erp_4yr": F.when(age == 4, quantity),
            "erp_5yr": F.when(age == 5, quantity),
            "numerator": F.when(F.col("l_linestatus") == "F", quantity),
            "numerator45": F.when(age.between(4, 5), quantity),
        },
    )
    return hold(
        sums.select(
            "yr",
            F.col("n_name").alias("state"),
            "assumption",
            F.when(F.col("yr") < 2001, F.col("m")).alias("measure"),
            "erp_3yr",
            "erp_4yr",
            "erp_5yr",
            "numerator",
            "numerator45",
        )
    )


def migration_observations(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    """(time, age, measure, region, obs_value) of one feed; the interstate feed has no total region."""
    status = {v: k for k, v in MIGRATION_CODES.items()}[feed]
    sums = per_nation(
        spark,
        sf_dir,
        {
            "yr": ship_year(),
            "young": F.col("l_linenumber") <= 5,
            "flag": F.col("l_returnflag"),
            "status": F.col("l_linestatus"),
        },
        {"v": F.col("l_quantity")},
    ).where(F.col("status") == status)
    grouped = _with_total_region(sums, "v", ["yr", "young", "flag"], "AUS" if feed == "overseas" else None)
    return grouped.select(
        F.col("yr").cast("string").alias("time"),
        F.when(F.col("young"), "A04").otherwise("A59").alias("age"),
        recode("flag", SEXES).alias("measure"),
        "region",
        F.col("v").cast("bigint").cast("string").alias("obs_value"),
    )


def migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration_merge(
        migration_observations(spark, sf_dir, "overseas"), migration_observations(spark, sf_dir, "interstate")
    )


def single_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(yr, state_code, age, erp_sya) of one sex and the June quarter."""
    obs = observations(spark, sf_dir)
    kept = obs.where((F.col("sex") == "3") & (F.substring("time_period", 6, 2) == "Q2"))
    return hold(
        kept.select(
            F.substring("time_period", 1, 4).cast("int").alias("yr"),
            F.col("region").alias("state_code"),
            F.col("age").cast("int").alias("age"),
            F.col("obs_value").cast("double").alias("erp_sya"),
        )
    )


def priority_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide panel (yr, state) with one column per order priority."""
    return pivot_wider(series_panel(spark, sf_dir), ["yr", "state"], "series", "value", PRIORITY_COLUMNS)
