"""SQL twins of the panels, as common table expressions, and SQL expressions."""

from __future__ import annotations

from ..functions.tails import CENTRAL, FAR, MIDDLE


def rnd(x: str, digits: int = 0) -> str:
    """Half-even rounding of whole and fraction: a fraction of one half, but for summation noise, goes to the even neighbour."""
    half = "abs(abs(v) - trunc(abs(v)) - 0.5) <= 1e-11 * greatest(abs(v), 1)"
    even = "sign(v) * (trunc(abs(v)) + CASE WHEN trunc(abs(v)) % 2 = 1 THEN 1 ELSE 0 END)"
    return f"(list_transform([CAST({x} AS DOUBLE) * 1e{digits}], lambda v: CASE WHEN {half} THEN {even} ELSE round(v) END)[1] / 1e{digits} + 0.0)"


def strict_sum(c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN sum({c}) END"


def strict_avg(c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN avg({c}) END"


def stars(p: str) -> str:
    return (
        f"CASE WHEN {p} >= 0.05 THEN 'Not sig' WHEN {p} < 0.001 THEN '***' "
        f"WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"
    )


def t_p(t: str, df: str, panels: int = 1000) -> str:
    """Two-sided t tail by Simpson's rule on the angle atan(t / sqrt(df)); not the series used in Spark."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    step = f"({angle} / {2 * panels})"
    weight = f"CASE WHEN i = 0 OR i = {2 * panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = (
        f"list_sum(list_transform(range(0, {2 * panels} + 1), lambda i: "
        f"({weight}) * pow(cos(i * {step}), {df} - 1))) * {step} / 3"
    )
    norm = f"2 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0))"
    return f"CASE WHEN {df} >= 1 THEN greatest(1 - {norm} * ({area}), 0.0) END"


def normal_quantile(p: str) -> str:
    def poly(coefficients: tuple, x: str) -> str:
        out = repr(coefficients[-1]) + "::DOUBLE"
        for c in reversed(coefficients[:-1]):
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    def quotient(pair: tuple, x: str) -> str:
        return f"({poly(pair[0], x)} / {poly(pair[1], x)})"

    q = f"({p} - 0.5::DOUBLE)"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    size = f"CASE WHEN {r} <= 5 THEN {quotient(MIDDLE, f'({r} - 1.6)')} ELSE {quotient(FAR, f'({r} - 5.0)')} END"
    inner = f"{q} * {quotient(CENTRAL, f'(0.180625 - {q} * {q})')}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {inner} WHEN {q} < 0 THEN -({size}) ELSE {size} END"


def case(c: str, mapping: dict) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {c} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + " END"


SEX = case("l_returnflag", {"A": "1", "N": "2", "R": "3"})

LINES = """lines AS (
  SELECT n_name, n_regionkey, CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(quarter(l_shipdate) AS INTEGER) AS qtr,
         CAST(l_linenumber - 1 AS INTEGER) AS age, l_quantity, l_returnflag, l_linestatus, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

CELLS = f"""{LINES}, cells AS (
  SELECT n_name AS state, yr, age, sum(l_quantity) AS erp, CAST(yr - age AS INTEGER) AS cohort
  FROM lines GROUP BY n_name, yr, age)"""

OBS = f"""{LINES}, obs AS (
  SELECT CAST(age AS VARCHAR) AS age, {SEX} AS sex,
         CASE WHEN grouping(n_regionkey) = 1 THEN 'AUS' ELSE CAST(n_regionkey + 1 AS VARCHAR) END AS region,
         concat(yr, '-Q', qtr) AS time_period, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS obs_value
  FROM lines
  GROUP BY GROUPING SETS ((n_regionkey, age, l_returnflag, yr, qtr), (age, l_returnflag, yr, qtr)))"""

REGION_CASE = case("region", {"AUS": "Aust", "1": "NSW", "2": "Vic", "3": "Qld", "4": "SA", "5": "WA"})

CUBE = f"""{OBS}, typed AS (
  SELECT substr(time_period, 1, 4) AS "year", CAST(substr(time_period, 1, 4) AS INTEGER) AS yr, {REGION_CASE} AS state,
         CAST(age AS INTEGER) AS age, CAST(obs_value AS DOUBLE) AS erp
  FROM obs WHERE sex = '3' AND substr(time_period, 6, 2) = 'Q2' AND CAST(age AS INTEGER) <= 9),
cube_ AS (SELECT *, CAST(yr - age AS INTEGER) AS cohort FROM typed WHERE yr - age >= 1991)"""

FACTORS = f"""{CUBE}, ages456 AS (
  SELECT state, cohort, max(erp) FILTER (age = 4) AS age_4, max(erp) FILTER (age = 5) AS age_5,
         max(erp) FILTER (age = 6) AS age_6
  FROM cube_ WHERE age BETWEEN 4 AND 6 GROUP BY state, cohort),
factors AS (
  SELECT *, CAST(cohort + 5 AS INTEGER) AS yr_turn_5, CAST(cohort + 6 AS INTEGER) AS yr_turn_6,
         {rnd("age_4 / age_5", 4)} AS inv_chg_4_5, {rnd("age_5 / age_6", 4)} AS inv_chg_5_6
  FROM ages456)"""

ORDERS = """order_rows AS (
  SELECT n_name, n_regionkey, r_name, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

SHEET_STATE = case("n_regionkey", {0: "NSW", 1: "Vic", 2: "Qld", 3: "SA", 4: "WA"})
ENROL_AGE = case(
    "o_orderpriority",
    {"1-URGENT": 4, "2-HIGH": 5, "3-MEDIUM": 6, "4-NOT SPECIFIED": 7, "5-LOW": 8},
)

ENROL = f"""{ORDERS}, school AS (
  SELECT yr, {SHEET_STATE} AS state, {ENROL_AGE} AS age FROM order_rows WHERE o_orderstatus = 'F'),
enrol AS (
  SELECT yr AS "year", CASE WHEN grouping(state) = 1 THEN 'Aust' ELSE state END AS state,
         CAST(count(*) FILTER (age = 5) AS DOUBLE) AS aged_5, CAST(count(*) FILTER (age = 6) AS DOUBLE) AS aged_6,
         CAST(count(*) AS DOUBLE) AS all_ages, CAST(count(*) FILTER (age IN (5, 6)) AS DOUBLE) AS total_5_6
  FROM school GROUP BY GROUPING SETS ((yr, state), (yr)))"""

LAGGED = f"""{ENROL}, lagged AS (
  SELECT CAST("year" - 1 AS INTEGER) AS yr, state, "year" AS orig_yr, all_ages AS val,
         {rnd("aged_5 / nullif(total_5_6, 0)", 2)} AS p5, {rnd("aged_6 / nullif(total_5_6, 0)", 2)} AS p6
  FROM enrol)"""

ADJUSTED = f"""{FACTORS}, {LAGGED}, adjusted AS (
  SELECT a.yr, a.state, a.orig_yr, a.val, a.p5, a.p6, f5.inv_chg_4_5, f6.inv_chg_5_6,
         {rnd("a.val * (a.p5 * f5.inv_chg_4_5 + a.p6 * f6.inv_chg_5_6)", 0)} AS measure
  FROM lagged a JOIN factors f5 ON a.state = f5.state AND a.orig_yr = f5.yr_turn_5
  JOIN factors f6 ON a.state = f6.state AND a.orig_yr = f6.yr_turn_6
  WHERE f5.inv_chg_4_5 IS NOT NULL AND f6.inv_chg_5_6 IS NOT NULL AND a.p5 IS NOT NULL AND a.p6 IS NOT NULL)"""

PANEL = f"""{ADJUSTED}, pop45 AS (
  SELECT yr, state, max(erp) FILTER (age = 4) AS erp_4, max(erp) FILTER (age = 5) AS erp_5
  FROM cube_ WHERE age IN (4, 5) GROUP BY yr, state),
panel AS (
  SELECT p.*, l.val AS enrol_lagged FROM (
    SELECT coalesce(a.yr, e.yr) AS yr, coalesce(a.state, e.state) AS state, a.measure, e.erp_4, e.erp_5
    FROM adjusted a FULL JOIN pop45 e ON a.yr = e.yr AND a.state = e.state) p
  LEFT JOIN lagged l ON p.yr = l.yr AND p.state = l.state
  WHERE p.yr <> 1994)"""

ASSEMBLED = f"""{ORDERS}, assembled AS (
  SELECT yr, o_orderpriority AS data_item,
         CAST(nullif(count(*) FILTER (r_name = 'AFRICA'), 0) AS DOUBLE) AS africa,
         CAST(nullif(count(*) FILTER (r_name = 'AMERICA'), 0) AS DOUBLE) AS america,
         CAST(nullif(count(*) FILTER (r_name = 'ASIA'), 0) AS DOUBLE) AS asia,
         CAST(nullif(count(*) FILTER (r_name = 'EUROPE'), 0) AS DOUBLE) AS europe,
         CAST(nullif(count(*) FILTER (r_name = 'MIDDLE EAST'), 0) AS DOUBLE) AS middle_east
  FROM order_rows GROUP BY yr, o_orderpriority)"""

SERIES = f"""{ASSEMBLED}, series_panel AS (
  SELECT yr, state, data_item AS series, "value"
  FROM assembled UNPIVOT INCLUDE NULLS ("value" FOR state IN (africa, america, asia, europe, middle_east)))"""

PRIORITY = f"""{SERIES}, priority_panel AS (
  SELECT yr, state, max("value") FILTER (series = '1-URGENT') AS urgent, max("value") FILTER (series = '2-HIGH') AS high,
         max("value") FILTER (series = '3-MEDIUM') AS medium,
         max("value") FILTER (series = '4-NOT SPECIFIED') AS not_specified,
         max("value") FILTER (series = '5-LOW') AS low
  FROM series_panel GROUP BY yr, state)"""

SCENARIO_LABEL = case("l_returnflag", {"A": "Zero", "N": "Med", "R": "High"})

MODEL = f"""{LINES}, model_input AS (
  SELECT yr, n_name AS state, CASE WHEN yr < 2000 THEN 'N.A.' ELSE {SCENARIO_LABEL} END AS assumption,
         CASE WHEN yr < 2001 THEN sum(l_quantity) FILTER (age = 6) END AS measure,
         sum(l_quantity) FILTER (age = 3) AS erp_3yr, sum(l_quantity) FILTER (age = 4) AS erp_4yr,
         sum(l_quantity) FILTER (age = 5) AS erp_5yr,
         sum(l_quantity) FILTER (l_linestatus = 'F') AS numerator,
         sum(l_quantity) FILTER (age IN (4, 5)) AS numerator45
  FROM lines GROUP BY n_name, yr, CASE WHEN yr < 2000 THEN 'N.A.' ELSE {SCENARIO_LABEL} END)"""

CHANGES_STEP = f"""changes AS (
  SELECT *, {rnd("chg / nullif(erp - chg, 0)", 5)} AS p_chg FROM (
    SELECT *, erp - lag(erp) OVER (PARTITION BY state, cohort ORDER BY yr) AS chg
    FROM cells WHERE age < 7 AND cohort >= 1991)
  WHERE chg IS NOT NULL AND erp - chg <> 0)"""

CHANGES = f"{CELLS}, {CHANGES_STEP}"


def _mig(status: str, name: str, sets: str) -> str:
    return f"""{name} AS (
  SELECT yr, CASE WHEN l_linenumber <= 5 THEN '0-4' ELSE '5-9' END AS age_grp,
         CASE WHEN grouping(n_regionkey) = 1 THEN 'AUS' ELSE CAST(n_regionkey + 1 AS VARCHAR) END AS state_code,
         sum(l_quantity) AS v
  FROM lines WHERE l_linestatus = '{status}' AND {SEX} = '3'
  GROUP BY GROUPING SETS ({sets}))"""


_BAND = "CASE WHEN l_linenumber <= 5 THEN '0-4' ELSE '5-9' END"
MIGRATION_PARTS = (
    _mig("F", "nom", f"(n_regionkey, yr, {_BAND}), (yr, {_BAND})")
    + ", "
    + _mig("O", "imig", f"(n_regionkey, yr, {_BAND})")
)
MIGRATION = f"""{MIGRATION_PARTS}, migration AS (
  SELECT n.yr, n.age_grp, n.state_code, n.v AS nom, coalesce(i.v, 0) AS imig, n.v + coalesce(i.v, 0) AS net_mig_grp
  FROM nom n LEFT JOIN imig i ON n.yr = i.yr AND n.age_grp = i.age_grp AND n.state_code = i.state_code)"""

SINGLE = """single_ages AS (
  SELECT CAST(substr(time_period, 1, 4) AS INTEGER) AS yr, region AS state_code, CAST(age AS INTEGER) AS age,
         CAST(obs_value AS DOUBLE) AS erp_sya
  FROM obs WHERE sex = '3' AND substr(time_period, 6, 2) = 'Q2'),
shares AS (
  SELECT *, """ + rnd("erp_sya / erp_grp", 4) + """ AS p FROM (
    SELECT *, CASE WHEN age <= 4 THEN '0-4' ELSE '5-9' END AS age_grp,
           sum(erp_sya) OVER (PARTITION BY yr, state_code, CASE WHEN age <= 4 THEN '0-4' ELSE '5-9' END) AS erp_grp
    FROM single_ages))"""

APPORTIONED = f"""{OBS}, {MIGRATION}, {SINGLE}, apportioned AS (
  SELECT s.yr, s.state_code, s.age, s.age_grp, {rnd("m.net_mig_grp * s.p", 0)} AS net_mig_sya, m.net_mig_grp,
         s.erp_sya, s.erp_grp, s.p
  FROM shares s LEFT JOIN migration m ON s.yr = m.yr AND s.state_code = m.state_code AND s.age_grp = m.age_grp)"""
