"""Registered queries of the mortality engine over lives made of the order tables, with the SQL that must agree.

Sums are rounded on both sides, as the order of summation differs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.functions.clicks import CLICKS
from survista.operators import chart
from survista.operators.aev import Aev, Measure, accumulate, aev, clipped, elements_of
from survista.operators.batch import batch, element, union_of
from survista.operators.compare import compare_models, diagnose, overdispersion_of
from survista.operators.covariates import covariates, disjoint, model
from survista.operators.fit import fit, table_of
from survista.operators.include import ages, bands, categories, duration, durations, include, includes, periods
from survista.operators.mortality import Table, gompertz_mortality, mortality, mortality_const, mortality_table
from survista.operators.simulate import simulate
from survista.plans import expr as E
from survista.plans.columns import typed
from survista.sources.data import val_from_exp_data
from survista.sources.lives import PERIOD, order_experience

i, t, b, x = E.i, E.t, E.b, E.x
QUARTER = CLICKS // 4
STATUS = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

GOMPERTZ = gompertz_mortality(-3.0, 0.06, 60, -0.01, 1998)
CONSTANT = mortality_const(mu=0.07)
AGE0, AGES, YEARS = 30, 50, 6
LOG_MU = np.fromfunction(lambda a, p: -6.0 + 0.075 * a - 0.02 * p + 0.001 * a * p, (AGES, YEARS))
TABLE = mortality_table(AGE0, PERIOD[0], log_mu=LOG_MU)
Q = -np.expm1(-np.exp(LOG_MU))
TABLE_Q = mortality_table(AGE0, PERIOD[0], q=Q)


# ---- Spark side ----


def rounded(a: Aev, digits: int = 6) -> DataFrame:
    return a.df.select("ord", "group", "name", *[F.round(c, digits).alias(c) for c in "AEV"])


def _aev(m, digits: int = 6, omega: float = 1.5, step=None, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(aev(order_experience(spark, sf_dir), m, overdispersion=omega, time_scale=step, **how), digits)

    return run


def exp_trim(spark, sf_dir):
    return order_experience(spark, sf_dir).df.select("uid", "birth", "E2R_start", "E2R_end", "E2R_died")


def val_snapshot(spark, sf_dir):
    return val_from_exp_data(order_experience(spark, sf_dir), 1999).df.select("uid", "birth", "pension")


def aev_properties(spark, sf_dir):
    a = aev(order_experience(spark, sf_dir), GOMPERTZ, overdispersion=1.5, breakdown=SEGMENT_STATUS)
    names = ["A_minus_E", "A_minus_E_stddev", "A_over_E", "log_A_over_E", "log_A_over_E_stddev", "log_A_over_E_95pc", "Pearson_residual", "deviance_residual"]
    return a.with_properties().select("ord", "name", *[F.round(n, 6).alias(n) for n in names])


def aev_sum_of_two(spark, sf_dir):
    d = order_experience(spark, sf_dir)
    return rounded(aev(d, GOMPERTZ, overdispersion=1.5, breakdown=SEGMENT) + aev(d, CONSTANT, overdispersion=1.5, breakdown=SEGMENT))


def z_scale(spark, sf_dir):
    d = order_experience(spark, sf_dir)
    m = Measure(GOMPERTZ, i.pension / 1000)
    r = accumulate(clipped(d, elements_of(None, None), m.fields), d.scope(), m, QUARTER)
    return r.select(F.round(F.col("V") / F.col("E"), 6).alias("Z"))


def overdispersion_pearson(spark, sf_dir):
    """Cells reach the driver: one row for each of a breakdown's elements."""
    cells = aev(order_experience(spark, sf_dir), CONSTANT, overdispersion=1, breakdown=SEGMENT_STATUS).df
    o = overdispersion_of([(r["A"], r["E"], r["V"]) for r in cells.collect()], 1)
    return spark.createDataFrame([(o.df, o.cells, round(o.estimate, 6), round(o.stddev, 6))], "df int, cells int, estimate double, stddev double")


TERMS = [("one", E.node(1.0)), ("old", (i.pension > 150000) * 1.0), ("f", (i.status == "F") * 1.0)]


def fit_walk_at_beta0(spark, sf_dir):
    """Score and information at zero coefficients."""
    d = order_experience(spark, sf_dir)
    m = Measure(GOMPERTZ)
    rows = clipped(d, elements_of(None, None), m.fields | {"pension", "status"})
    w = table_of(rows, d, m, [n for _, n in TERMS], QUARTER).walk(np.zeros(3))
    out = [("e", w.e)] + [(f"sA_{k}", w.sa[k]) for k in range(3)] + [(f"sE_{k}", w.se[k]) for k in range(3)]
    out += [(f"I_{j}{k}", w.information[j, k]) for j in range(3) for k in range(j, 3)]
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in out], "item string, value double")


def fit_intercept_closed_form(spark, sf_dir):
    f = fit(order_experience(spark, sf_dir), model(GOMPERTZ, covariates(one=1.0)), test_mortality=GOMPERTZ, overdispersion=1.5, tolerance=1e-14)
    return spark.createDataFrame([("one", round(float(f.coefficients[0]), 7), round(float(f.variance[0, 0]), 9))], "term string, estimate double, variance double")


def fit_disjoint_groups(spark, sf_dir):
    f = fit(order_experience(spark, sf_dir), model(GOMPERTZ, disjoint(SEGMENT)), test_mortality=GOMPERTZ, overdispersion=1, tolerance=1e-14)
    rows = [(n, round(float(c), 7), round(float(v), 8)) for n, c, v in zip(f.names, f.coefficients, np.diag(f.variance), strict=True)]
    return spark.createDataFrame(rows, "term string, estimate double, variance double")


def fit_age_newton(spark, sf_dir):
    """Time-varying covariates: iterated walks over slots."""
    f = fit(order_experience(spark, sf_dir), model(GOMPERTZ, covariates(one=1.0, age=x - 55, f=i.status == "F")), test_mortality=GOMPERTZ, overdispersion=1, tolerance=1e-14)
    digits = {"estimate": 6, "stddev": 6, "low_95pc": 5, "high_95pc": 5}
    return f.to_df(spark).select("term", *[F.round(c, n).alias(c) for c, n in digits.items()], F.lit(f.status).alias("status"))


def compare_models_rank(spark, sf_dir):
    candidates = [model(GOMPERTZ, covariates(one=1.0), "level"), model(GOMPERTZ, disjoint(SEGMENT), "segment"), model(GOMPERTZ, covariates(one=1.0, big=i.pension > 150000), "size")]
    c = compare_models(order_experience(spark, sf_dir), candidates, test_mortality=GOMPERTZ, overdispersion=1, tolerance=1e-14)
    return c.to_df(spark).select("rank", "model", *[F.round(n, 4).alias(n) for n in ("L_P", "L", "penalty")], "status")


def diagnose_grid(spark, sf_dir):
    d = order_experience(spark, sf_dir)
    f = fit(d, model(GOMPERTZ, covariates(one=1.0), "level"), test_mortality=GOMPERTZ, overdispersion=1, tolerance=1e-14)
    g = diagnose(d, f, {"segment": SEGMENT, "status": STATUSES})
    return g.df.select("model", "breakdown", "ord", "name", *[F.round(c, 5).alias(c) for c in "AEV"])


def disjoint_violation(spark, sf_dir):
    """Years of exposure shared by two covariates: zero if they are disjoint."""
    d = order_experience(spark, sf_dir)
    both = [("big", i.pension > 150000), ("f", i.status == "F"), ("o", i.status == "O")]
    pairs = [(p, q) for k, p in enumerate(both) for q in both[k + 1 :]]
    shared = includes(*[include(p[1] & q[1]).named(f"{p[0]}.{q[0]}") for p, q in pairs])
    a = aev(d, mortality_const(log_mu=0.0), overdispersion=1, breakdown=shared)
    return a.df.select("name", F.round("E", 6).alias("shared"))


def simulate_hash_uniform(spark, sf_dir):
    lives = order_experience(spark, sf_dir).df.select("uid", "birth", "E2R_start")
    u = (F.pmod(F.col("uid") * 7919 + 104729, F.lit(1000003)).cast("double") + 0.5) / 1000003.0
    return simulate(gompertz_mortality(-2.2, 0.05, 60, 0.0, 1998), lives, *PERIOD, uniform=u).df.select("uid", "E2R_start", "E2R_end", "E2R_died")


SWEEP = {
    "floordiv": "(i.v // 7)", "mod": "(i.v % 7)", "neg_mod": "((0 - i.v) % 7)", "power": "(abs(i.v) / 100) ** 0.5", "log": "log(i.v + 500)", "log1p": "log1p(abs(i.v))", "expm1": "expm1(i.v / 1000)",
    "round": "round(i.v / 2)", "trunc": "trunc(i.v / 3)", "sign": "sign(i.v)", "clamp": "clamp(i.v, -100, 100)", "least": "min(i.v, 0 - i.v)", "most": "max(i.v / 2, 1)", "ceiling": "ceiling(i.v / 4)",
    "choose": "ifelse(i.v > 0, sqrt(abs(i.v)), 0 - sqrt(abs(i.v)))", "among": "ifelse(i.v in (1, 2, 3), 1, 0)", "age": "max(x, 0)",
}


def expr_scalar_sweep(spark, sf_dir):
    """Expressions over events: v is the whole part of the value less the event's number modulo 997."""
    from survista.plans.columns import DOUBLE, INSTANT, Scope

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.floor("value") - F.col("event_id") % 997).cast("double").alias("v"), ((F.lit(1950) + F.col("event_id") % 40) * CLICKS).cast("long").alias("birth"))
    scope = Scope({"v": DOUBLE, "birth": INSTANT}, F.lit(2000 * CLICKS + 7).cast("long"))
    cols = [F.round(typed(E.parse(s), scope).double(), 6).alias(n) for n, s in SWEEP.items()]
    return e.select("event_id", *[(c + F.lit(0.0)).alias(n) for c, n in zip(cols, SWEEP, strict=True)])


def vec_ops(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("value").cast("double").alias("v"))
    v, two = F.col("v"), ieee.lit(2.0)
    out = {"neg": -v, "exp": F.exp(v / 1000), "expm1": F.expm1(v / 1000), "log": ieee.log(v + 1), "log1p": ieee.log1p(v), "m_from_q": ieee.m_from_q(v / 10000), "add": v + two, "sub": v - two, "mul": v * two, "div": ieee.div(v, two), "pow": ieee.power(v, ieee.lit(0.5)), "min": ieee.minimum(v, two), "max": ieee.maximum(v, two), "clamp": ieee.clamp(v, two, ieee.lit(50.0))}
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in out.items()])


def chart_status(spark, sf_dir):
    a = aev(order_experience(spark, sf_dir), GOMPERTZ, overdispersion=1.5, breakdown=includes(SEGMENT_STATUS, include(i.pension < 0).named("none")))
    f = chart.plot_frame(a)
    return f.select("ord", "name", "status", F.round("log_A_over_E", 6).alias("log_ratio"), F.round("clamped", 6).alias("clamped"), "chevron", F.col("group_run").cast("long").alias("group_run"))


def batch_two_aevs(spark, sf_dir):
    d = order_experience(spark, sf_dir)
    both = batch(d, {"lives": element("aev", GOMPERTZ), "amounts": element("aev", GOMPERTZ, weight=i.pension / 1000)}, overdispersion=1.5, breakdown=SEGMENT)
    return union_of(both).select("element", "ord", "name", *[F.round(c, 5).alias(c) for c in "AEV"])


SEGMENT = categories(i.segment, source=SEGMENTS)
STATUSES = categories(i.status, source=STATUS)
SEGMENT_STATUS = includes(*[include((i.segment == s) & (i.status == u)).named(f"{s} {u}") for s in SEGMENTS for u in STATUS])
OVERLAP = includes(ages(30, 80, by=10), include(i.status == "F").named("F"), SEGMENT)
WAVE = mortality(-3 + 0.05 * (x - 55) + 0.1 * E.sin(t * 6.283185307179586))
PENSION = i.pension / 1000
SELECT = mortality(E.ifelse(i.segment == "BUILDING", GOMPERTZ.as_node(), CONSTANT.as_node() + 0.1))


# ---- SQL side ----

LIVES = f"""
last AS (SELECT l_orderkey, max(l_shipdate) AS ship, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS back FROM lineitem GROUP BY l_orderkey),
dated AS (
  SELECT o_orderkey::BIGINT AS uid, ((1925 + o_custkey % 40) * {CLICKS} + (o_orderkey % 12) * {CLICKS // 12})::BIGINT AS birth, o_orderdate AS d0, ship AS d1,
         coalesce(ship = back, false) AS died, o_totalprice::DOUBLE AS pension, o_orderstatus AS status, c_mktsegment AS segment
  FROM orders JOIN last ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
spans AS (
  SELECT *, (year(d0) * {CLICKS} + (dayofyear(d0) - 1) * CASE WHEN year(d0) % 4 = 0 AND year(d0) % 100 <> 0 OR year(d0) % 400 = 0 THEN 1460 ELSE 1464 END)::BIGINT AS c0,
         (year(d1) * {CLICKS} + (dayofyear(d1) - 1) * CASE WHEN year(d1) % 4 = 0 AND year(d1) % 100 <> 0 OR year(d1) % 400 = 0 THEN 1460 ELSE 1464 END)::BIGINT AS c1
  FROM dated),
life AS (
  SELECT uid, birth, pension, status, segment, greatest(c0, {PERIOD[0] * CLICKS}) AS s0, least(c1, {PERIOD[1] * CLICKS}) AS s1, c1 <= {PERIOD[1] * CLICKS} AND died AS dead
  FROM spans WHERE c1 > c0 AND greatest(c0, {PERIOD[0] * CLICKS}) < least(c1, {PERIOD[1] * CLICKS}))"""


def sql_gompertz(level=-3.0, slope_x=0.06, x0=60, slope_t=-0.01, t0=1998) -> str:
    return f"({level} - {slope_x} * ((birth - {(t0 - x0) * CLICKS}) / {CLICKS}.0::DOUBLE) + {slope_x + slope_t} * ((t - {t0 * CLICKS}) / {CLICKS}.0::DOUBLE))"


def sql_table(m: Table) -> str:
    """Bilinear look-up in a list."""
    n, a = m.grid.shape
    cells = "[" + ", ".join(repr(float(v)) for v in m.grid.ravel()) + "]"
    c, p = f"(birth - {m.t0.clicks - m.x0.clicks})", f"(t - {m.t0.clicks})"
    floor = lambda v: f"floor({v} / {CLICKS}.0)::BIGINT"
    part = lambda v: f"(({v} - {floor(v)} * {CLICKS})::DOUBLE / {CLICKS})"
    at = lambda q, k: f"({cells})[least(greatest({q}, 0), {n - 1}) * {a} + least(greatest({k}, 0), {a - 1}) + 1]"

    def blend(up: int) -> str:
        q = f"({floor(p)} + {up})"
        k = f"({q} - {floor(c)})"
        return f"({at(q, k)} + {part(c)} * ({at(q, k + ' - 1')} - {at(q, k)}))"

    return f"({blend(0)} + {part(p)} * ({blend(1)} - {blend(0)}))"


#: An element: group, name, gate, and stretches of (low, high) in SQL.
def element_sql(group, name, gate="true", stretches=()):
    return group, name, gate, list(stretches)


WHOLE = [element_sql(None, None)]
SEGMENT_SQL = [element_sql("segment", s, f"segment = '{s}'") for s in SEGMENTS]
STATUS_SQL = [element_sql("status", s, f"status = '{s}'") for s in STATUS]
BOTH_SQL = [element_sql(None, f"{s} {u}", f"segment = '{s}' AND status = '{u}'") for s in SEGMENTS for u in STATUS]
AGE_SQL = [element_sql("age", f"{a}-{a + 10}", stretches=[(f"birth + {a * CLICKS}", f"birth + {(a + 10) * CLICKS}")]) for a in range(30, 80, 10)]


def sql_sums(elements, mu: str, w: str = "1.0", s: str = "1.0", step: int = QUARTER, tag: str = "") -> str:
    """CTEs ending in sums{tag}(ord, A, E, V): deaths at the end of a span, integrals over its slots."""
    parts = []
    for k, (_, _, gate, stretches) in enumerate(elements):
        nu = f"greatest({', '.join(['s0', *[a for a, _ in stretches if a]])})"
        tau = f"least({', '.join(['s1', *[z for _, z in stretches if z]])})"
        parts.append(f"SELECT {k + 1}::BIGINT AS ord, life.*, {nu} AS nu, {tau} AS tau, dead AND {tau} = s1 AS died FROM life WHERE ({gate}) AND {nu} < {tau}")
    return f"""
rows{tag} AS ({" UNION ALL ".join(parts)}),
slots{tag} AS (
  SELECT *, ((z + a + (((z + a) >> 1) & 1)) >> 1) AS t, z - a AS width
  FROM (SELECT *, nu + k * {step} AS a, least(nu + (k + 1) * {step}, tau) AS z FROM (SELECT *, unnest(range(0, (tau - nu + {step} - 1) // {step})) AS k FROM rows{tag}))),
live{tag} AS (SELECT ord, sum(exp({mu}) * ({s}) * ({w}) * width / {CLICKS}.0) AS E, sum(exp({mu}) * ({s}) * ({w}) * ({w}) * width / {CLICKS}.0) AS V FROM slots{tag} GROUP BY ord),
deaths{tag} AS (SELECT ord, sum(({s}) * ({w})) AS A FROM (SELECT *, tau AS t FROM rows{tag} WHERE died) GROUP BY ord),
sums{tag} AS (SELECT ord, coalesce(A, 0) AS A, E, V FROM live{tag} LEFT JOIN deaths{tag} USING (ord))"""


def sql_labels(elements) -> str:
    quote = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    return "labels AS (" + " UNION ALL ".join(f'SELECT {k + 1}::BIGINT AS ord, {quote(g)} AS "group", {quote(n)} AS name' for k, (g, n, _, _) in enumerate(elements)) + ")"


def sql_aev(elements, mu: str, w: str = "1.0", s: str = "1.0", omega: float = 1.5, step: int = QUARTER, digits: int = 6) -> str:
    return f"""WITH {LIVES}, {sql_sums(elements, mu, w, s, step)}, {sql_labels(elements)}
SELECT ord, "group", name, round(coalesce(A, 0)::DOUBLE, {digits}) AS A, round(coalesce(E, 0), {digits}) AS E, round({omega} * coalesce(V, 0), {digits}) AS V FROM labels LEFT JOIN sums USING (ord)"""


CONST_SQL = repr(float(np.log(0.07)))
G = sql_gompertz()
WAVE_SQL = f"(-3 + 0.05 * ((t - birth) / {CLICKS}.0::DOUBLE - 55) + 0.1 * sin((t / {CLICKS}.0::DOUBLE) * 6.283185307179586))"

QUERIES = {
    "aev_gompertz_lives": _aev(GOMPERTZ, breakdown=SEGMENT),
    "exp_trim": exp_trim,
    "val_snapshot": val_snapshot,
    "crude_exposure_deaths": _aev(mortality_const(log_mu=0.0), omega=1, breakdown=SEGMENT),
    "aev_const": _aev(CONSTANT),
    "aev_gompertz_amounts": _aev(GOMPERTZ, 5, weight=PENSION, breakdown=SEGMENT),
    "aev_indicator_weight": _aev(GOMPERTZ, weight=i.status == "F", breakdown=SEGMENT),
    "aev_table_lookup": _aev(TABLE, breakdown=SEGMENT),
    "aev_table_from_q": _aev(TABLE_Q, breakdown=STATUSES),
    "aev_by_age_bands": _aev(GOMPERTZ, breakdown=ages(30, 80, by=10)),
    "aev_by_periods": _aev(GOMPERTZ, breakdown=periods(1996, 2001, by=1)),
    "aev_by_duration": _aev(GOMPERTZ, breakdown=durations(b, thresholds=[45, 60])),
    "aev_by_amount_bands": _aev(GOMPERTZ, breakdown=bands(i.pension, thresholds=[50000, 100000, 200000])),
    "aev_by_category": _aev(GOMPERTZ, breakdown=categories(i.status, ["F", "P"], "O")),
    "aev_overlapping_breakdown": _aev(GOMPERTZ, breakdown=OVERLAP),
    "aev_include_population": _aev(GOMPERTZ, include=include(i.status != "P") & duration(b, 40, 65), breakdown=SEGMENT),
    "aev_relevance": _aev(GOMPERTZ, val_relevance=E.ifelse(i.status == "F", 0.5, 1.0), breakdown=SEGMENT),
    "aev_distance_decay": _aev(GOMPERTZ, val_distance=0.2 * (2001 - t), weight=PENSION, digits=5, breakdown=SEGMENT),
    "aev_time_scale_1": _aev(WAVE, step=1),
    "aev_time_scale_4": _aev(WAVE, step=1 / 4),
    "aev_time_scale_12": _aev(WAVE, step=1 / 12),
    "aev_time_scale_60": _aev(WAVE, step=1 / 60),
    "aev_properties": aev_properties,
    "aev_sum_of_two": aev_sum_of_two,
    "mortality_select_by_segment": _aev(SELECT, breakdown=SEGMENT),
    "z_scale": z_scale,
    "overdispersion_pearson": overdispersion_pearson,
    "fit_walk_at_beta0": fit_walk_at_beta0,
    "fit_intercept_closed_form": fit_intercept_closed_form,
    "fit_disjoint_groups": fit_disjoint_groups,
    "fit_age_newton": fit_age_newton,
    "compare_models_rank": compare_models_rank,
    "diagnose_grid": diagnose_grid,
    "disjoint_violation": disjoint_violation,
    "simulate_hash_uniform": simulate_hash_uniform,
    "expr_scalar_sweep": expr_scalar_sweep,
    "vec_ops": vec_ops,
    "chart_status": chart_status,
    "batch_two_aevs": batch_two_aevs,
}

_BANDS = [element_sql("pension", "< 50000", "pension < 50000"), element_sql("pension", "50000-100000", "pension >= 50000 AND pension < 100000"), element_sql("pension", "100000-200000", "pension >= 100000 AND pension < 200000"), element_sql("pension", ">= 200000", "pension >= 200000")]
_PERIODS = [element_sql("period", f"{y}-{y + 1}", stretches=[(str(y * CLICKS), str((y + 1) * CLICKS))]) for y in range(1996, 2001)]
_DURATIONS = [element_sql("duration since b", n, stretches=[(a and f"birth + {a * CLICKS}", z and f"birth + {z * CLICKS}")]) for n, a, z in (("< 45", None, 45), ("45-60", 45, 60), (">= 60", 60, None))]
_POPULATION = [element_sql(g, n, f"status <> 'P' AND {c}", [(f"birth + {40 * CLICKS}", f"birth + {65 * CLICKS}")]) for g, n, c, _ in SEGMENT_SQL]
_OVERLAP = [*AGE_SQL, element_sql(None, "F", "status = 'F'"), *SEGMENT_SQL]
_KEPT = ("A", "E", "V")


def _properties() -> str:
    v = "(1.5 * V)"
    r = "(A / E)"
    al = f"({r} - 1)"
    deviance = f"CASE WHEN {r} = 0 THEN -E * sqrt(2 / {v}) WHEN abs({al}) > 0.0015 THEN sign({al}) * E * sqrt(2 * ({r} * ln({r}) - {al}) / {v}) ELSE E / sqrt({v}) * {al} * (1 + {al} * (-1.0/6 + {al} * (5.0/72 - {al} * 83/2160))) END"
    cols = {"A_minus_E": "A - E", "A_minus_E_stddev": f"sqrt({v})", "A_over_E": r, "log_A_over_E": f"ln({r})", "log_A_over_E_stddev": f"sqrt({v}) / E", "log_A_over_E_95pc": f"1.959963984540054 * sqrt({v}) / E", "Pearson_residual": f"(A - E) / sqrt({v})", "deviance_residual": deviance}
    return f"WITH {LIVES}, {sql_sums(BOTH_SQL, G)}, {sql_labels(BOTH_SQL)} SELECT ord, name, " + ", ".join(f"round({c}, 6) AS {n}" for n, c in cols.items()) + " FROM labels JOIN sums USING (ord)"


def _simulated() -> str:
    mu = sql_gompertz(-2.2, 0.05, 60, 0.0, 1998)
    return f"""WITH {LIVES},
start AS (SELECT uid, birth, s0 AS nu, {PERIOD[1] * CLICKS}::BIGINT AS tau, -ln((((uid * 7919 + 104729) % 1000003)::DOUBLE + 0.5) / 1000003.0) AS target FROM life),
slots AS (
  SELECT *, ((z + a + (((z + a) >> 1) & 1)) >> 1) AS t, z - a AS width
  FROM (SELECT *, nu + k * {QUARTER} AS a, least(nu + (k + 1) * {QUARTER}, tau) AS z FROM (SELECT *, unnest(range(0, (tau - nu + {QUARTER} - 1) // {QUARTER})) AS k FROM start))),
gained AS (SELECT *, exp({mu}) * width / {CLICKS}.0 AS g FROM slots),
summed AS (SELECT *, sum(g) OVER (PARTITION BY uid ORDER BY k ROWS UNBOUNDED PRECEDING) AS h FROM gained),
crossed AS (SELECT uid, min(round_even(a + (target - (h - g)) / g * width, 0))::BIGINT AS hit FROM summed WHERE h >= target GROUP BY uid),
day AS (
  SELECT start.*, hit, hit // {CLICKS} AS y, hit % {CLICKS} AS r,
         CASE WHEN (hit // {CLICKS}) % 4 = 0 AND (hit // {CLICKS}) % 100 <> 0 OR (hit // {CLICKS}) % 400 = 0 THEN 1460 ELSE 1464 END AS d
  FROM start LEFT JOIN crossed USING (uid)),
noon AS (SELECT *, y * {CLICKS} + r - r % d + d // 2 AS m FROM day)
SELECT uid, nu AS "E2R_start", coalesce(least(CASE WHEN m <= nu THEN hit ELSE m END, tau), tau)::BIGINT AS "E2R_end", hit IS NOT NULL AND least(CASE WHEN m <= nu THEN hit ELSE m END, tau) <= tau AS "E2R_died" FROM noon"""


_EVENTS = f"WITH e AS (SELECT event_id, (floor(value) - event_id % 997)::DOUBLE AS v, ({2000 * CLICKS + 7} - (1950 + event_id % 40) * {CLICKS})::DOUBLE / {CLICKS} AS x FROM events)"
_SWEEP = {
    "floordiv": "floor(v / 7)", "mod": "v - floor(v / 7) * 7", "neg_mod": "-v - floor(-v / 7) * 7", "power": "sqrt(abs(v) / 100)", "log": "CASE WHEN v > -500 THEN ln(v + 500) WHEN v = -500 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "log1p": "ln(1 + abs(v))",
    "expm1": "exp(v / 1000) - 1", "round": "round_even(v / 2, 0)", "trunc": "trunc(v / 3)", "sign": "sign(v)::DOUBLE", "clamp": "least(greatest(v, -100), 100)", "least": "least(v, -v)", "most": "greatest(v / 2, 1)", "ceiling": "ceil(v / 4)",
    "choose": "CASE WHEN v > 0 THEN sqrt(abs(v)) ELSE -sqrt(abs(v)) END", "among": "CASE WHEN v IN (1, 2, 3) THEN 1.0 ELSE 0.0 END", "age": "greatest(x, 0)",
}
_VECTORS = {
    "neg": "-v", "exp": "exp(v / 1000)", "expm1": "exp(v / 1000) - 1", "log": "ln(v + 1)", "log1p": "ln(1 + v)", "m_from_q": "-ln(1 - v / 10000)", "add": "v + 2", "sub": "v - 2", "mul": "v * 2", "div": "v / 2", "pow": "sqrt(v)",
    "min": "least(v, 2)", "max": "greatest(v, 2)", "clamp": "least(greatest(v, 2), 50)",
}
_X = {"0": "1.0", "1": "CASE WHEN pension > 150000 THEN 1.0 ELSE 0.0 END", "2": "CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END"}
_MU = f"exp({G}) * width / {CLICKS}.0"
_ITEMS = [f"SELECT 'e' AS item, sum({_MU}) AS value FROM slots"] + [f"SELECT 'sA_{k}', sum({c}) FROM rows WHERE died" for k, c in _X.items()] + [f"SELECT 'sE_{k}', sum({_MU} * {c}) FROM slots" for k, c in _X.items()]
_ITEMS += [f"SELECT 'I_{j}{k}', sum({_MU} * {_X[j]} * {_X[k]}) FROM slots" for j in _X for k in _X if j <= k]
_CHART = [*BOTH_SQL, element_sql(None, "none", "pension < 0")]
_SHARED = [("big.f", "pension > 150000 AND status = 'F'"), ("big.o", "pension > 150000 AND status = 'O'"), ("f.o", "status = 'F' AND status = 'O'")]
_SHARED = [element_sql(None, n, g) for n, g in _SHARED]

ORACLE = {
    "aev_gompertz_lives": sql_aev(SEGMENT_SQL, G),
    "exp_trim": f'WITH {LIVES} SELECT uid, birth, s0 AS "E2R_start", s1 AS "E2R_end", dead AS "E2R_died" FROM life',
    "val_snapshot": f"WITH {LIVES} SELECT uid, birth, pension FROM life WHERE s0 <= {1999 * CLICKS} AND ({1999 * CLICKS} < s1 OR ({1999 * CLICKS} = s1 AND NOT dead))",
    "crude_exposure_deaths": sql_aev(SEGMENT_SQL, "0.0", omega=1),
    "aev_const": sql_aev(WHOLE, CONST_SQL),
    "aev_gompertz_amounts": sql_aev(SEGMENT_SQL, G, "pension / 1000", digits=5),
    "aev_indicator_weight": sql_aev(SEGMENT_SQL, G, "CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END"),
    "aev_table_lookup": sql_aev(SEGMENT_SQL, sql_table(TABLE)),
    "aev_table_from_q": sql_aev(STATUS_SQL, sql_table(TABLE_Q)),
    "aev_by_age_bands": sql_aev(AGE_SQL, G),
    "aev_by_periods": sql_aev(_PERIODS, G),
    "aev_by_duration": sql_aev(_DURATIONS, G),
    "aev_by_amount_bands": sql_aev(_BANDS, G),
    "aev_by_category": sql_aev([element_sql("status", "F+P", "status IN ('F', 'P')"), element_sql("status", "O", "status = 'O'")], G),
    "aev_overlapping_breakdown": sql_aev(_OVERLAP, G),
    "aev_include_population": sql_aev(_POPULATION, G),
    "aev_relevance": sql_aev(SEGMENT_SQL, G, s="CASE WHEN status = 'F' THEN 0.5 ELSE 1.0 END"),
    "aev_distance_decay": sql_aev(SEGMENT_SQL, G, "pension / 1000", f"exp(-0.2 * (2001 - t / {CLICKS}.0::DOUBLE))", digits=5),
    **{f"aev_time_scale_{n}": sql_aev(WHOLE, WAVE_SQL, step=CLICKS // n) for n in (1, 4, 12, 60)},
    "aev_properties": _properties(),
    "aev_sum_of_two": f"WITH {LIVES}, {sql_sums(SEGMENT_SQL, G)}, {sql_sums(SEGMENT_SQL, CONST_SQL, tag='2')}, {sql_labels(SEGMENT_SQL)} "
    'SELECT ord, "group", name, round((s.A + z.A)::DOUBLE, 6) AS A, round(s.E + z.E, 6) AS E, round(1.5 * (s.V + z.V), 6) AS V FROM labels JOIN sums s USING (ord) JOIN sums2 z USING (ord)',
    "mortality_select_by_segment": sql_aev(SEGMENT_SQL, f"CASE WHEN segment = 'BUILDING' THEN {G} ELSE {CONST_SQL} + 0.1 END"),
    "z_scale": f'WITH {LIVES}, {sql_sums(WHOLE, G, "pension / 1000")} SELECT round(V / E, 6) AS "Z" FROM sums',
    "overdispersion_pearson": f"WITH {LIVES}, {sql_sums(BOTH_SQL, CONST_SQL)}, chi AS (SELECT count(*)::INT AS cells, sum((A - E) * (A - E) / V) AS c FROM sums) "
    "SELECT cells - 1 AS df, cells, round(c / (cells - 1), 6) AS estimate, round(c / (cells - 1) * sqrt(2.0 / (cells - 1)), 6) AS stddev FROM chi",
    "fit_walk_at_beta0": f"WITH {LIVES}, {sql_sums(WHOLE, G)} SELECT item, round(value::DOUBLE, 6) AS value FROM ({' UNION ALL '.join(_ITEMS)})",
    "fit_intercept_closed_form": f"WITH {LIVES}, {sql_sums(WHOLE, G)} SELECT 'one' AS term, round(ln(A / E), 7) AS estimate, round(1.5 / A, 9) AS variance FROM sums",
    "fit_disjoint_groups": f"WITH {LIVES}, {sql_sums(SEGMENT_SQL, G)}, {sql_labels(SEGMENT_SQL)} SELECT name AS term, round(ln(A / E), 7) AS estimate, round(1.0 / A, 8)::DOUBLE AS variance FROM labels JOIN sums USING (ord)",
    "diagnose_grid": f"WITH {LIVES}, {sql_sums(WHOLE, G)}, {sql_sums(SEGMENT_SQL, G, tag='2')}, {sql_sums(STATUS_SQL, G, tag='3')}, level AS (SELECT A / E AS f FROM sums), "
    + f"every AS (SELECT 'segment' AS breakdown, * FROM sums2 UNION ALL SELECT 'status', * FROM sums3), names AS (SELECT 'segment' AS breakdown, ord, name FROM (WITH {sql_labels(SEGMENT_SQL)} SELECT * FROM labels) UNION ALL SELECT 'status', ord, name FROM (WITH {sql_labels(STATUS_SQL)} SELECT * FROM labels)) "
    + "SELECT 'level' AS model, breakdown, ord, name, round(A::DOUBLE, 5) AS A, round(E * f, 5) AS E, round(V * f, 5) AS V FROM every JOIN names USING (breakdown, ord), level",
    "disjoint_violation": f"WITH {LIVES}, {sql_sums(_SHARED, '0.0')}, {sql_labels(_SHARED)} SELECT name, round(coalesce(E, 0), 6) AS shared FROM labels LEFT JOIN sums USING (ord)",
    "simulate_hash_uniform": _simulated(),
    "expr_scalar_sweep": f"{_EVENTS} SELECT event_id, " + ", ".join(f'round({c}, 6)::DOUBLE + 0.0 AS "{n}"' for n, c in _SWEEP.items()) + " FROM e",
    "vec_ops": "WITH e AS (SELECT event_id, value::DOUBLE AS v FROM events) SELECT event_id, " + ", ".join(f'round({c}, 6)::DOUBLE AS "{n}"' for n, c in _VECTORS.items()) + " FROM e",
    "chart_status": f"WITH {LIVES}, {sql_sums(_CHART, G)}, {sql_labels(_CHART)}, full_ AS (SELECT ord, name, coalesce(A, 0) AS A, coalesce(E, 0) AS E, 1.5 * coalesce(V, 0) AS V FROM labels LEFT JOIN sums USING (ord)), "
    "r AS (SELECT *, CASE WHEN E > 0 THEN CASE WHEN A > 0 THEN ln(A / E) ELSE '-inf'::DOUBLE END ELSE 'nan'::DOUBLE END AS c FROM full_), "
    "s AS (SELECT *, CASE WHEN A = 0 AND E = 0 AND V = 0 THEN 'empty' WHEN c + sqrt(V) / E >= -0.5 AND c - sqrt(V) / E <= 0.5 THEN 'ok' ELSE 'off_scale' END AS status FROM r) "
    "SELECT ord, name, status, round(c, 6) AS log_ratio, round(CASE WHEN isnan(c) THEN c ELSE least(greatest(c, -0.5), 0.5) END, 6) AS clamped, "
    "CASE WHEN status = 'off_scale' AND c > 0.5 THEN 'up' WHEN status = 'off_scale' AND c < -0.5 THEN 'down' END AS chevron, 1::BIGINT AS group_run FROM s",
    "batch_two_aevs": f"WITH {LIVES}, {sql_sums(SEGMENT_SQL, G)}, {sql_sums(SEGMENT_SQL, G, 'pension / 1000', tag='2')}, {sql_labels(SEGMENT_SQL)} "
    "SELECT 'lives' AS element, ord, name, round(A::DOUBLE, 5) AS A, round(E, 5) AS E, round(1.5 * V, 5) AS V FROM labels JOIN sums USING (ord) "
    "UNION ALL SELECT 'amounts', ord, name, round(A::DOUBLE, 5), round(E, 5), round(1.5 * V, 5) FROM labels JOIN sums2 USING (ord)",
}
assert math.isfinite(float(CONST_SQL))
