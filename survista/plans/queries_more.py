"""More registered queries with the SQL that must agree: data checks, IEEE edges, labels, refusals, models.

Refusals are results as well: a row tells which call was refused. Scalars of single lives are worked out over the
rows of `nation`, of which there are 25 at any scale.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survista.functions import ieee, vectors
from survista.functions.clicks import CLICKS, instant
from survista.operators import chart
from survista.operators.aev import aev, create_aev, is_aev
from survista.operators.batch import FitFailure, batch, element
from survista.operators.compare import best_fit, compare_models, is_diagnosis, is_model_comparison
from survista.operators.covariates import covariates, disjoint, is_covariates, is_disjoint, is_model, model
from survista.operators.fit import coef, fit, is_fit, vcov
from survista.operators.include import (
    Includes, age, categories, category, duration, include, includes, indicator, is_include, is_includes, is_indicator, is_static_variable, is_variable, logical_value, period_included, static_variable, value, variable,
)
from survista.operators.mortality import default_mortality, end_age, is_mortality, log_mu, mortality_const, mortality_table
from survista.operators.settings import is_settings, settings
from survista.plans import expr as E
from survista.plans.columns import DOUBLE, Scope, typed
from survista.plans.queries import (
    BOTH_SQL, CONSTANT, G, GOMPERTZ, LIVES, PENSION, SEGMENT, SEGMENT_SQL, SEGMENT_STATUS, SEGMENTS, STATUS, STATUS_SQL, STATUSES, TABLE, TABLE_Q, WAVE, WAVE_SQL, WHOLE, element_sql, order_experience, rounded, sql_aev, sql_gompertz, sql_labels, sql_sums,
)
from survista.sources.data import DataError, as_at, as_times, exp_data, exp_end, exp_start, is_exp_data, is_val_data, stats, val_data, val_from_exp_data
from survista.sources.lives import PERIOD, order_lives

i, t, b, x = E.i, E.t, E.b, E.x

#: What stands for values that are not finite, and for the missing one.
NOT_FINITE = {"nan": -9e300, "inf": 9e300, "-inf": -8e300}


def refused(spark, cases: dict) -> DataFrame:
    """case, refused: whether each call raises the error it should."""
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, False))
        except (ValueError, TypeError):
            rows.append((name, True))
    return spark.createDataFrame(rows, "case string, refused boolean")


def refused_sql(cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"case\", {c} AS refused" for n, c in cases.items())


# ---- data ----


def val_data_counted(spark, sf_dir):
    """A snapshot made of lives as they are; a count of 0 drops a life."""
    lives = order_lives(spark, sf_dir).drop("E2R_start", "E2R_end", "E2R_died", "priority").withColumn("count", F.col("uid") % 3)
    v = val_data(lives, 1999)
    return v.df.select("uid", "birth", F.col("count").cast("long").alias("lives"), "pension")


def exp_data_verified(spark, sf_dir):
    """All rules checked; lives with an end before their start are refused, and counted in the refusal."""
    good = order_experience(spark, sf_dir, verify=True).df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    lives = order_lives(spark, sf_dir)
    turned = lives.withColumns({"E2R_start": F.when(F.col("uid") % 7 == 0, F.col("E2R_end")).otherwise(F.col("E2R_start")), "E2R_end": F.when(F.col("uid") % 7 == 0, F.col("E2R_start")).otherwise(F.col("E2R_end"))})
    rows = [("trimmed", good)]
    try:
        exp_data(as_times(turned, ["birth", "E2R_start", "E2R_end"]), *PERIOD)
    except DataError as e:
        rows.append(("turned", int(str(e).rpartition("(")[2].split()[0])))
    return spark.createDataFrame(rows, "item string, n bigint")


def assign_column(spark, sf_dir):
    """A new column is a fact like any other, and a new end of observation trims anew."""
    d = order_experience(spark, sf_dir).with_column("big", F.col("pension") > 150000)
    before = F.col("E2R_start") < 1999 * CLICKS
    early = F.when(before, F.least(F.col("E2R_end"), F.lit(1999 * CLICKS))).otherwise(F.col("E2R_end")).cast("long").alias("E2R_end", metadata={"kind": "instant"})
    return rounded(aev(d.with_column("E2R_end", early), GOMPERTZ, weight=i.big, breakdown=SEGMENT, overdispersion=1.5))


def column_scan(spark, sf_dir):
    d = order_experience(spark, sf_dir).with_column("part", F.when(F.col("uid") % 10 != 0, F.col("pension"))).with_column("none", F.lit(None).cast("double")).with_column("one", F.lit(1.0))
    rows = [(n, None if s["min"] is None else round(float(s["min"]), 6), None if s["max"] is None else round(float(s["max"]), 6), bool(s["has_values"]), bool(s["has_missing"]), bool(s["constant"])) for n, s in stats(d, ["birth", "pension", "part", "none", "one"]).items()]
    return spark.createDataFrame(rows, "name string, least double, most double, has_values boolean, has_missing boolean, constant boolean")


def data_accessors(spark, sf_dir):
    d = order_experience(spark, sf_dir)
    v = val_from_exp_data(d)
    a = aev(d, CONSTANT, overdispersion=1)
    yes = [is_exp_data(d), is_val_data(v), is_aev(a), is_mortality(GOMPERTZ), is_include(age(50)), is_includes(SEGMENT), is_indicator(indicator(i.pension > 1)), is_variable(variable(x)), is_static_variable(variable(i.pension)), is_covariates(covariates(one=1.0)), is_disjoint(disjoint(SEGMENT)), is_model(model(GOMPERTZ, covariates(one=1.0))), is_settings(settings(overdispersion=1))]
    no = [is_exp_data(v), is_val_data(d), is_fit(d), is_model_comparison(d), is_diagnosis(d), is_static_variable(variable(x)), is_indicator(variable(x)), is_disjoint(covariates(one=1.0)), is_include(SEGMENT)]
    dates = (exp_start(d).years, exp_end(d).years, as_at(v).years)
    row = (all(yes), any(no), *dates, repr(d), repr(val_from_exp_data(d, 1999)))
    return spark.createDataFrame([row], "yes boolean, no boolean, first double, last double, at double, header string, snapshot string")


# ---- expressions ----

_ODD = ["nan", "0", "-0", "inf", "-inf", "v", "-v", "1"]


def _odd(which: str) -> Column:
    value = F.col("value").cast("double")
    picks = {"nan": ieee.lit(float("nan")), "0": ieee.lit(0.0), "-0": ieee.lit(-0.0), "inf": ieee.lit(float("inf")), "-inf": ieee.lit(float("-inf")), "v": value, "-v": -value, "1": ieee.lit(1.0)}
    out = picks["1"]
    for k, name in enumerate(_ODD[:-1]):
        out = F.when(F.col(which) == k, picks[name]).otherwise(out)
    return out


def _sql_odd(which: str) -> str:
    picks = {"nan": "'nan'::DOUBLE", "0": "0.0::DOUBLE", "-0": "'-0.0'::DOUBLE", "inf": "'inf'::DOUBLE", "-inf": "'-inf'::DOUBLE", "v": "value::DOUBLE", "-v": "-(value::DOUBLE)", "1": "1.0::DOUBLE"}
    return "CASE " + " ".join(f"WHEN {which} = {k} THEN {picks[n]}" for k, n in enumerate(_ODD)) + " END"


#: name: (expression, SQL). Signs of zeros show in their inverse.
_NAN = "'nan'::DOUBLE"
EDGES = {
    "div": ("i.v / i.w", "v / w"), "floordiv": ("i.v // i.w", "floor(v / w)"), "mod": ("i.v % i.w", "v - floor(v / w) * w"),
    "pow": ("abs(i.v) ** 2", "abs(v) * abs(v)"), "pow0": ("i.v ** (i.w * 0 + 0)", f"CASE WHEN v = 1 OR w * 0 = 0 THEN 1 ELSE {_NAN} END"), "one_pow": ("(i.v * 0 + 1) ** i.w", f"CASE WHEN w = 0 OR isfinite(v) THEN 1 ELSE {_NAN} END"),
    "less": ("ifelse(i.v < i.w, 1, 0)", "CASE WHEN NOT isnan(v) AND NOT isnan(w) AND v < w THEN 1 ELSE 0 END"), "least_eq": ("ifelse(i.v <= i.w, 1, 0)", "CASE WHEN NOT isnan(v) AND NOT isnan(w) AND v <= w THEN 1 ELSE 0 END"),
    "more": ("ifelse(i.v > i.w, 1, 0)", "CASE WHEN NOT isnan(v) AND NOT isnan(w) AND v > w THEN 1 ELSE 0 END"), "most_eq": ("ifelse(i.v >= i.w, 1, 0)", "CASE WHEN NOT isnan(v) AND NOT isnan(w) AND v >= w THEN 1 ELSE 0 END"),
    "equal": ("ifelse(i.v == i.w, 1, 0)", "CASE WHEN NOT isnan(v) AND NOT isnan(w) AND v = w THEN 1 ELSE 0 END"), "unlike": ("ifelse(i.v != i.w, 1, 0)", "CASE WHEN isnan(v) OR isnan(w) OR v <> w THEN 1 ELSE 0 END"),
    "or": ("ifelse((i.v > 0) | (i.w > 0), 1, 0)", "CASE WHEN NOT isnan(v) AND v > 0 OR NOT isnan(w) AND w > 0 THEN 1 ELSE 0 END"), "not": ("ifelse(not (i.v > 0), 1, 0)", "CASE WHEN isnan(v) OR v <= 0 THEN 1 ELSE 0 END"),
    "xor": ("ifelse(xor(i.v > 0, i.w > 0), 1, 0)", "CASE WHEN (NOT isnan(v) AND v > 0) <> (NOT isnan(w) AND w > 0) THEN 1 ELSE 0 END"), "missing": ("ifelse(is_na(i.v), 1, 0)", "CASE WHEN isnan(v) THEN 1 ELSE 0 END"),
    "least": ("min(i.v, i.w)", f"CASE WHEN isnan(v) OR isnan(w) THEN {_NAN} ELSE least(v, w) END"), "most": ("max(i.v, i.w)", f"CASE WHEN isnan(v) OR isnan(w) THEN {_NAN} ELSE greatest(v, w) END"),
    "least_sign": ("1 / min(i.v, i.w)", f"CASE WHEN isnan(v) OR isnan(w) THEN {_NAN} WHEN v = 0 AND w = 0 THEN least(1 / v, 1 / w) ELSE 1 / least(v, w) END"), "most_sign": ("1 / max(i.v, i.w)", f"CASE WHEN isnan(v) OR isnan(w) THEN {_NAN} WHEN v = 0 AND w = 0 THEN greatest(1 / v, 1 / w) ELSE 1 / greatest(v, w) END"),
    "clamp": ("clamp(i.v, -5, 5)", f"CASE WHEN isnan(v) THEN {_NAN} ELSE least(greatest(v, -5), 5) END"), "log10": ("log10(i.v)", f"CASE WHEN isnan(v) OR v < 0 THEN {_NAN} WHEN v = 0 THEN '-inf'::DOUBLE WHEN v = 'inf'::DOUBLE THEN v ELSE log10(v) END"),
    "cos": ("cos(clamp(i.v, -5, 5))", f"CASE WHEN isnan(v) THEN {_NAN} ELSE cos(least(greatest(v, -5), 5)) END"), "tangent": ("sin(clamp(i.v, -5, 5)) / cos(clamp(i.v, -5, 5))", f"CASE WHEN isnan(v) THEN {_NAN} ELSE sin(least(greatest(v, -5), 5)) / cos(least(greatest(v, -5), 5)) END"),
}


def expr_ieee_edges(spark, sf_dir):
    """Every pair of odd values, by the event's number: missing, zeros of both signs, infinities."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", (F.col("event_id") % 8).alias("p"), (F.floor(F.col("event_id") / 8) % 8).alias("q"))
    e = e.select("event_id", _odd("p").alias("v"), _odd("q").alias("w"))
    scope = Scope({"v": DOUBLE, "w": DOUBLE}, None)
    show = lambda c: F.when(F.isnan(c), ieee.lit(NOT_FINITE["nan"])).when(c == float("inf"), ieee.lit(NOT_FINITE["inf"])).when(c == float("-inf"), ieee.lit(NOT_FINITE["-inf"])).otherwise(F.round(c, 6) + ieee.lit(0.0))
    return e.select("event_id", *[show(typed(E.parse(s), scope).double()).alias(n) for n, (s, _) in EDGES.items()])


def _edges_sql() -> str:
    show = lambda c: f"CASE WHEN isnan({c}) THEN {NOT_FINITE['nan']!r} WHEN {c} = 'inf'::DOUBLE THEN {NOT_FINITE['inf']!r} WHEN {c} = '-inf'::DOUBLE THEN {NOT_FINITE['-inf']!r} ELSE round({c}, 6) + 0.0 END"
    inner = ", ".join(f'({s})::DOUBLE AS "{n}"' for n, (_, s) in EDGES.items())
    outer = ", ".join(f'({show(chr(34) + n + chr(34))})::DOUBLE AS "{n}"' for n in EDGES)
    return f"""WITH e AS (SELECT event_id, value, event_id % 8 AS p, (event_id // 8) % 8 AS q FROM events), f AS (SELECT event_id, {_sql_odd('p')} AS v, {_sql_odd('q')} AS w FROM e),
g AS (SELECT event_id, {inner} FROM f) SELECT event_id, {outer} FROM g"""


def _nations(spark, sf_dir) -> list[dict]:
    """Facts of single lives; 25 rows at any scale."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    return [{"key": int(r[0]), "birth": instant((1930 + int(r[0])) * 1.0), "pension": 1000.0 * int(r[0]), "region": float(r[1])} for r in rows]


_SQL_NATION = f"n AS (SELECT n_nationkey::BIGINT AS key, ((1930 + n_nationkey) * {CLICKS})::BIGINT AS birth, (1000.0 * n_nationkey)::DOUBLE AS pension, n_regionkey::DOUBLE AS region FROM nation)"


def values_of_lives(spark, sf_dir):
    """value(), logical_value(), period_included() and log_mu() of single lives."""
    rows = []
    who = include(i.region > 0) & duration(b, 50, 60) & Includes((age(55, 65),))[0]
    for f in _nations(spark, sf_dir):
        span = period_included(who, f, 1985, 1993)
        rows.append((f["key"], round(float(value(x * 2 + i.pension, f, 2000)), 6), logical_value(i.pension > 5000, f), None if span is None else span[0].years, None if span is None else span[1].years, round(log_mu(GOMPERTZ, f, 2000), 6), round(log_mu(TABLE, f, 1999), 6)))
    return spark.createDataFrame(rows, "key bigint, value double, rich boolean, first double, last double, gompertz double, looked_up double")


# ---- variables, includes, labels ----


def include_algebra(spark, sf_dir):
    """Conjunctions, labels and slices of includes."""
    first = includes(young=age(high=50), big=indicator(i.pension > 150000), status=STATUSES) & include(i.segment != "MACHINERY")
    labelled = first.with_names(["young", "big", "F", "O", "P"]).with_group_names(["a", "b", None, None, None])
    both = indicator(i.status == "F") & indicator(i.pension > 150000)
    return rounded(aev(order_experience(spark, sf_dir), GOMPERTZ, overdispersion=1.5, breakdown=includes(labelled[1:4], labelled[0], both.named("F and big", "c"))))


def variable_weight(spark, sf_dir):
    """A product of a variable with an indicator as weight; variables are narrowed to what they are."""
    w = static_variable(PENSION) * indicator(i.status == "F").as_node()
    return rounded(aev(order_experience(spark, sf_dir), GOMPERTZ, weight=w, overdispersion=1.5, breakdown=STATUSES), 4)


def category_levels(spark, sf_dir):
    """Categories that data give, and one of several values as population."""
    d = order_experience(spark, sf_dir)
    return rounded(aev(d, GOMPERTZ, include=category(i.status, ["F", "O"], "open or not"), overdispersion=1.5, breakdown=categories(i.segment, source=d, exhaustive=True)))


def aev_records(spark, sf_dir):
    """Records by position and with new labels, and records made of numbers."""
    a = aev(order_experience(spark, sf_dir), GOMPERTZ, overdispersion=1.5, breakdown=SEGMENT)
    some = a[[4, 0]].with_names(["last", "first"]).with_group_names("ends")
    made = create_aev(spark, [1.0, 2.0, 4.0], [2.0, 2.0, 2.0], [1.0, 1.0, 4.0], ["x", "y", "z"])[1:].with_group_names(["g", None])
    ratio = lambda r: r.df.join(r.property("A_over_E"), "ord").select("ord", "group", "name", *[F.round(c, 6).alias(c) for c in (*"AEV", "A_over_E")])
    return ratio(some).unionByName(ratio(made))


def refusals(spark, sf_dir):
    """Calls that must be refused, some by what the data hold."""
    d = order_experience(spark, sf_dir)
    run = lambda **how: lambda: aev(d, GOMPERTZ, overdispersion=1, **how)
    return refused(spark, {
        "relevance above 1": run(val_relevance=i.pension / 100), "relevance within": run(val_relevance=i.pension / 1e9), "relevance constant": run(val_relevance=1.5), "distance below 0": run(val_distance=t - 2002), "distance above 0": run(val_distance=2002 - t),
        "both": run(val_relevance=0.5, val_distance=1.0), "no overdispersion": lambda: aev(d, GOMPERTZ), "create: negative": lambda: create_aev(spark, [1.0], [-1.0], [1.0]), "create: lengths": lambda: create_aev(spark, [1.0], [1.0, 2.0], [1.0]), "create": lambda: create_aev(spark, [1.0], [1.0], [1.0]),
        "settings: step": lambda: settings(time_scale=1 / 7), "settings: overdispersion": lambda: settings(overdispersion=0), "mortality: none": mortality_const, "table: not finite": _bad_table, "as_at outside": lambda: val_from_exp_data(d, 2010),
        "two names": lambda: categories(i.status, "F", "F"), "unknown level": lambda: categories(i.status, "X", source=STATUS), "not exhaustive": lambda: categories(i.status, "F", source=STATUS, exhaustive=True), "batch: not an element": lambda: batch(d, {"a": GOMPERTZ}), "batch: a sibling's name": lambda: batch(d, {"a": element("aev", GOMPERTZ, overdispersion=1), "b": element("aev", "a", overdispersion=1)}),
    })


def _bad_table():
    return mortality_table(30, 2000, log_mu=[[0.0, float("nan")]])


# ---- mortalities, settings ----


def mortality_facts(spark, sf_dir):
    """End ages and what counts as a mortality."""
    rows = [("table", end_age(TABLE).years, is_mortality(TABLE)), ("table of q", end_age(TABLE_Q).years, is_mortality(TABLE_Q)), ("gompertz", None, is_mortality(GOMPERTZ) and end_age(GOMPERTZ) is None), ("number", None, is_mortality(1.0))]
    return spark.createDataFrame(rows, "name string, end_age double, is_mortality boolean")


def settings_resolved(spark, sf_dir):
    """What a call says goes before its settings."""
    d, s = order_experience(spark, sf_dir), settings(overdispersion=2.0, time_scale=1)
    a = rounded(aev(d, WAVE, settings=s)).withColumn("how", F.lit("settings"))
    return a.unionByName(rounded(aev(d, WAVE, settings=s, overdispersion=1.5, time_scale=1 / 12)).withColumn("how", F.lit("call")))


# ---- models ----


def _terms_df(spark, f, digits: int = 6) -> DataFrame:
    v = vcov(f)
    return spark.createDataFrame([(n, round(c, digits), round(float(v[k, k]), digits + 2)) for k, (n, c) in enumerate(coef(f).items())], "term string, estimate double, variance double")


def covariate_products(spark, sf_dir):
    """Crossed disjoint covariates: a group for each segment and status."""
    both = disjoint(SEGMENT) * disjoint(STATUSES)
    return _terms_df(spark, fit(order_experience(spark, sf_dir), model(GOMPERTZ, both), test_mortality=GOMPERTZ, overdispersion=1, tolerance=1e-12), 5)


def fit_weighted_amounts(spark, sf_dir):
    """Weights other than 0 and 1: the matrix of squared weights enters variance and penalty, and Z is not 1."""
    f = fit(order_experience(spark, sf_dir), model(GOMPERTZ, disjoint(SEGMENT)), weight=PENSION, test_mortality=CONSTANT, overdispersion=1.5, tolerance=1e-14)
    return _terms_df(spark, f).withColumns({"Z": F.lit(round(f.Z, 6)), "penalty": F.lit(round(f.penalty, 6)), "likelihood": F.lit(round(f.log_likelihood, 3))})


def best_of_models(spark, sf_dir):
    models = [model(GOMPERTZ, covariates(one=1.0), "level"), model(GOMPERTZ, covariates(one=1.0) + covariates(big=i.pension > 150000)[0], "size")]
    f = best_fit(compare_models(order_experience(spark, sf_dir), models, test_mortality=GOMPERTZ, overdispersion=1, tolerance=1e-14))
    return _terms_df(spark, f).withColumn("model", F.lit(f.name))


def batch_with_defaults(spark, sf_dir):
    """Analyses of both kinds; an element's own argument displaces a default; overlapping covariates fail alone."""
    d = order_experience(spark, sf_dir)
    got = batch(d, {
        "all": element("aev", GOMPERTZ), "half": element("aev", GOMPERTZ, val_distance=0.6931471805599453), "level": element("fit", model(GOMPERTZ, covariates(one=1.0))),
        "overlap": element("fit", model(GOMPERTZ, disjoint(f=i.status == "F", big=i.pension > 150000))),
    }, overdispersion=1.5, val_relevance=0.25, test_mortality=GOMPERTZ, tolerance=1e-14)
    out = spark.createDataFrame([("level", round(float(got["level"].coefficients[0]), 6), round(float(got["level"].variance[0, 0]), 8), 0.0), ("overlap", float(isinstance(got["overlap"], FitFailure)), 0.0, 0.0)], "element string, A double, E double, V double")
    for n, digits in (("all", 5), ("half", 5)):
        out = out.unionByName(got[n].df.select(F.lit(n).alias("element"), *[F.round(c, digits).alias(c) for c in "AEV"]))
    return out


# ---- kernels, chart ----

_XS = [-2.5, -1.0, -0.0, 0.0, 0.25, 1.0, 7.0]


def vec_recycled(spark, sf_dir):
    """Kernels on arrays; an argument of length 1 is repeated."""
    v = vectors
    cols = [v.vec_add(_XS, 2), v.vec_sub(2, _XS), v.vec_mul(_XS, [3]), v.vec_pow(2, _XS), v.vec_min(_XS, 0.5), v.vec_max(0.5, _XS), v.vec_clamp(_XS, -1, [1]), v.vec_neg(_XS), v.vec_exp(_XS), v.vec_m_from_q(np.array(_XS) / 10)]
    names = ["add", "sub", "mul", "pow", "least", "most", "clamp", "neg", "exp", "m"]
    rows = [(k, float(a), *[round(float(c[k]), 6) + 0.0 for c in cols]) for k, a in enumerate(_XS)]
    return spark.createDataFrame(rows, "k int, x double, " + ", ".join(f"`{n}` double" for n in names))


def chart_ramp(spark, sf_dir):
    """Colours of residuals, and which grid line is nearest below."""
    a = aev(order_experience(spark, sf_dir), GOMPERTZ, overdispersion=1.5, breakdown=SEGMENT_STATUS)
    lines = chart.breaks()
    f = chart.plot_frame(a)
    below = F.size(F.filter(F.array(*[F.lit(v) for v in lines]), lambda g: g <= F.col("clamped")))
    return f.select("ord", "name", F.round("ramp", 6).alias("ramp"), below.cast("long").alias("lines_below"))


QUERIES = {
    f.__name__: f
    for f in (
        val_data_counted, exp_data_verified, assign_column, column_scan, data_accessors, expr_ieee_edges, values_of_lives, include_algebra, variable_weight, category_levels, aev_records, refusals, mortality_facts, settings_resolved,
        covariate_products, fit_weighted_amounts, best_of_models, batch_with_defaults, vec_recycled, chart_ramp,
    )
} | {"aev_default_mortality": lambda spark, sf_dir: rounded(aev(order_experience(spark, sf_dir), default_mortality(), overdispersion=1.5, breakdown=SEGMENT))}


# ---- SQL side ----

_BIG = "pension > 150000"
_HEADER = "ExpData [1996, 2001) birth: instant, E2R_start: instant, E2R_end: instant, E2R_died: bool, pension: double, status: text, priority: text, segment: text"


def _grouped_fit(elements, mu: str, w: str, omega: float, digits: int, more: str = "") -> str:
    return f"""WITH {LIVES}, {sql_sums(elements, mu, w)}, {sql_labels(elements)}{more}
SELECT name AS term, round(ln(A / E), {digits}) AS estimate, round({omega} * V / (E * A), {digits + 2})::DOUBLE AS variance"""


def deaths_log(mu: str, w: str = "1.0") -> str:
    """Sum over deaths of weight times log mu at the end of the span."""
    return f"(SELECT sum(({w}) * {mu}) FROM (SELECT *, s1 AS t FROM life WHERE dead))"


def likelihoods(models: list[tuple[str, list]], mu: str) -> str:
    """CTEs ending in ranked(model, L, penalty) for models whose groups are disjoint and cover."""
    parts, rows = [], []
    for k, (name, elements) in enumerate(models):
        parts.append(sql_sums(elements, mu, tag=f"_m{k}"))
        rows.append(f"SELECT '{name}' AS model, {deaths_log(mu)} + sum(A * ln(A / E)) - sum(A) AS L, count(*)::DOUBLE AS penalty FROM sums_m{k}")
    return ", ".join(parts) + ", ranked AS (" + " UNION ALL ".join(rows) + ")"


_SIZE = [element_sql(None, "small", f"NOT ({_BIG})"), element_sql(None, "big", _BIG)]
_ALGEBRA = [
    element_sql("b", "big", f"{_BIG} AND segment <> 'MACHINERY'"), element_sql(None, "F", "status = 'F' AND segment <> 'MACHINERY'"), element_sql(None, "O", "status = 'O' AND segment <> 'MACHINERY'"),
    element_sql("a", "young", "segment <> 'MACHINERY'", [(None, f"birth + {50 * CLICKS}")]), element_sql("c", "F and big", f"status = 'F' AND {_BIG}"),
]


def newton_sql(xs: list[str], names: list[str], mu: str, rounds: int = 10) -> str:
    """Newton steps from 0 for covariates xs (SQL of t and facts), three of them, solved by cofactors."""
    slots = f"xs AS MATERIALIZED (SELECT exp({mu}) * width / {CLICKS}.0 AS m, {', '.join(f'({c})::DOUBLE AS x{k}' for k, c in enumerate(xs))} FROM slots)"
    dead = f"sa AS MATERIALIZED (SELECT {', '.join(f'sum(({c})::DOUBLE) AS a{k}' for k, c in enumerate(xs))} FROM (SELECT *, tau AS t FROM rows WHERE died))"
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    cof = "h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22"
    for n in range(rounds + 1):
        h = ", ".join(f"sum(e * x{j} * x{k}) AS h{j}{k}" for j in range(3) for k in range(j, 3))
        steps.append(f"w{n} AS MATERIALIZED (SELECT sum(e * x0) AS s0, sum(e * x1) AS s1, sum(e * x2) AS s2, {h} FROM (SELECT xs.*, m * exp(b0 * x0 + b1 * x1 + b2 * x2) AS e FROM xs, b{n}))")
        steps.append(f"c{n} AS MATERIALIZED (SELECT *, {cof}, a0 - s0 AS g0, a1 - s1 AS g1, a2 - s2 AS g2 FROM w{n}, sa)")
        steps.append(f"d{n} AS MATERIALIZED (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM c{n})")
        if n < rounds:
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det AS b0, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det AS b1, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det AS b2 FROM b{n}, d{n})")
    return f"{slots}, {dead}, {', '.join(steps)}, " + "est AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS term, b{k} AS estimate, sqrt(c{k}{k} / det) AS stddev FROM b{rounds}, d{rounds}" for k, n in enumerate(names)) + ")"


def _refusals_sql() -> str:
    kept = ["relevance within", "distance above 0", "create"]
    every = ["relevance constant", "distance below 0", "both", "no overdispersion", "create: negative", "create: lengths", "settings: step", "settings: overdispersion", "mortality: none", "table: not finite", "as_at outside", "two names", "unknown level", "not exhaustive", "batch: not an element", "batch: a sibling's name"]
    return f"WITH {LIVES} SELECT 'relevance above 1' AS \"case\", min(pension) / 100 > 1 AS refused FROM life UNION ALL " + refused_sql({n.replace("'", "''"): "true" for n in every} | {n: "false" for n in kept})


def _ramp_sql() -> str:
    v, r = "(1.5 * V)", "(A / E)"
    al = f"({r} - 1)"
    z = f"CASE WHEN {r} = 0 THEN -E * sqrt(2 / {v}) WHEN abs({al}) > 0.0015 THEN sign({al}) * E * sqrt(2 * ({r} * ln({r}) - {al}) / {v}) ELSE E / sqrt({v}) * {al} * (1 + {al} * (-1.0/6 + {al} * (5.0/72 - {al} * 83/2160))) END"
    held = "least(greatest(ln(A / E), -0.5), 0.5)"
    return f"""WITH {LIVES}, {sql_sums(BOTH_SQL, G)}, {sql_labels(BOTH_SQL)}, z AS (SELECT ord, name, abs({z}) AS z, {held} AS held FROM labels JOIN sums USING (ord))
SELECT ord, name, round(least(greatest(z - 0.5, 0), 1) + least(greatest((z - 1.5) / 1.5, 0), 1), 6) AS ramp, (SELECT count(*) FROM (SELECT unnest([-0.5, -0.5 + 0.1 * 1, -0.5 + 0.1 * 2, -0.5 + 0.1 * 3, -0.5 + 0.1 * 4, -0.5 + 0.1 * 5, -0.5 + 0.1 * 6, -0.5 + 0.1 * 7, -0.5 + 0.1 * 8, -0.5 + 0.1 * 9, 0.5]) AS g) WHERE g <= held)::BIGINT AS lines_below FROM z"""


_WHO = f"greatest({1985 * CLICKS}, birth + {50 * CLICKS}, birth + {55 * CLICKS})", f"least({1993 * CLICKS}, birth + {60 * CLICKS}, birth + {65 * CLICKS})"
_COMPARED = [("level", WHOLE), ("segment", SEGMENT_SQL), ("size", _SIZE)]
_AGE = ["1.0", f"((t - birth) / {CLICKS}.0::DOUBLE - 55)", "CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END"]

ORACLE = {
    "val_data_counted": f"WITH {LIVES} SELECT uid, birth, uid % 3 AS lives, pension FROM spans WHERE c1 > c0 AND uid % 3 <> 0",
    "exp_data_verified": f"WITH {LIVES} SELECT 'trimmed' AS item, count(*) AS n FROM life UNION ALL SELECT 'turned', count(*) FROM spans WHERE c1 > c0 AND uid % 7 = 0",
    "assign_column": sql_aev(SEGMENT_SQL, G, f"CASE WHEN {_BIG} THEN 1.0 ELSE 0.0 END").replace(
        "life AS (", "life_ AS (", 1).replace(", \nrows AS", f", life AS (SELECT * REPLACE (CASE WHEN s0 < {1999 * CLICKS} THEN least(s1, {1999 * CLICKS}) ELSE s1 END AS s1) FROM life_),\nrows AS", 1),
    "column_scan": f"""WITH {LIVES}, s AS (SELECT birth, pension, CASE WHEN uid % 10 <> 0 THEN pension END AS part FROM life)
SELECT 'birth' AS name, min(birth)::DOUBLE AS least, max(birth)::DOUBLE AS most, true AS has_values, false AS has_missing, min(birth) = max(birth) AS constant FROM s
UNION ALL SELECT 'pension', round(min(pension), 6), round(max(pension), 6), true, false, min(pension) = max(pension) FROM s
UNION ALL SELECT 'part', round(min(part), 6), round(max(part), 6), true, count(part) < count(*), min(part) = max(part) FROM s UNION ALL SELECT 'none', NULL, NULL, false, true, false UNION ALL SELECT 'one', 1.0, 1.0, true, false, true""",
    "data_accessors": f"SELECT true AS yes, false AS no, 1996.0::DOUBLE AS first, 2001.0::DOUBLE AS last, 2001.0::DOUBLE AS at, '{_HEADER}' AS header, 'ValData at 1999 birth: instant, pension: double, status: text, priority: text, segment: text' AS snapshot",
    "expr_ieee_edges": _edges_sql(),
    "values_of_lives": f"""WITH {_SQL_NATION} SELECT key, round(2 * (2000 - birth / {CLICKS}.0::DOUBLE) + pension, 6) AS value, pension > 5000 AS rich,
CASE WHEN region > 0 AND {_WHO[0]} < {_WHO[1]} THEN {_WHO[0]} / {CLICKS}.0::DOUBLE END AS first, CASE WHEN region > 0 AND {_WHO[0]} < {_WHO[1]} THEN {_WHO[1]} / {CLICKS}.0::DOUBLE END AS last,
round(-3.0 + 0.06 * ((2000 - birth / {CLICKS}.0::DOUBLE) - 60) - 0.01 * (2000 - 1998), 6) AS gompertz, round((-6.0 + 0.075 * a - 0.02 * 3 + 0.001 * a * 3)::DOUBLE, 6) AS looked_up FROM (SELECT *, least(greatest(1999 - (1930 + key) - 30, 0), 49) AS a FROM n)""",
    "include_algebra": sql_aev(_ALGEBRA, G),
    "variable_weight": sql_aev(STATUS_SQL, G, "(pension / 1000) * CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END", digits=4),
    "category_levels": sql_aev([element_sql(g, n, f"{c} AND status IN ('F', 'O')") for g, n, c, _ in SEGMENT_SQL], G),
    "aev_records": f"WITH {LIVES}, {sql_sums(SEGMENT_SQL, G)} SELECT CASE ord WHEN 5 THEN 1 ELSE 2 END::BIGINT AS ord, 'ends' AS \"group\", CASE ord WHEN 5 THEN 'last' ELSE 'first' END AS name, round(A::DOUBLE, 6) AS A, round(E, 6) AS E, round(1.5 * V, 6) AS V, round(A / E, 6) AS A_over_E FROM sums WHERE ord IN (1, 5) "
    "UNION ALL SELECT 1, 'g', 'y', 2, 2, 1, 1 UNION ALL SELECT 2, NULL, 'z', 4, 2, 4, 2",
    "refusals": _refusals_sql(),
    "mortality_facts": "SELECT 'table' AS name, 80.0::DOUBLE AS end_age, true AS is_mortality UNION ALL SELECT 'table of q', 80.5, true UNION ALL SELECT 'gompertz', NULL, true UNION ALL SELECT 'number', NULL, false",
    "settings_resolved": f"SELECT *, 'settings' AS how FROM ({sql_aev(WHOLE, WAVE_SQL, omega=2.0, step=CLICKS)}) UNION ALL SELECT *, 'call' FROM ({sql_aev(WHOLE, WAVE_SQL, step=CLICKS // 12)})",
    "covariate_products": _grouped_fit([element_sql(None, f"{s}.{u}", f"segment = '{s}' AND status = '{u}'") for s in SEGMENTS for u in STATUS], G, "1.0", 1.0, 5) + " FROM labels JOIN sums USING (ord)",
    "fit_weighted_amounts": _grouped_fit(SEGMENT_SQL, G, "pension / 1000", 1.5, 6, f", {sql_sums(WHOLE, repr(float(np.log(0.07))), 'pension / 1000', tag='_z')}, z AS (SELECT V / E AS z FROM sums_z), pen AS (SELECT sum(V / E) / any_value(z) AS penalty, ({deaths_log(G, 'pension / 1000')} + sum(A * ln(A / E)) - sum(A)) / (1.5 * any_value(z)) AS l FROM sums, z)")
    + ', round(z, 6) AS "Z", round(penalty, 6) AS penalty, round(l, 3) AS likelihood FROM labels JOIN sums USING (ord), z, pen',
    "best_of_models": f"""WITH {LIVES}, {likelihoods([("level", WHOLE), ("size", _SIZE)], G)}, best AS (SELECT model FROM ranked ORDER BY L - penalty DESC LIMIT 1),
g AS (SELECT max(CASE WHEN ord = 1 THEN ln(A / E) END) AS b0, max(CASE WHEN ord = 2 THEN ln(A / E) END) AS b1, max(CASE WHEN ord = 1 THEN A END) AS a0, max(CASE WHEN ord = 2 THEN A END) AS a1 FROM sums_m1)
SELECT 'one' AS term, round(CASE WHEN model = 'size' THEN b0 ELSE (SELECT ln(A / E) FROM sums_m0) END, 6) AS estimate, round(1.0 / CASE WHEN model = 'size' THEN a0 ELSE (SELECT A FROM sums_m0) END, 8)::DOUBLE AS variance, model FROM g, best
UNION ALL SELECT 'big', round(b1 - b0, 6), round(1.0 / a0 + 1.0 / a1, 8)::DOUBLE, model FROM g, best WHERE model = 'size'""",
    "batch_with_defaults": f"""WITH {LIVES}, {sql_sums(WHOLE, G)} SELECT 'all' AS element, round((0.25 * A)::DOUBLE, 5) AS A, round(0.25 * E, 5) AS E, round(0.375 * V, 5) AS V FROM sums
UNION ALL SELECT 'half', round((0.5 * A)::DOUBLE, 5), round(0.5 * E, 5), round(0.75 * V, 5) FROM sums UNION ALL SELECT 'level', round(ln(A / E), 6), round(1.5 / (0.25 * A), 8)::DOUBLE, 0.0 FROM sums UNION ALL SELECT 'overlap', 1.0, 0.0, 0.0""",
    "vec_recycled": "WITH v AS (SELECT unnest(range(0, 7))::INT AS k, unnest([-2.5, -1.0, '-0.0'::DOUBLE, 0.0, 0.25, 1.0, 7.0]::DOUBLE[]) AS x) SELECT k, x, x + 2 AS add, 2 - x AS sub, x * 3 + 0.0 AS mul, round(2 ** x, 6) AS pow, least(x, 0.5) + 0.0 AS least, greatest(x, 0.5) AS most, least(greatest(x, -1), 1) + 0.0 AS clamp, -x + 0.0 AS neg, round(exp(x), 6) AS exp, round(-ln(1 - x / 10), 6) + 0.0 AS m FROM v",
    "chart_ramp": _ramp_sql(),
    "aev_default_mortality": sql_aev(SEGMENT_SQL, sql_gompertz(-3.8, 0.1, 75, -0.01, 2020)),
    "compare_models_rank": f"WITH {LIVES}, {likelihoods(_COMPARED, G)} SELECT row_number() OVER (ORDER BY L - penalty DESC)::INT AS rank, model, round(L - penalty, 4) AS \"L_P\", round(L, 4) AS \"L\", round(penalty, 4) AS penalty, 'converged' AS status FROM ranked",
    "fit_age_newton": f"WITH {LIVES}, {sql_sums(WHOLE, G)}, {newton_sql(_AGE, ['one', 'age', 'f'], G)} SELECT term, round(estimate, 6) AS estimate, round(stddev, 6) AS stddev, round(estimate - 1.959963984540054 * stddev, 5) AS low_95pc, round(estimate + 1.959963984540054 * stddev, 5) AS high_95pc, 'converged' AS status FROM est",
}

__all__ = ["ORACLE", "QUERIES"]
