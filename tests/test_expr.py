import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from survista.functions.clicks import CLICKS, Instant, Span, instant
from survista.plans import expr as E
from survista.plans.columns import BOOL, DOUBLE, INSTANT, SPAN, TEXT, Scope, typed
from survista.plans.evaluate import evaluate

i, t, b, x = E.i, E.t, E.b, E.x
KINDS = {"birth": INSTANT, "entry": INSTANT, "wait": SPAN, "u": DOUBLE, "v": DOUBLE, "male": BOOL, "name": TEXT}
ODD = [0.0, -0.0, 1.0, -1.0, 0.5, -2.5, 3.0, 1e9, -1e9, float("inf"), float("-inf"), float("nan")]


def test_folding_and_names():
    assert (E.node(2) + 3).value == 5.0
    assert E.deparse(i.pension * 2 + x) == "((i.pension * 2) + x)"
    assert E.fields(i.a + i.b * t) == {"a", "b"} and E.uses_t(x) and not E.uses_t(b)
    assert len(E.short(sum((i.a for _ in range(40)), E.node(0.0)))) == 60


@pytest.mark.parametrize("bad", ["__import__('os')", "i.a.b", "lambda: 1", "log(i.a, 2)", "i.count", "i.E2R_end", "i.e2r_x + 1", "foo", "i.a = 1", "clamp(i.a, 1)", "[1]", "i.a if i.a else 1", "1 < i.a < 2"])
def test_whitelist(bad):
    with pytest.raises(E.ExpressionError):
        E.parse(bad)


def test_missing_constants_and_conditions():
    for bad in (lambda: E.node(float("nan")), lambda: E.node(0.0) / 0.0, lambda: E.ifelse(t > 2000, 1, 0), lambda: bool(i.a), lambda: E.isin(i.a, ["x", 1])):
        with pytest.raises(E.ExpressionError):
            bad()
    assert (E.node(1.0) / 0.0).value == math.inf


@pytest.mark.parametrize("n, kind", [(t - b, SPAN), (b + i.wait, INSTANT), (-i.wait, SPAN), (E.minimum(b, i.entry), INSTANT), (x * 2, DOUBLE), (i.male + 1.0, DOUBLE), (E.clamp(i.wait, i.wait, i.wait), SPAN)])
def test_kinds(n, kind):
    assert typed(n, Scope(KINDS, F.lit(0).cast("long"))).kind == kind


@pytest.mark.parametrize("n", [b + b, -b, i.wait - b, b * b, i.name < "x", i.name == 1.0, i.male & 1.0, E.is_na(i.male), E.ifelse(i.male, "a", "b"), i.name + 1.0, i.gone])
def test_kinds_refused(n):
    with pytest.raises(E.ExpressionError):
        typed(n, Scope(KINDS, F.lit(0).cast("long")))


FORMS = [
    i.u + i.v, i.u - i.v, i.u * i.v, i.u / i.v, i.u**i.v, i.u // i.v, i.u % i.v, E.minimum(i.u, i.v), E.maximum(i.u, i.v), E.clamp(i.u, i.v, 1.0), -i.u, abs(i.u), E.sqrt(i.u), E.exp(i.u), E.expm1(i.u), E.log(i.u),
    E.log1p(i.u), E.log10(i.u), E.floor(i.u), E.ceiling(i.u), E.trunc(i.u), E.round_(i.u), E.sign(i.u), i.u == i.v, i.u != i.v, i.u < i.v, i.u <= i.v, i.u > i.v, i.u >= i.v, E.is_na(i.u), E.isin(i.u, [1, 0.5]),
    E.ifelse(i.u < i.v, i.u, i.v), x / 2, (i.u < 0) ^ (i.v < 0), ~(i.u < i.v) | (i.v == 1.0), b < 1951.0, 1950.5 <= b,
]


def test_columns_agree_with_the_evaluator(spark):
    births = [instant(1950).clicks, instant(1951.25).clicks]
    rows = [(n, births[n % 2], u, v) for n, (u, v) in enumerate((u, v) for u in ODD for v in ODD)]
    df = spark.createDataFrame(rows, "n int, birth bigint, u double, v double")
    when = instant(2000.75)
    scope = Scope({"birth": INSTANT, "u": DOUBLE, "v": DOUBLE}, F.lit(when.clicks).cast("long"))
    got = {r[0]: r[1:] for r in df.select("n", *[typed(f, scope).column.alias(f"f{k}") for k, f in enumerate(FORMS)]).collect()}
    for n, birth, u, v in rows:
        for k, f in enumerate(FORMS):
            want = evaluate(f, {"birth": Instant(birth), "u": u, "v": v}, when)
            want = want.clicks if isinstance(want, Instant | Span) else want
            have = got[n][k]
            if isinstance(want, float):
                same = (want != want and have != have) or want == have or (math.isfinite(want) and have == pytest.approx(want, rel=1e-12, abs=1e-300))
            else:
                same = want is have or want == have
            assert same, (E.deparse(f), u, v, want, have)


@settings(max_examples=50)
@given(st.floats(-10, 10), st.floats(-1, 1), st.floats(1960, 2040))
def test_affine_form(a, c, when):
    n = E.ifelse(i.male, a + c * (t - 2000.0), -(c * x) / 2.0 + a)
    p, q = E.affine_in_t(n)
    for male in (True, False):
        facts = {"male": male, "birth": instant(1950)}
        at = instant(when)
        assert evaluate(p, facts, at) + evaluate(q, facts, at) * at.years == pytest.approx(E.in_years(evaluate(n, facts, at)), abs=1e-9)
    assert E.affine_in_t(t * t) is None


def test_whole_years_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1940 * CLICKS, 1.0)], "birth bigint, u double")
    df.write.parquet(str(tmp_path / "d"))
    plan = spark.read.parquet(str(tmp_path / "d"))
    plan = plan.where(typed(b < 1950.0, Scope({"birth": INSTANT}, None)).column)
    assert "LessThan(birth," in plan._jdf.queryExecution().toString()
