import math

import numpy as np
import pytest
from helpers import FIVE, lives, records

import survista as S
from survista.functions.clicks import CLICKS, Instant, instant
from survista.operators.aev import check_relevance, measure
from survista.operators.grid import slots_of
from survista.plans.evaluate import evaluate, years
from survista.plans.expr import b, exp, i, ifelse, sin, t, x

MU = math.exp(-3.2)
THREE = {"birth": [1940, 1945, 1950], "E2R_start": [2010] * 3, "E2R_end": [2013, 2012, 2011], "E2R_died": [True, False, True], "amount": [1000.0, 2500.0, 400.0], "male": [True, False, True]}


@pytest.fixture(scope="module")
def three(spark):
    return lives(spark, THREE, 2010, 2014)


@pytest.fixture(scope="module")
def five(spark):
    return lives(spark, FIVE, 2015, 2020)


def brute(data, m, include=None, weight=None, relevance=None, step=CLICKS // 4):
    """A, E, V life by life, by the evaluator."""
    out = [0.0, 0.0, 0.0]
    for r in data.df.collect():
        facts = r.asDict() | {"birth": Instant(r["birth"])}
        span = S.period_included(include if include is not None else S.operators.include.Include(()), facts, Instant(r["E2R_start"]), Instant(r["E2R_end"]))
        if not span:
            continue
        at = lambda n, c: 1.0 if n is None else years(evaluate(S.plans.expr.node(n), facts, Instant(c)))  # noqa: B023, E731
        if r["E2R_died"] and span[1].clicks == r["E2R_end"]:
            out[0] += at(relevance, span[1].clicks) * at(weight, span[1].clicks)
        for c, width in slots_of(span[0].clicks, span[1].clicks, step):
            part = math.exp(S.log_mu(m, facts, Instant(c))) * at(relevance, c) * width / CLICKS
            out[1] += part * at(weight, c)
            out[2] += part * at(weight, c) ** 2
    return out


@pytest.mark.parametrize("scale", [1, 1 / 4, 1 / 12, 1 / 60])
def test_constant_hazard_is_exposure(three, scale):
    m = S.mortality_const(log_mu=-3.2)
    assert records(S.aev(three, m, overdispersion=2, time_scale=scale))[0] == pytest.approx((2, 6 * MU, 12 * MU), rel=1e-14)
    a, e, v = records(S.aev(three, m, weight=i.amount, overdispersion=1, time_scale=scale))[0]
    assert (a, e, v) == pytest.approx((1400, MU * (3 * 1000 + 2 * 2500 + 400), MU * (3e6 + 2 * 6.25e6 + 1.6e5)), rel=1e-13)


@pytest.mark.parametrize(
    "m, include, weight, relevance",
    [
        (S.gompertz_mortality(), None, None, None), (S.gompertz_mortality(), S.age(62, 71), i.pension, None), (S.mortality(-3 + sin(t) / 5), S.period(2016, 2019), None, 0.5),
        (S.mortality(ifelse(i.male, S.gompertz_mortality().as_node(), -4.0)), S.duration(b, 60, 70), i.pension * exp((2015.0 - t) / 10), ifelse(i.male, 0.25, 1.0)),
        (S.mortality_table(60, 2014, mu=np.fromfunction(lambda a, p: 0.01 * (a + 1) + 0.001 * p, (12, 5))), S.include(i.pension > 6000), i.pension, None),
    ],
)
def test_agrees_with_life_by_life(five, m, include, weight, relevance):
    got = records(S.aev(five, m, include=include, weight=weight, val_relevance=relevance, overdispersion=1))[0]
    assert got == pytest.approx(brute(five, m, include, weight, relevance), rel=1e-11)


def test_closed_form_is_the_sum_of_slots(five):
    affine = S.gompertz_mortality()
    other = S.mortality(affine.as_node() + 0.0 * t * t)
    for scale in (1, 1 / 12):
        assert records(S.aev(five, affine, overdispersion=1, time_scale=scale))[0] == pytest.approx(records(S.aev(five, other, overdispersion=1, time_scale=scale))[0], rel=1e-12)


def test_deaths_on_an_edge_count_once(spark):
    d = lives(spark, {"birth": [1950], "E2R_start": [2010], "E2R_end": [2015], "E2R_died": [True]}, 2000, 2020)
    got = records(S.aev(d, S.mortality_const(log_mu=0.0), breakdown=S.ages(55, 75, by=10), overdispersion=1))
    assert got == [(1.0, 5.0, 5.0), (0.0, 0.0, 0.0)]
    clip = records(S.aev(d, S.mortality_const(log_mu=0.0), include=S.period(2010, 2012), overdispersion=1))
    assert clip == [(0.0, 2.0, 2.0)]


def test_relevance_and_weights(five):
    m = S.gompertz_mortality()
    one, half, twice = (records(S.aev(five, m, overdispersion=1, **how))[0] for how in ({}, {"val_relevance": 0.5}, {"weight": 2.0}))
    assert half == pytest.approx([v / 2 for v in one]) and twice == pytest.approx([2 * one[0], 2 * one[1], 4 * one[2]])
    far = records(S.aev(five, m, overdispersion=1, val_distance=math.log(2)))[0]
    assert far == pytest.approx(half)
    for bad in ({"val_relevance": 0.5, "val_distance": 1.0}, {"val_relevance": 1.5}, {"val_distance": -1.0}, {"val_relevance": t}):
        with pytest.raises(ValueError):
            S.aev(five, m, overdispersion=1, **bad)
    check_relevance(five, measure(five, m, val_relevance=i.pension / 30000))


def test_flag_weights_have_equal_e_and_v(five):
    (_, e, v), = records(S.aev(five, S.gompertz_mortality(), weight=i.male, overdispersion=1))
    assert e == v


def test_overdispersion_is_asked_for(five):
    with pytest.raises(ValueError, match="overdispersion"):
        S.aev(five, S.gompertz_mortality())
    got = S.aev(five, S.gompertz_mortality(), settings=S.settings(overdispersion=2, time_scale=1))
    assert records(S.aev(five, S.gompertz_mortality(), settings=S.settings(overdispersion=9), overdispersion=2, time_scale=1)) == records(got)
    with pytest.raises(ValueError):
        S.settings(time_scale=0.3)


def test_no_hazard(five):
    r = S.aev(five, S.mortality_const(log_mu=-800.0), overdispersion=1)
    (a, e, v), = records(r)
    assert (a, e, v) == (2, 0, 0) and r.property("A_over_E").first()[1] == math.inf


def test_properties_and_labels(spark):
    a = S.create_aev(spark, [0.0, 10.0, 100.0, 12.0], [5.0, 10.0, 100.01, 8.0], [6.0, 11.0, 90.0, 9.0], names=["p", "q", "r", "s"])
    rows = [r["deviance_residual"] for r in a.to_df().collect()]
    r = 12 / 8
    assert rows[0] == pytest.approx(-5 * math.sqrt(2 / 6)) and rows[1] == 0
    assert rows[2] == pytest.approx((100 - 100.01) / math.sqrt(90), rel=1e-3)
    assert rows[3] == pytest.approx(8 * math.sqrt(2 * (r * math.log(r) - r + 1) / 9))
    both = a + a
    assert records(both)[3] == (24, 16, 18) and [x["name"] for x in both.df.orderBy("ord").collect()] == ["p", "q", "r", "s"]
    with pytest.raises(Exception, match="labels"):
        (a + a.with_names(["p", "q", "r", "z"])).df.collect()
    assert records(a[1:3]) == records(a)[1:3] and len(a) == 4
    assert {r["group"] for r in a.with_group_names("g").df.collect()} == {"g"}
    with pytest.raises(ValueError):
        S.create_aev(spark, [1.0], [-1.0], [1.0])


def test_plans_shuffle_sums_only(five):
    d = S.aev(five, S.mortality(-3 + sin(t)), breakdown=S.ages(60, 80, by=5), overdispersion=1).df
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1


def test_instants_as_arguments(five):
    assert S.period_included(S.period(2016, 2017), {"birth": instant(1950)})[0].years == 2016
    assert S.log_mu(S.default_mortality(), {"birth": instant(1945)}, 2020) == pytest.approx(-3.8)
    assert S.value(x, {"birth": instant(1945)}, 2020).years == 75
