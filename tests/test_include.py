import pytest

import survista as S
from survista.functions.clicks import instant
from survista.plans.expr import ExpressionError, b, i, t, x

LIFE = {"birth": instant(1950), "entry": instant(2005), "pension": 12000.0, "status": "F"}


def inside(inc, start=2000, end=2020):
    got = S.period_included(inc, LIFE, start, end)
    return got and (got[0].years, got[1].years)


def test_terms():
    assert inside(S.age(60, 65)) == (2010, 2015)
    assert inside(S.period(None, 2004)) == (2000, 2004)
    assert inside(S.duration(i.entry, 1, 3)) == (2006, 2008)
    assert inside(S.age(60, 65) & S.period(2012, None)) == (2012, 2015)
    assert inside(S.age(80, 90)) is None
    assert inside(S.include(i.status == "P")) is None and inside(S.include("i.status == 'F'")) == (2000, 2020)


def test_labels():
    got = S.ages(60, 75, by=5)
    assert got.names == ["60-65", "65-70", "70-75"] and set(got.group_names) == {"age"}
    assert S.bands(i.pension, thresholds=[100, 200]).names == ["< 100", "100-200", ">= 200"]
    assert S.includes(a=S.age(60, 65)).names == ["a"] and S.includes(g=got).group_names == ["g"] * 3
    assert S.durations(i.entry, thresholds=[1]).group_names[0] == "duration since entry"
    assert (S.age(1, 2) & S.age(1, 2)).name is None
    assert got.with_names(["a", "b", "c"]).names == ["a", "b", "c"]
    with pytest.raises(ValueError):
        got.with_names(["a"])
    with pytest.raises(ValueError):
        got[0].named(" a")


@pytest.mark.parametrize("bad", [lambda: S.ages(60, 75, by=4), lambda: S.ages(60, None, by=5), lambda: S.ages(60, 75, by=5, thresholds=[65]), lambda: S.age(), lambda: S.age(70, 60)])
def test_edges(bad):
    with pytest.raises(ValueError):
        bad()


def test_what_can_be_banded():
    assert S.is_indicator(S.band(i.pension, 1, 2)) and not S.is_indicator(S.band(t, 2000, 2001))
    with pytest.raises(ExpressionError):
        S.band(t * 2.0, 1, 2)
    with pytest.raises(ExpressionError):
        S.indicator(x > 60)
    with pytest.raises(ExpressionError):
        S.static_variable(x)
    assert S.value(x / 2, LIFE, 2000) == 25 and S.logical_value(i.status == "F", LIFE)
    assert S.is_static_variable(S.variable(b)) and S.is_indicator(S.variable(i.pension > 1))


def test_categories():
    got = S.categories(i.status, ["F", "P"], "O")
    assert got.names == ["F+P", "O"]
    with pytest.raises(ValueError, match="known"):
        S.categories(i.status, "X", source=["F", "O"])
    with pytest.raises(ValueError, match="no category"):
        S.categories(i.status, "F", source=["F", "O"], exhaustive=True)
    with pytest.raises(ValueError, match="two"):
        S.categories(i.status, "F", ["F", "O"])
    assert S.categories(i.status, source=["F", "O"]).names == ["F", "O"]


def test_indicators_stay_indicators():
    assert S.is_indicator(S.include(i.a > 1) & S.include(i.b > 1)) and not S.is_indicator(S.include(i.a > 1) & S.age(1, 2))
