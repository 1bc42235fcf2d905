import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from survista.functions.clicks import CLICKS, Instant, date_of, halve_int, instant, mid_day, span
from survista.functions.special import chi_squared_quantile
from survista.operators.grid import integrate, slots_of


def test_years_and_days_are_whole():
    assert CLICKS == 365 * 1464 == 366 * 1460
    assert instant(2015).clicks == 2015 * CLICKS
    assert instant(dt.date(2017, 7, 2)).clicks + 732 == instant(2017.5).clicks


@given(st.dates(dt.date(1001, 1, 1), dt.date(2999, 12, 31)))
def test_dates_come_back(d):
    c = instant(d)
    assert date_of(c) == d and mid_day(c.clicks) > c.clicks and date_of(Instant(mid_day(c.clicks))) == d


def test_bounds():
    for bad in (999, 3001, float("nan"), True):
        with pytest.raises(ValueError):
            instant(bad)
    with pytest.raises(ValueError):
        span(2001)


def test_halves_go_to_even():
    assert [halve_int(v) for v in (4, 5, 6, 7, 9, 11)] == [2, 2, 3, 4, 4, 6]


@given(st.integers(1990 * CLICKS, 2010 * CLICKS), st.integers(1, 12 * CLICKS), st.sampled_from([1, 4, 12, 60]))
def test_slots_cover_the_span(nu, length, per_year):
    step = CLICKS // per_year
    slots = slots_of(nu, nu + length, step)
    assert sum(w for _, w in slots) == length
    assert all(w == step for _, w in slots[:-1]) and 0 < slots[-1][1] <= step
    assert all(nu < t < nu + length or length < 3 for t, _ in slots)


def test_midpoints_are_exact_on_lines():
    lo, hi = 2000 * CLICKS, 2003 * CLICKS
    got = integrate(lambda t: t / CLICKS, lo, hi, CLICKS // 4)
    assert got == pytest.approx((2003**2 - 2000**2) / 2, rel=1e-14)


def test_chi_squared():
    assert chi_squared_quantile(0.975, 9) == pytest.approx(19.0227677986, rel=1e-9)
    assert chi_squared_quantile(0.025, 1) == pytest.approx(0.000982069117, rel=1e-7)
