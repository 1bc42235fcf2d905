"""Mortalities: constants, tables, Gompertz, and expressions of them. All give the log of the hazard."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.functions.clicks import CLICKS, PER_CLICK, Instant, Span, instant, span
from survista.operators.settings import valid_name
from survista.plans import expr as E
from survista.plans.columns import Scope, number
from survista.plans.evaluate import evaluate, years


class Mortality:
    """Something with a log_mu, usable as a leaf of expressions."""

    name: str | None = None
    uses_t = True
    fields: frozenset | set = frozenset({"birth"})

    def as_node(self) -> E.Node:
        return E.Node("mortality", value=self)

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def log_mu(self, facts: dict, when: Instant) -> float:
        raise NotImplementedError

    def affine(self):
        return None

    def __and__(self, other):
        raise TypeError("mortalities are combined in mortality(...)")


@dataclass(frozen=True, eq=False)
class Expression(Mortality):
    """A mortality given by an expression."""

    node: E.Node
    name: str | None = None
    end_age: Span | None = None

    @property
    def uses_t(self):
        return E.uses_t(self.node)

    @property
    def fields(self):
        return E.fields(self.node)

    def column(self, scope: Scope) -> Column:
        return number(self.node, scope)

    def log_mu(self, facts: dict, when: Instant) -> float:
        return years(evaluate(self.node, facts, when))

    def affine(self):
        return E.affine_in_t(self.node)


def mortality(of, name: str | None = None) -> Mortality:
    """A mortality as it is, or an expression (or text) of mortalities, facts and time."""
    if isinstance(of, Mortality):
        return of
    n = E.parse(of) if isinstance(of, str) else E.node(of)
    for leaf in E.leaves(n):
        if not isinstance(leaf, Mortality):
            raise E.ExpressionError("only mortalities can stand in a mortality")
    return Expression(n, None if name is None else valid_name(name))


def mortality_const(q: float | None = None, mu: float | None = None, log_mu: float | None = None, name: str | None = None) -> Mortality:
    """A constant hazard, from a yearly probability, a hazard or its log: exactly one."""
    if sum(v is not None for v in (q, mu, log_mu)) != 1:
        raise ValueError("exactly one of q, mu and log_mu must be given")
    with np.errstate(all="ignore"):
        v = float(np.log(-np.log1p(-q))) if q is not None else float(np.log(mu)) if mu is not None else float(log_mu)
    if not np.isfinite(v):
        raise ValueError("the log of mu must be finite")
    return Expression(E.node(v), None if name is None else valid_name(name))


def gompertz_mortality(log_mu_0: float = -3.8, slope_x: float = 0.1, x_0: float = 75, slope_t: float = -0.01, t_0: float = 2020, name: str | None = None) -> Mortality:
    """log mu = log_mu_0 at age x_0 and time t_0, rising by slope_x a year of age and by slope_t a calendar year."""
    for v in (log_mu_0, slope_x, slope_t):
        if not E.finite(v):
            raise ValueError("the parameters must be finite")
    t0 = instant(t_0)
    b0 = t0 - span(x_0)
    along = slope_x + slope_t
    n = log_mu_0 - slope_x * (E.b - E.node(b0)) + along * (E.t - E.node(t0))
    return Expression(n, None if name is None else valid_name(name))


def default_mortality() -> Mortality:
    return gompertz_mortality(name="default")


@dataclass(frozen=True, eq=False)
class Table(Mortality):
    """log mu by age (rows, from x0) and period (columns, from t0), blended between them along cohorts."""

    grid: np.ndarray = field(repr=False)  # [period, age]
    x0: Span
    t0: Instant
    end_age: Span
    name: str | None = None

    def _split(self, v: int) -> tuple[int, float]:
        whole, rest = divmod(v, CLICKS)
        return whole, rest * PER_CLICK

    def log_mu(self, facts: dict, when: Instant) -> float:
        periods, ages = self.grid.shape
        c, wc = self._split(facts["birth"].clicks - (self.t0.clicks - self.x0.clicks))
        p, wp = self._split(when.clicks - self.t0.clicks)
        at = lambda p, a: float(self.grid[min(max(p, 0), periods - 1), min(max(a, 0), ages - 1)])
        blend = lambda p: at(p, p - c) + wc * (at(p, p - c - 1) - at(p, p - c))
        return blend(p) + wp * (blend(p + 1) - blend(p))

    def column(self, scope: Scope) -> Column:
        periods, ages = self.grid.shape
        # one constant, folded to an array before it runs, whatever the table's size; repr() gives a double back exactly
        table = F.split(F.lit(",".join(map(repr, self.grid.ravel().tolist()))), ",").cast("array<double>")
        birth, t = scope.field("birth").column, scope.t
        off = birth - F.lit(self.t0.clicks - self.x0.clicks)
        c, wc = F.floor(off / F.lit(float(CLICKS))).cast("int"), F.pmod(off, F.lit(CLICKS)).cast("double") * PER_CLICK
        since = t - F.lit(self.t0.clicks)
        p, wp = F.floor(since / F.lit(float(CLICKS))).cast("int"), F.pmod(since, F.lit(CLICKS)).cast("double") * PER_CLICK
        held = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
        at = lambda p, a: F.get(table, held(p, periods) * ages + held(a, ages))

        def blend(p):
            near = at(p, p - c)
            return near + wc * (at(p, p - c - 1) - near)

        low = blend(p)
        return low + wp * (blend(p + 1) - low)


def _adjust(m: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hazard at mid-year from the year's mean, for its curvature, half of the mean at least."""
    return np.maximum(m - (high - 2 * m + low) / 24, m / 2)


def log_mu_from_q(q: np.ndarray) -> np.ndarray:
    """log mu by [age, period] from yearly probabilities: inner cells along cohorts, those of the first and
    last period along age, and cells of the first and last age as they are."""
    q = np.asarray(q, float)
    with np.errstate(all="ignore"):
        m = -np.log1p(-q)
    ages, periods = m.shape
    mu = m.copy()
    if ages > 2:
        if periods > 2:
            mu[1:-1, 1:-1] = _adjust(m[1:-1, 1:-1], m[:-2, :-2], m[2:, 2:])
        for p in {0, periods - 1}:
            mu[1:-1, p] = _adjust(m[1:-1, p], m[:-2, p], m[2:, p])
    with np.errstate(all="ignore"):
        return np.log(mu)


def mortality_table(x0, t0, q=None, mu=None, log_mu=None, name: str | None = None) -> Table:
    """A table of q, mu or log mu (exactly one), rows by age from x0, columns by period from t0."""
    if sum(v is not None for v in (q, mu, log_mu)) != 1:
        raise ValueError("exactly one of q, mu and log_mu must be given")
    given = np.asarray(q if q is not None else mu if mu is not None else log_mu, float)
    if given.ndim != 2 or not given.size:
        raise ValueError("a table needs two dimensions")
    with np.errstate(all="ignore"):
        grid = log_mu_from_q(given) if q is not None else np.log(given) if mu is not None else given
    if not np.isfinite(grid).all():
        raise ValueError("the log of mu must be finite throughout")
    end = Span(span(x0).clicks + grid.shape[0] * CLICKS + (CLICKS // 2 if q is not None else 0))
    instant((instant(t0).clicks + grid.shape[1] * CLICKS) * PER_CLICK)
    return Table(np.ascontiguousarray(grid.T), span(x0), instant(t0), end, None if name is None else valid_name(name))


def log_mu(m, facts: dict, when) -> float:
    """log mu of a life (facts, with an instant `birth`) at a time."""
    return mortality(m).log_mu(facts, instant(when))


def end_age(m: Mortality) -> Span | None:
    return getattr(m, "end_age", None)


def is_mortality(x) -> bool:
    return isinstance(x, Mortality)


NAN = ieee.NAN
