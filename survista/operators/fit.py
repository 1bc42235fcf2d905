"""Proportional-hazards models by Newton-Raphson on the weighted log-likelihood.

All that a walk over the data needs is a table with one row per distinct covariate vector: the
exposures sum s w mu_ref and s w^2 mu_ref, the deaths sum s w, and the deaths' sum s w log mu_ref. Where
covariates are static it is one aggregation of the lives, and every walk after it works on the table alone. A table
of at most DRIVER rows is walked on the driver; a larger one, or that of slots where a covariate varies with time, stays
distributed, cached with spilling to disk, and each walk is one aggregation to a single row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from survista.functions import ieee
from survista.functions.clicks import PER_CLICK
from survista.functions.linalg import Dependent, cholesky, solve
from survista.operators.aev import Measure, accumulate, clipped, elements_of, measure, times
from survista.operators.covariates import Model
from survista.operators.grid import affine_integral, explode_slots
from survista.operators.mortality import Expression, mortality, mortality_const
from survista.operators.settings import Settings, resolve
from survista.plans import expr as E
from survista.plans.columns import number
from survista.sources.data import ExpData

TOLERANCE = 1e-6
ITERATIONS = 25
HALVINGS = 30
ARMIJO = 1e-4
#: Differences of likelihoods below this share of their terms are rounding.
ROUNDING = 1e-9
#: Rows of a table that the driver walks, and cells of one of slots, 8 bytes each: 128 MB.
DRIVER = 200_000
CELLS = 1 << 24


class NotDisjoint(ValueError):
    """Covariates given as disjoint that are not."""


@dataclass
class Totals:
    a: float
    e: float
    sa: np.ndarray
    se: np.ndarray
    information: np.ndarray
    squared: np.ndarray

    @property
    def finite(self) -> bool:
        return all(np.isfinite(v).all() for v in (self.a, self.e, self.sa, self.se, self.information, self.squared))


@dataclass
class Table:
    """Rows X1..Xk, m1, m2, d, dl: on the driver as an array, or distributed."""

    k: int
    rows: np.ndarray | None = None
    df: DataFrame | None = None
    cached: DataFrame | None = None

    def part(self, at: list[int]) -> Table:
        """The table of some of its covariates; its rows need not be distinct then."""
        if self.rows is not None:
            return Table(len(at), rows=self.rows[:, [*at, *range(self.k, self.k + 4)]])
        return Table(len(at), df=self.df.select(*[F.col(f"x{j}").alias(f"x{n}") for n, j in enumerate(at)], "m1", "m2", "d", "dl"))

    def release(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()

    def walk(self, beta: np.ndarray) -> Totals:
        k = self.k
        if self.rows is not None:
            x, (m1, m2, d, dl) = self.rows[:, :k], self.rows[:, k:].T
            with np.errstate(all="ignore"):
                eta = x @ beta
                lift = np.exp(eta)
                e1, e2 = m1 * lift, m2 * lift
                dead = d != 0
                a = float(dl[dead].sum() + (d[dead] * eta[dead]).sum())
                return Totals(a, float(e1.sum()), d[dead] @ x[dead] if dead.any() else np.zeros(k), e1 @ x, (x * e1[:, None]).T @ x, (x * e2[:, None]).T @ x)
        xs = [F.col(f"x{j}") for j in range(k)]
        eta = sum((ieee.lit(bj) * xj for bj, xj in zip(beta.tolist(), xs, strict=True)), ieee.lit(0.0))
        df = self.df.withColumn("eta", eta).withColumn("e1", F.col("m1") * F.exp("eta")).withColumn("e2", F.col("m2") * F.exp("eta"))
        e1, e2, d = F.col("e1"), F.col("e2"), F.col("d")
        sums = [F.sum(F.when(d != 0, F.col("dl") + d * F.col("eta"))), F.sum(e1)]
        sums += [F.sum(F.when(d != 0, d * x)) for x in xs] + [F.sum(e1 * x) for x in xs]
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        sums += [F.sum(e1 * xs[i] * xs[j]) for i, j in upper] + [F.sum(e2 * xs[i] * xs[j]) for i, j in upper]
        r = [0.0 if v is None else v for v in df.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first()]
        sa, se, flat = np.array(r[2 : 2 + k]), np.array(r[2 + k : 2 + 2 * k]), r[2 + 2 * k :]
        both = []
        for part in (flat[: len(upper)], flat[len(upper) :]):
            m = np.zeros((k, k))
            for (i, j), v in zip(upper, part, strict=True):
                m[i, j] = m[j, i] = v
            both.append(m)
        return Totals(r[0], r[1], sa, se, *both)


@dataclass
class Fit:
    model: Model
    status: str
    names: list[str]
    coefficients: np.ndarray
    variance: np.ndarray | None
    log_likelihood: float
    penalty: float
    iterations: int
    Z: float
    overdispersion: float
    deaths: float
    exposure: float
    settings: dict = field(default_factory=dict)
    message: str = ""

    @property
    def converged(self) -> bool:
        return self.status == "converged"

    @property
    def penalised(self) -> float:
        return self.log_likelihood - self.penalty

    @property
    def name(self) -> str | None:
        return self.model.name

    @property
    def mortality(self):
        """The reference with the fitted terms added."""
        n = self.model.reference.as_node()
        for (_, term), beta in zip(self.model.covariates.terms, self.coefficients, strict=True):
            n = n + E.node(float(beta)) * _numeric(term)
        return Expression(n, self.model.name)

    def coef(self) -> dict[str, float]:
        return dict(zip(self.names, self.coefficients.tolist(), strict=True))

    def vcov(self) -> np.ndarray | None:
        return self.variance

    def residuals(self):
        raise NotImplementedError("a fit has no residuals of its own; see diagnose()")

    def summary(self) -> list[dict]:
        se = np.sqrt(np.diag(self.variance)) if self.variance is not None else np.full(len(self.names), np.nan)
        q = 1.959963984540054
        return [{"term": n, "estimate": float(c), "stddev": float(s), "low_95pc": float(c - q * s), "high_95pc": float(c + q * s)} for n, c, s in zip(self.names, self.coefficients, se, strict=True)]

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.summary()], "term string, estimate double, stddev double, low_95pc double, high_95pc double")


def _numeric(n: E.Node) -> E.Node:
    return n * 1.0 if E.is_logical(n) else n


def is_fit(x) -> bool:
    return isinstance(x, Fit)


def coef(f: Fit): return f.coef()  # noqa: E704
def vcov(f: Fit): return f.vcov()  # noqa: E704


def table_of(rows: DataFrame, data: ExpData, m: Measure, terms: list[E.Node], step: int) -> Table:
    """The walk's table for clipped rows."""
    k, scope = len(terms), data.scope()
    varying = any(map(E.uses_t, terms))
    end = scope.at(F.col("tau"))
    pair = E.affine_in_t(m.mortality.as_node()) if m.static and not varying else None
    weight = lambda sc: (m.s(sc), m.w(sc))
    s, w = weight(end)
    deaths = times(s, w)
    death_log = deaths * m.log_mu(end)
    if pair is not None:
        a, c = (number(n, scope) for n in pair)
        mu = affine_integral(a, c, F.col("nu"), F.col("tau"), step)
        s1, w1 = weight(scope)
        cols = {f"x{j}": number(n, scope) for j, n in enumerate(terms)}
        cols |= {"_mu": mu}
        df = rows.withColumns(cols)
        df = df.withColumns({"m1": times(F.col("_mu"), s1, w1), "m2": times(F.col("_mu"), s1, None if w1 is None else w1 * w1), "d": F.when(F.col("died"), deaths).otherwise(0.0), "dl": F.when(F.col("died"), death_log).otherwise(0.0)})
    else:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        slots = explode_slots(rows, step)
        now = scope.at(F.col("t"))
        s1, w1 = weight(now)
        mu = F.exp(m.log_mu(now)) * (F.col("width").cast("double") * PER_CLICK)
        live = slots.withColumns({"_mu": mu, **{f"x{j}": number(n, now) for j, n in enumerate(terms)}})
        live = live.select(*[f"x{j}" for j in range(k)], times(F.col("_mu"), s1, w1).alias("m1"), times(F.col("_mu"), s1, None if w1 is None else w1 * w1).alias("m2"), ieee.lit(0.0).alias("d"), ieee.lit(0.0).alias("dl"))
        dead = rows.where("died").select(*[number(n, end).alias(f"x{j}") for j, n in enumerate(terms)], ieee.lit(0.0).alias("m1"), ieee.lit(0.0).alias("m2"), deaths.alias("d"), death_log.alias("dl"))
        df = live.unionByName(dead)
        if varying:
            n = rows.agg(F.sum(F.floor((F.col("tau") - F.col("nu") - 1) / F.lit(step)) + 1 + F.col("died").cast("int"))).first()[0]
            return _small(df, k, rows) if (n or 0) * (k + 4) <= CELLS else Table(k, df=df, cached=rows)
    xs = [f"x{j}" for j in range(k)]
    df = df.groupBy(*xs).agg(*[F.sum(c).alias(c) for c in ("m1", "m2", "d", "dl")]).persist(StorageLevel.MEMORY_AND_DISK)
    return _small(df, k, df) if df.count() <= DRIVER else Table(k, df=df, cached=df)


def _small(df: DataFrame, k: int, cached: DataFrame) -> Table:
    """The table on the driver: DRIVER rows, or CELLS cells, at most. Missing values are NaN."""
    got = df.toArrow()
    cached.unpersist()
    return Table(k, rows=np.column_stack([c.to_numpy() for c in got.columns]) if got.num_rows else np.zeros((0, k + 4)))


def verify_disjoint(table: Table) -> None:
    """No row with exposure may have two covariates other than zero."""
    k = table.k
    if table.rows is not None:
        x = table.rows[:, :k]
        bad = np.isnan(x).any() or ((x != 0).sum(axis=1) > 1).any()
    else:
        count = sum((F.when((F.col(f"x{j}") != 0) | F.isnan(f"x{j}"), 1).otherwise(0) for j in range(k)), F.lit(0))
        odd = count > 1
        for j in range(k):
            odd = odd | F.isnan(f"x{j}")
        bad = not table.df.where(odd).isEmpty()
    if bad:
        raise NotDisjoint("the covariates given as disjoint overlap")


MESSAGES = {
    "not_finite": "the likelihood or its derivatives are not finite",
    "not_identifiable": "a covariate is a combination of those before it",
    "step_collapsed": "no step along the Newton direction raises the likelihood",
    "did_not_converge": "the iterations ran out",
}


def newton(walk, k: int, omega: float, z: float, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> dict:
    """Maximise (a - e) / (omega z) from 0. walk: coefficients to Totals. Iterations count from 1, the walk at 0."""
    beta = np.zeros(k)
    now = walk(beta)
    scale = omega * z
    out = {"status": "did_not_converge", "iterations": iterations, "detail": None}
    for n in range(iterations):
        if not now.finite:
            return out | {"status": "not_finite", "beta": beta, "totals": now, "iterations": n + 1}
        gradient = now.sa - now.se
        low = cholesky(now.information)
        if isinstance(low, Dependent):
            return out | {"status": "not_identifiable", "beta": beta, "totals": now, "iterations": n + 1, "detail": low}
        step = solve(low, gradient)
        decrement = float(gradient @ step)
        if decrement / (2 * scale) <= tolerance:
            inverse = solve_matrix(low)
            spread = inverse @ now.squared
            return out | {"status": "converged", "beta": beta, "totals": now, "iterations": n + 1, "variance": omega * spread @ inverse, "penalty": float(np.trace(spread)) / z}
        length, accepted = 1.0, None
        for _ in range(HALVINGS + 1):
            trial = walk(beta + length * step)
            if trial.finite and _raises(now, trial, step, length, decrement):
                accepted = trial
                break
            length /= 2
        if accepted is None:
            return out | {"status": "step_collapsed", "beta": beta, "totals": now, "iterations": n + 1}
        beta, now = beta + length * step, accepted
    return out | {"beta": beta, "totals": now}


def _raises(now: Totals, trial: Totals, step: np.ndarray, length: float, decrement: float) -> bool:
    """Whether the likelihood gains by Armijo's rule. Near the maximum the gain drowns in the rounding of two large sums; there the slope
    at the trial tells, as by Hager and Zhang: the mean of the slopes at both ends is the gain over the length."""
    gain = (trial.a - trial.e) - (now.a - now.e)
    if abs(gain) > ROUNDING * (abs(now.a) + now.e):
        return gain >= ARMIJO * length * decrement
    return float((trial.sa - trial.se) @ step) >= (2 * ARMIJO - 1) * decrement


def solve_matrix(low: np.ndarray) -> np.ndarray:
    return np.column_stack([solve(low, e) for e in np.eye(len(low))])


def scale_of(data: ExpData, m: Measure, include, step: int, test_mortality, z) -> tuple[float, float, float]:
    """Z, deaths and years of exposure of the population. Z is V / E of the test mortality."""
    if (test_mortality is None) == (z is None):
        raise ValueError("either test_mortality or Z must be given")
    elements = elements_of(include, None)
    rows = clipped(data, elements, m.fields)
    unit = accumulate(rows, data.scope(), Measure(mortality_const(log_mu=0.0)), step).first()
    if unit is None:
        raise ValueError("nothing is included")
    if z is not None:
        if not (math.isfinite(z) and z > 0):
            raise ValueError("Z must be finite and above 0")
        return float(z), unit["A"], unit["E"]
    if m.zero_or_one(data.kinds):
        return 1.0, unit["A"], unit["E"]
    test = Measure(mortality(test_mortality), m.weight, m.relevance, m.distance)
    r = accumulate(clipped(data, elements, test.fields), data.scope(), test, step).first()
    if not (r["E"] > 0 and math.isfinite(r["V"] / r["E"])):
        raise ValueError("the test mortality expects no deaths")
    return r["V"] / r["E"], unit["A"], unit["E"]


def fit(data: ExpData, model: Model, include=None, weight=None, val_relevance=None, val_distance=None, test_mortality=None, Z=None, settings: Settings | None = None, overdispersion=None, time_scale=None, tolerance: float = TOLERANCE, iterations: int = ITERATIONS, _scale=None, _table: Table | None = None) -> Fit:
    omega, step = resolve(settings, overdispersion, time_scale)
    m = measure(data, model.reference, weight, val_relevance, val_distance)
    z, deaths, exposure = _scale or scale_of(data, m, include, step, test_mortality, Z)
    terms = [n for _, n in model.covariates.terms]
    table = _table
    if table is None:
        rows = clipped(data, elements_of(include, None), m.fields.union(*map(E.fields, terms)))
        table = table_of(rows, data, m, terms, step)
    try:
        if model.covariates.disjoint:
            verify_disjoint(table)
        got = newton(table.walk, len(terms), omega, z, tolerance, iterations)
    finally:
        table.release()
    message = MESSAGES.get(got["status"], "")
    if got["detail"] is not None:
        message += f": {model.covariates.names[got['detail'].at]}"
    t = got["totals"]
    how = {"include": include, "weight": weight, "val_relevance": val_relevance, "val_distance": val_distance, "overdispersion": omega, "time_scale": step * PER_CLICK}
    return Fit(model, got["status"], model.covariates.names, got["beta"], got.get("variance"), (t.a - t.e) / (omega * z), got.get("penalty", float("nan")), got["iterations"], z, omega, deaths, exposure, how, message)
