"""Ranking of candidate models by penalised log-likelihood, diagnosis of fits, and overdispersion."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survista.functions.special import chi_squared_quantile
from survista.operators.aev import Aev, aev, clipped, elements_of, measure, run_together, spec
from survista.operators.covariates import Model
from survista.operators.fit import ITERATIONS, TOLERANCE, Fit, Table, fit, scale_of, table_of
from survista.operators.include import Includes
from survista.operators.settings import Settings, resolve
from survista.plans import expr as E
from survista.sources.data import ExpData


@dataclass(frozen=True)
class ModelComparison:
    """Fits by penalised log-likelihood, best first; those that failed come last."""

    fits: tuple[Fit, ...]

    def summary(self) -> list[dict]:
        return [
            {"rank": k + 1 if f.converged else None, "model": f.name, "L_P": f.penalised if f.converged else None, "L": f.log_likelihood if f.converged else None,
             "penalty": f.penalty if f.converged else None, "status": f.status}
            for k, f in enumerate(self.fits)
        ]

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.summary()], "rank int, model string, L_P double, L double, penalty double, status string")


def is_model_comparison(x) -> bool:
    return isinstance(x, ModelComparison)


def compare_models(data: ExpData, models: list[Model], include=None, weight=None, val_relevance=None, val_distance=None, test_mortality=None, Z=None, settings: Settings | None = None, overdispersion=None, time_scale=None, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> ModelComparison:
    """Fit all models with one Z, which makes their likelihoods comparable. Models of one reference whose covariates are all static
    share one aggregation of the lives, by the covariates of all."""
    if not models:
        raise ValueError("there is no model to compare")
    names = [m.name for m in models if m.name is not None]
    if len(set(names)) != len(names):
        raise ValueError("two models have one name")
    omega, step = resolve(settings, overdispersion, time_scale)
    scale = scale_of(data, measure(data, models[0].reference, weight, val_relevance, val_distance), include, step, test_mortality, Z)
    tables, shared = _shared_tables(data, models, include, weight, val_relevance, val_distance, step)
    fits = [fit(data, m, include, weight, val_relevance, val_distance, settings=settings, overdispersion=omega, time_scale=time_scale, tolerance=tolerance, iterations=iterations, Z=scale[0], _scale=scale, _table=t) for m, t in zip(models, tables, strict=True)]
    for t in shared:
        t.release()
    failed = [f for f in fits if not f.converged]
    if failed:
        warnings.warn(f"{len(failed)} of {len(fits)} models failed: " + "; ".join(f"{f.name}: {f.message}" for f in failed), stacklevel=2)
    return ModelComparison(tuple(sorted(fits, key=lambda f: (not f.converged, -f.penalised if f.converged else 0.0))))


def _shared_tables(data: ExpData, models: list[Model], include, weight, val_relevance, val_distance, step: int) -> tuple[list[Table | None], list[Table]]:
    """Tables by model, None for those that share none; and the whole ones that they are parts of."""
    out, shared = [None] * len(models), []
    groups: dict[int, list[int]] = {}
    for k, m in enumerate(models):
        if not any(E.uses_t(n) for _, n in m.covariates.terms):
            groups.setdefault(id(m.reference), []).append(k)
    for mine in groups.values():
        if len(mine) < 2:
            continue
        terms, where = [], []
        for k in mine:
            where.append([*range(len(terms), len(terms) + len(models[k].covariates))])
            terms += [n for _, n in models[k].covariates.terms]
        what = measure(data, models[mine[0]].reference, weight, val_relevance, val_distance)
        whole = table_of(clipped(data, elements_of(include, None), what.fields.union(*map(E.fields, terms))), data, what, terms, step)
        shared.append(whole)
        for k, at in zip(mine, where, strict=True):
            out[k] = whole.part(at)
    return out, shared


def best_fit(c: ModelComparison) -> Fit:
    if not c.fits or not c.fits[0].converged:
        raise ValueError("no model converged")
    return c.fits[0]


@dataclass(frozen=True)
class Diagnosis:
    """A / E of fits over breakdowns: a frame of model, breakdown, ord, group, name, A, E, V."""

    df: DataFrame

    def of(self, model: str | None, breakdown: str) -> Aev:
        return Aev(self.df.where(F.col("model").eqNullSafe(F.lit(model)) & (F.col("breakdown") == breakdown)).drop("model", "breakdown"))


def is_diagnosis(x) -> bool:
    return isinstance(x, Diagnosis)


def diagnose_settings(f: Fit) -> dict:
    """What a diagnosis takes from a fit unless told otherwise."""
    return dict(f.settings)


def diagnose(data: ExpData, fits, breakdown: dict[str, Includes] | Includes, **changes) -> Diagnosis:
    """A / E on the mortality of every fit that converged, over every breakdown, from one pass over the lives."""
    fits = [f for f in (fits.fits if isinstance(fits, ModelComparison) else [fits] if isinstance(fits, Fit) else fits) if f.converged]
    if not fits:
        raise ValueError("no fit converged")
    many = breakdown if isinstance(breakdown, dict) else {"breakdown": breakdown}
    pairs = [(f, name, b) for f in fits for name, b in many.items()]
    specs = [spec(data, f.mortality, breakdown=b, **(diagnose_settings(f) | changes)) for f, _, b in pairs]
    label = lambda of: F.get(F.array(*[F.lit(v).cast("string") for v in of]), F.col("no"))
    got = run_together(data, specs).select(label([f.name for f, _, _ in pairs]).alias("model"), label([n for _, n, _ in pairs]).alias("breakdown"), "ord", "group", "name", "A", "E", "V")
    return Diagnosis(got)


@dataclass(frozen=True)
class Overdispersion:
    estimate: float
    stddev: float
    low_95pc: float
    high_95pc: float
    df: int
    cells: int
    empty: int


#: Cells with E squared over V under this say little.
THIN = 5.0


def overdispersion_of(cells: list[tuple[float, float, float]], parameter_count: int = 0) -> Overdispersion:
    full = [(a, e, v) for a, e, v in cells if not (a == 0 and v == 0)]
    df = len(full) - parameter_count
    if df <= 0:
        raise ValueError("there are not more cells than parameters")
    thin = sum(e * e / v < THIN if v else True for _, e, v in full)
    if thin:
        warnings.warn(f"{thin} of {len(full)} cells expect too few deaths", stacklevel=3)
    omega = sum((a - e) ** 2 / v for a, e, v in full) / df
    return Overdispersion(omega, omega * math.sqrt(2 / df), omega * df / chi_squared_quantile(0.975, df), omega * df / chi_squared_quantile(0.025, df), df, len(full), len(cells) - len(full))


def measure_overdispersion(data: ExpData, mortality, breakdown: Includes, include=None, weight=None, val_relevance=None, val_distance=None, parameter_count: int = 0, settings: Settings | None = None, time_scale=None) -> Overdispersion:
    """Pearson's chi-squared over degrees of freedom, on the cells of a breakdown at overdispersion 1."""
    if isinstance(parameter_count, bool) or parameter_count < 0 or parameter_count != int(parameter_count):
        raise ValueError("parameter_count must be a whole number from 0")
    cells = aev(data, mortality, include, weight, val_relevance, val_distance, breakdown, settings, overdispersion=1.0, time_scale=time_scale)
    return overdispersion_of([(r["A"], r["E"], r["V"]) for r in cells.df.collect()], int(parameter_count))
