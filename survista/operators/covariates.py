"""Covariates of a proportional-hazards model: named terms, crossed and joined, perhaps disjoint."""

from __future__ import annotations

from dataclasses import dataclass

from survista.operators.include import Include, Includes, Indicator
from survista.operators.mortality import Mortality, mortality
from survista.operators.settings import valid_name
from survista.plans import expr as E


@dataclass(frozen=True)
class Covariates:
    terms: tuple[tuple[str | None, E.Node], ...]
    disjoint: bool = False

    def __len__(self):
        return len(self.terms)

    def __getitem__(self, k) -> Covariates:
        return Covariates(self.terms[k] if isinstance(k, slice) else (self.terms[k],), self.disjoint)

    def __mul__(self, other) -> Covariates:
        """Each term times a variable, or with each term of other covariates (names joined where both have one)."""
        if isinstance(other, Covariates):
            terms = tuple((f"{a}.{c}" if a is not None and c is not None else None, u * v) for a, u in self.terms for c, v in other.terms)
            return Covariates(terms, self.disjoint or other.disjoint)
        v = E.parse(other) if isinstance(other, str) else E.node(other)
        return Covariates(tuple((a, u * v) for a, u in self.terms), self.disjoint)

    def __rmul__(self, other) -> Covariates:
        v = E.parse(other) if isinstance(other, str) else E.node(other)
        return Covariates(tuple((a, v * u) for a, u in self.terms), self.disjoint)

    def __add__(self, other: Covariates) -> Covariates:
        """Both lists; that terms are disjoint is no longer asserted."""
        return Covariates(self.terms + other.terms)

    @property
    def names(self) -> list[str]:
        return [a if a is not None else E.short(u) for a, u in self.terms]


def _terms(parts, named) -> tuple:
    out = []
    for name, p in [*((None, p) for p in parts), *named.items()]:
        if isinstance(p, Covariates):
            out += p.terms
        elif isinstance(p, Includes):
            out += [(a.name, _indicator(a)) for a in p]
        elif isinstance(p, Include):
            out.append((name or p.name, _indicator(p)))
        else:
            n = E.parse(p) if isinstance(p, str) else E.node(p)
            out.append((name if name is None else valid_name(name), n))
    if any(E.leaves(n) for _, n in out):
        raise E.ExpressionError("a mortality cannot be a covariate")
    return tuple(out)


def _indicator(a: Include) -> E.Node:
    if not isinstance(a, Indicator):
        raise E.ExpressionError("an include with a stretch of time cannot be a covariate")
    return a.node


def covariates(*parts, **named) -> Covariates:
    return Covariates(_terms(parts, named))


def disjoint(*parts, **named) -> Covariates:
    """Covariates of which at most one is other than zero for any life, as the fit will verify."""
    c = Covariates(_terms(parts, named), True)
    if any(E.uses_t(n) for _, n in c.terms):
        raise E.ExpressionError("disjoint covariates may not depend on t")
    return c


def is_covariates(x) -> bool: return isinstance(x, Covariates)  # noqa: E704
def is_disjoint(x) -> bool: return isinstance(x, Covariates) and x.disjoint  # noqa: E704


@dataclass(frozen=True)
class Model:
    reference: Mortality
    covariates: Covariates
    name: str | None = None


def model(ref_mortality, covariates, name: str | None = None) -> Model:
    c = covariates if isinstance(covariates, Covariates) else Covariates(_terms(covariates if isinstance(covariates, list | tuple) else (covariates,), {}))
    if not c.terms:
        raise ValueError("a model needs a covariate at least")
    return Model(mortality(ref_mortality), c, name if name is None else valid_name(name))


def is_model(x) -> bool:
    return isinstance(x, Model)
