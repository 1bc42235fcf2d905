"""Variables, indicators and includes: what to count, and whom, and when.

An include is a conjunction of terms: a gate (a truth value without t), or a stretch of time, absolute or
counted from an instant of each life. Includes narrow a life's span; a death counts where the narrowed span still
ends with the life's own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from survista.functions.clicks import Instant, Span, instant, span
from survista.operators.settings import valid_name
from survista.plans import expr as E
from survista.plans.columns import BOOL, INSTANT, SPAN, TEXT, Scope, truth, typed
from survista.plans.evaluate import evaluate


def _node(x) -> E.Node:
    return E.parse(x) if isinstance(x, str) and x != "" else E.node(x)


@dataclass(frozen=True, eq=False)
class Variable:
    node: E.Node
    name: str | None = None

    def as_node(self) -> E.Node:
        return self.node

    def __mul__(self, other):
        from survista.operators.covariates import Covariates

        return other.__rmul__(self) if isinstance(other, Covariates) else self.node * other


class StaticVariable(Variable):
    pass


@dataclass(frozen=True)
class Term:
    """gate: a node. Otherwise a stretch from..to (None: open), counted from `origin`, or absolute without."""

    gate: E.Node | None = None
    origin: E.Node | None = None
    low: Instant | Span | None = None
    high: Instant | Span | None = None


@dataclass(frozen=True, eq=False)
class Include:
    terms: tuple[Term, ...]
    name: str | None = None
    group_name: str | None = None

    def __and__(self, other) -> Include:
        """Both; labels are dropped."""
        other = as_include(other)
        if isinstance(self, Indicator) and isinstance(other, Indicator):
            return indicator(self.node & other.node)
        return Include(self.terms + other.terms)

    def __rand__(self, other) -> Include:
        return as_include(other) & self

    def named(self, name: str | None, group_name: str | None = None):
        return replace(self, name=name if name is None else valid_name(name), group_name=group_name or self.group_name)


@dataclass(frozen=True, eq=False)
class Indicator(Include):
    """A gate that is a variable of 0 and 1 as well."""

    def __init__(self, node: E.Node, name: str | None = None, group_name: str | None = None):
        object.__setattr__(self, "node", node)
        object.__setattr__(self, "terms", (Term(gate=node),))
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "group_name", group_name)

    def as_node(self) -> E.Node:
        return self.node

    def named(self, name, group_name=None):
        return Indicator(self.node, name if name is None else valid_name(name), group_name or self.group_name)

    def __mul__(self, other):
        from survista.operators.covariates import Covariates

        return other.__rmul__(self) if isinstance(other, Covariates) else self.node * other


def variable(of, name: str | None = None):
    """The narrowest of variable, static variable and indicator."""
    n = _node(of)
    if not E.uses_t(n):
        return indicator(n, name) if E.is_logical(n) else StaticVariable(n, name)
    return Variable(n, name)


def static_variable(of, name: str | None = None):
    v = variable(of, name)
    if E.uses_t(v.as_node()):
        raise E.ExpressionError("a static variable may not depend on t")
    return v


def indicator(of, name: str | None = None) -> Indicator:
    n = _node(of)
    if E.uses_t(n):
        raise E.ExpressionError("an indicator may not depend on t")
    if n.op == "lit" and n.value in (0.0, 1.0):
        n = E.node(bool(n.value))
    if not E.is_logical(n) and n.op != "field":
        raise E.ExpressionError(f"{E.deparse(n)} is not a truth value")
    return Indicator(n, name)


def include(of) -> Include:
    return as_include(of)


def as_include(of) -> Include:
    return of if isinstance(of, Include) else indicator(of)


def is_variable(x) -> bool: return isinstance(x, Variable | Indicator)  # noqa: E704
def is_static_variable(x) -> bool: return isinstance(x, StaticVariable | Indicator)  # noqa: E704
def is_indicator(x) -> bool: return isinstance(x, Indicator)  # noqa: E704
def is_include(x) -> bool: return isinstance(x, Include)  # noqa: E704
def is_includes(x) -> bool: return isinstance(x, Includes)  # noqa: E704


@dataclass(frozen=True)
class Includes:
    """An ordered list of includes, which may overlap and need not cover."""

    items: tuple[Include, ...] = ()

    def __len__(self):
        return len(self.items)

    def __iter__(self):
        return iter(self.items)

    def __getitem__(self, k):
        return Includes(self.items[k]) if isinstance(k, slice) else self.items[k]

    def __and__(self, other) -> Includes:
        """Each of the list with the other, labels kept."""
        return Includes(tuple((a & other).named(a.name, a.group_name) for a in self.items))

    @property
    def names(self) -> list:
        return [a.name for a in self.items]

    @property
    def group_names(self) -> list:
        return [a.group_name for a in self.items]

    def with_names(self, names: list) -> Includes:
        if len(names) != len(self.items):
            raise ValueError("one name for each include is needed")
        return Includes(tuple(a.named(n) for a, n in zip(self.items, names, strict=True)))

    def with_group_names(self, names) -> Includes:
        names = [names] * len(self.items) if isinstance(names, str) or names is None else list(names)
        if len(names) != len(self.items):
            raise ValueError("one group name, or one for each include, is needed")
        return Includes(tuple(replace_group(a, n) for a, n in zip(self.items, names, strict=True)))


def replace_group(a: Include, group: str | None) -> Include:
    group = group if group is None else valid_name(group)
    return Indicator(a.node, a.name, group) if isinstance(a, Indicator) else replace(a, group_name=group)


def includes(*parts, **named) -> Includes:
    """Includes and lists of them as one list; a keyword names an include, or the group of a list."""
    out: list[Include] = []
    for name, p in [*((None, p) for p in parts), *named.items()]:
        if isinstance(p, Includes):
            out += (p if name is None else p.with_group_names(name)).items
        else:
            p = as_include(p)
            out.append(p if name is None else p.named(name))
    return Includes(tuple(out))


def _edges(low, high, by, thresholds) -> list:
    if by is not None and thresholds is not None:
        raise ValueError("by and thresholds exclude each other")
    if by is not None:
        if low is None or high is None:
            raise ValueError("by needs both ends")
        n = (high - low) / by
        if by <= 0 or abs(n - round(n)) > 1e-9 or round(n) < 1:
            raise ValueError("by must divide the range into whole bands")
        mid = [low + k * by for k in range(1, round(n))]
    else:
        mid = list(thresholds or [])
    edges = [low, *mid, high]
    known = [e for e in edges if e is not None]
    if not known:
        raise ValueError("at least one edge is needed")
    if any(a >= c for a, c in zip(known, known[1:], strict=False)):
        raise ValueError("edges must increase")
    return edges


def _label(low, high) -> str:
    show = lambda v: f"{v.years:.10g}" if isinstance(v, Instant | Span) else f"{v:.10g}"
    return "all" if low is None and high is None else f"< {show(high)}" if low is None else f">= {show(low)}" if high is None else f"{show(low)}-{show(high)}"


def _origin(n: E.Node) -> E.Node | None:
    """The static instant that a duration `t - origin` counts from."""
    return n.args[1] if n.op == "sub" and n.args[0].op == "t" and not E.uses_t(n.args[1]) else None


def _band(n: E.Node, low, high, group: str) -> Include:
    name = _label(low, high)
    if n.op == "t":
        return Include((Term(low=None if low is None else instant(low), high=None if high is None else instant(high)),), name, group)
    if (origin := _origin(n)) is not None:
        return Include((Term(origin=origin, low=None if low is None else span(low), high=None if high is None else span(high)),), name, group)
    if E.uses_t(n):
        raise E.ExpressionError(f"{E.deparse(n)} cannot be banded: it must be static, t, or t less a static instant")
    gate = E.node(True) if low is None and high is None else n < high if low is None else n >= low if high is None else (n >= low) & (n < high)
    return Indicator(gate, name, group)


def band(of, low=None, high=None) -> Include:
    n = _node(of)
    _edges(low, high, None, None)
    return _band(n, low, high, E.deparse(n).replace("i.", ""))


def bands(of, low=None, high=None, by=None, thresholds=None, group: str | None = None) -> Includes:
    n = _node(of)
    edges = _edges(low, high, by, thresholds)
    return Includes(tuple(_band(n, a, c, group or E.deparse(n).replace("i.", "")) for a, c in zip(edges, edges[1:], strict=False)))


def age(low=None, high=None) -> Include: return replace_group(band(E.x, low, high), "age")  # noqa: E704
def ages(low=None, high=None, by=None, thresholds=None) -> Includes: return bands(E.x, low, high, by, thresholds, "age")  # noqa: E704
def period(low=None, high=None) -> Include: return replace_group(band(E.t, low, high), "period")  # noqa: E704
def periods(low=None, high=None, by=None, thresholds=None) -> Includes: return bands(E.t, low, high, by, thresholds, "period")  # noqa: E704


def duration(since, low=None, high=None) -> Include:
    n = _node(since)
    return replace_group(band(E.t - n, low, high), f"duration since {E.deparse(n).replace('i.', '')}")


def durations(since, low=None, high=None, by=None, thresholds=None) -> Includes:
    n = _node(since)
    return bands(E.t - n, low, high, by, thresholds, f"duration since {E.deparse(n).replace('i.', '')}")


def category(of, values, name: str | None = None) -> Indicator:
    """Membership of a group of values of a text (or of numbers)."""
    n = _node(of)
    values = [values] if isinstance(values, str | int | float) else list(values)
    test = n == values[0] if len(values) == 1 else E.isin(n, values)
    return Indicator(test, name or "+".join(map(str, values)), E.deparse(n).replace("i.", ""))


def categories(of, *groups, source=None, known=None, exhaustive: bool = False, disjoint: bool = True, **named) -> Includes:
    """An indicator for each group of values; without groups, one for each value of `source` (a list of
    declared levels, or data whose distinct values are taken in order)."""
    n = _node(of)
    levels = None
    if source is not None:
        levels = list(source) if isinstance(source, list | tuple) else _levels(source, n)
    every = [(None, g) for g in groups] + list(named.items())
    if not every:
        if levels is None:
            raise ValueError("categories need groups, or a source of them")
        every = [(None, v) for v in levels]
    known = list(known) if known is not None else levels
    lists = [[g] if isinstance(g, str | int | float) else list(g) for _, g in every]
    used = [v for g in lists for v in g]
    if known is not None and (odd := [v for v in used if v not in known]):
        raise ValueError(f"not known: {', '.join(map(str, odd))}")
    if exhaustive and known is not None and (odd := [v for v in known if v not in used]):
        raise ValueError(f"in no category: {', '.join(map(str, odd))}")
    if disjoint and len(set(used)) != len(used):
        raise ValueError("a value is in two categories")
    out = [category(n, g, name) for (name, _), g in zip(every, lists, strict=True)]
    if len({c.name for c in out}) != len(out):
        raise ValueError("two categories have one name")
    return Includes(tuple(out))


#: Values a category may have; a column with more is no category.
MOST_LEVELS = 10_000


def _levels(data, n: E.Node) -> list[str]:
    c = typed(n, data.scope())
    if c.kind != TEXT:
        raise E.ExpressionError("the source of categories must be a text")
    got = [r[0] for r in data.df.select(c.column.alias("v")).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(got) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} values are no categories")
    return sorted(got)


@dataclass(frozen=True)
class Clip:
    """Columns of an include: the narrowed span, whether the death counts, and whether anything is left."""

    nu: Column
    tau: Column
    died: Column
    gate: Column | None


def clip(terms: tuple[Term, ...], scope: Scope, start: Column, end: Column, died: Column) -> Clip:
    nu, tau, gate = [start], [end], None
    for term in terms:
        if term.gate is not None:
            v = typed(term.gate, scope)
            g = v.column if v.kind == BOOL else truth(term.gate, scope)
            gate = g if gate is None else gate & g
            continue
        if term.origin is None:
            low, high = (None if e is None else F.lit(e.clicks) for e in (term.low, term.high))
        else:
            o = typed(term.origin, scope)
            if o.kind != INSTANT:
                raise E.ExpressionError("durations count from instants")
            low, high = (None if e is None else o.column + F.lit(e.clicks) for e in (term.low, term.high))
            known = o.column.isNotNull()
            gate = known if gate is None else gate & known
        if low is not None:
            nu.append(low)
        if high is not None:
            tau.append(high)
    nu = F.greatest(*nu) if len(nu) > 1 else nu[0]
    last = F.least(*tau) if len(tau) > 1 else tau[0]
    return Clip(nu, last, died & (last == end) if len(tau) > 1 else died, gate)


def period_included(of, facts: dict, start=None, end=None) -> tuple[Instant, Instant] | None:
    """The stretch [from, to) of one life that an include leaves, None where nothing is left."""
    nu, tau = (None if start is None else instant(start)), (None if end is None else instant(end))
    for term in as_include(of).terms:
        if term.gate is not None:
            if not evaluate(term.gate, facts, None):
                return None
            continue
        origin = None if term.origin is None else evaluate(term.origin, facts, None)
        if term.origin is not None and not isinstance(origin, Instant):
            return None
        low, high = ((e if origin is None or e is None else origin + e) for e in (term.low, term.high))
        nu = low if nu is None else nu if low is None else max(nu, low)
        tau = high if tau is None else tau if high is None else min(tau, high)
    return (nu, tau) if nu is None or tau is None or nu < tau else None


def value(of, facts: dict, when=None):
    """The value of a variable for one life at a time."""
    return evaluate(of.as_node() if hasattr(of, "as_node") else _node(of), facts, None if when is None else instant(when))


def logical_value(of, facts: dict) -> bool:
    return bool(evaluate(indicator(of).node if not isinstance(of, Indicator) else of.node, facts, None))


KINDS = (BOOL, SPAN)
