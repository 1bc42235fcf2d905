"""Expressions to Spark columns, with the kinds that the engine knows: double, bool, text, instant, span.

Instants and spans stay whole clicks as long as arithmetic allows, and are read as years otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.functions.clicks import CLICKS, FIRST, LAST, LONGEST, Instant, Span, years
from survista.plans.expr import ExpressionError, Node, deparse

DOUBLE, BOOL, TEXT, INSTANT, SPAN = "double", "bool", "text", "instant", "span"
TIMES = (INSTANT, SPAN)
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str

    def double(self) -> Column:
        """As a double: times in years, truth as 0 and 1."""
        if self.kind == TEXT:
            raise ExpressionError("a text is not a number")
        if self.kind in TIMES:
            return F.coalesce(years(self.column), ieee.lit(ieee.NAN))
        return self.column.cast("double") if self.kind == BOOL else self.column


@dataclass(frozen=True)
class Scope:
    """What pronouns stand for: kinds of the fields, and the columns of a field and of the time."""

    kinds: dict[str, str]
    t: Column | None = None

    def field(self, name: str) -> Typed:
        if name not in self.kinds:
            raise ExpressionError(f"the data have no column {name}")
        return Typed(F.col(f"`{name}`"), self.kinds[name])

    def at(self, t: Column) -> Scope:
        return Scope(self.kinds, t)


def literal(v) -> Typed:
    if isinstance(v, bool):
        return Typed(F.lit(v), BOOL)
    if isinstance(v, str):
        return Typed(F.lit(v), TEXT)
    if isinstance(v, Instant):
        return Typed(F.lit(v.clicks).cast("long"), INSTANT)
    if isinstance(v, Span):
        return Typed(F.lit(v.clicks).cast("long"), SPAN)
    return Typed(ieee.lit(v), DOUBLE)


_DOUBLES = {
    "neg": lambda x: -x, "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": ieee.log, "log1p": ieee.log1p, "log10": ieee.log10, "sin": F.sin, "cos": F.cos,
    "floor": ieee.floor, "ceiling": ieee.ceiling, "trunc": ieee.trunc, "round": F.rint, "sign": F.signum, "add": lambda x, y: x + y, "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y, "div": ieee.div, "pow": ieee.power, "floordiv": ieee.floor_div, "mod": ieee.mod, "min": ieee.minimum, "max": ieee.maximum, "clamp": ieee.clamp,
}


def _times(op: str, kinds: list[str]) -> str | None:
    """Kind of an exact operation on times, None where they are to be read as years."""
    if not all(k in TIMES for k in kinds):
        return None
    table = {("sub", INSTANT, INSTANT): SPAN, ("add", INSTANT, SPAN): INSTANT, ("add", SPAN, INSTANT): INSTANT, ("sub", INSTANT, SPAN): INSTANT, ("add", SPAN, SPAN): SPAN, ("sub", SPAN, SPAN): SPAN, ("neg", SPAN): SPAN, ("abs", SPAN): SPAN}
    if (op, *kinds) in table:
        return table[(op, *kinds)]
    if op in ("min", "max", "clamp") and len(set(kinds)) == 1:
        return kinds[0]
    if op in ("add", "sub", "mul", "neg", "abs", "min", "max", "clamp"):
        raise ExpressionError(f"{op} has no meaning for {' and '.join(kinds)}")
    return None


_CLICKS = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "neg": lambda x: -x, "abs": F.abs, "min": F.least, "max": F.greatest, "clamp": lambda x, a, z: F.least(F.greatest(x, a), z)}


def _whole_clicks(n: Node) -> int | None:
    """A number of years that is a whole number of clicks, in clicks."""
    if n.op == "lit" and isinstance(n.value, float) and abs(n.value) < 4000 and (n.value * CLICKS).is_integer() and (n.value * CLICKS) * (1.0 / CLICKS) == n.value:
        return int(n.value * CLICKS)
    return None


def _compare(op: str, n: Node, vs: list[Typed]) -> Column:
    kinds = [v.kind for v in vs]
    if TEXT in kinds:
        if kinds != [TEXT, TEXT] or op not in ("==", "!="):
            raise ExpressionError(f"texts are compared with texts, by == and != only: {deparse(n)}")
        return vs[0].column == vs[1].column if op == "==" else vs[0].column != vs[1].column
    if kinds[0] in TIMES and kinds[0] == kinds[1] or kinds == [BOOL, BOOL]:
        a, c = vs[0].column, vs[1].column
        test = {"==": a == c, "!=": a != c, "<": a < c, "<=": a <= c, ">": a > c, ">=": a >= c}[op]
        return test if kinds[0] == BOOL else F.coalesce(test, F.lit(op == "!="))
    for k, o in ((0, 1), (1, 0)):
        # whole clicks compare exactly, and reach the scan as a filter
        if kinds[k] in TIMES and kinds[o] == DOUBLE and (whole := _whole_clicks(n.args[o])) is not None:
            a, c = vs[k].column, F.lit(whole).cast("long")
            a, c = (a, c) if k == 0 else (c, a)
            test = {"==": a == c, "!=": a != c, "<": a < c, "<=": a <= c, ">": a > c, ">=": a >= c}[op]
            # births are never missing, and a bare comparison is what a scan takes
            return test if n.args[k].value == "birth" else F.coalesce(test, F.lit(op == "!="))
    return ieee.compare(op, vs[0].double(), vs[1].double())


def typed(n: Node, scope: Scope) -> Typed:
    """The column of n and its kind."""
    if n.op == "lit":
        return literal(n.value)
    if n.op == "field":
        return scope.field(n.value)
    if n.op == "t":
        if scope.t is None:
            raise ExpressionError("t cannot stand here")
        return Typed(scope.t, INSTANT)
    if n.op == "mortality":
        return Typed(n.value.column(scope), DOUBLE)
    vs = [typed(a, scope) for a in n.args]
    kinds = [v.kind for v in vs]
    if n.op in COMPARISONS:
        return Typed(_compare(n.op, n, vs), BOOL)
    if n.op in ("and", "or", "xor", "not"):
        if set(kinds) != {BOOL}:
            raise ExpressionError(f"{n.op} needs truth values: {deparse(n)}")
        cs = [v.column for v in vs]
        return Typed(~cs[0] if n.op == "not" else cs[0] & cs[1] if n.op == "and" else cs[0] | cs[1] if n.op == "or" else cs[0] != cs[1], BOOL)
    if n.op == "in":
        if not n.value:
            return Typed(F.lit(False), BOOL)
        if (kinds[0] == TEXT) != isinstance(n.value[0], str):
            raise ExpressionError(f"texts are looked up among texts, numbers among numbers: {deparse(n)}")
        c = vs[0].column if kinds[0] == TEXT else vs[0].double()
        test = c.isin(*n.value)
        return Typed(test if kinds[0] == TEXT else ~F.isnan(c) & test, BOOL)
    if n.op == "is_na":
        if kinds[0] in (BOOL, TEXT):
            raise ExpressionError("only numbers and times can be missing")
        c = vs[0].column
        if kinds[0] == DOUBLE:
            return Typed(F.isnan(c), BOOL)
        low, high = (FIRST, LAST) if kinds[0] == INSTANT else (-LONGEST, LONGEST)
        return Typed(~F.coalesce(c.between(low, high), F.lit(False)), BOOL)
    if n.op == "ifelse":
        if kinds[0] != BOOL:
            raise ExpressionError("ifelse() needs a truth value first")
        if TEXT in kinds[1:]:
            raise ExpressionError("the branches of ifelse() cannot be texts")
        same = kinds[1] == kinds[2]
        yes, no = (vs[1].column, vs[2].column) if same else (vs[1].double(), vs[2].double())
        return Typed(F.when(vs[0].column, yes).otherwise(no), kinds[1] if same else DOUBLE)
    if kind := _times(n.op, kinds):
        return Typed(_CLICKS[n.op](*[v.column for v in vs]), kind)
    return Typed(_DOUBLES[n.op](*[v.double() for v in vs]), DOUBLE)


def number(n: Node, scope: Scope) -> Column:
    return typed(n, scope).double()


def truth(n: Node, scope: Scope) -> Column:
    v = typed(n, scope)
    if v.kind != BOOL:
        raise ExpressionError(f"{deparse(n)} is not a truth value")
    return v.column
