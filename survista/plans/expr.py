"""Expressions over a life's facts and time.

`i.pension` is a fact, `t` the time, `b` the birth (`i.birth`), `x` the age (`t - b`). Nodes are
immutable, built by operators and the functions below, or parsed from text with a whitelist. Subtrees
without pronouns are folded as they are built.
"""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass

from survista.functions.clicks import PER_CLICK, Instant, Span

UNARY = frozenset("neg abs sqrt exp expm1 log log1p log10 sin cos floor ceiling trunc round sign not is_na".split())
BINARY = frozenset("add sub mul div pow floordiv mod min max and or xor == != < <= > >=".split())
LOGICAL = frozenset("not and or xor == != < <= > >= is_na in".split())
RESERVED = frozenset({"count"})


class ExpressionError(ValueError):
    """An expression that cannot be built or typed."""


@dataclass(frozen=True, eq=False)
class Node:
    """op, its arguments, and a value: of a literal, the name of a field, the items of a set, or a leaf object."""

    op: str
    args: tuple[Node, ...] = ()
    value: object = None

    def __bool__(self):
        raise ExpressionError("use &, | and ~ between expressions, and ifelse() to choose")

    def __add__(self, o): return call("add", self, o)  # noqa: E704
    def __radd__(self, o): return call("add", o, self)  # noqa: E704
    def __sub__(self, o): return call("sub", self, o)  # noqa: E704
    def __rsub__(self, o): return call("sub", o, self)  # noqa: E704
    def __mul__(self, o): return call("mul", self, o)  # noqa: E704
    def __rmul__(self, o): return call("mul", o, self)  # noqa: E704
    def __truediv__(self, o): return call("div", self, o)  # noqa: E704
    def __rtruediv__(self, o): return call("div", o, self)  # noqa: E704
    def __floordiv__(self, o): return call("floordiv", self, o)  # noqa: E704
    def __rfloordiv__(self, o): return call("floordiv", o, self)  # noqa: E704
    def __mod__(self, o): return call("mod", self, o)  # noqa: E704
    def __rmod__(self, o): return call("mod", o, self)  # noqa: E704
    def __pow__(self, o): return call("pow", self, o)  # noqa: E704
    def __rpow__(self, o): return call("pow", o, self)  # noqa: E704
    def __neg__(self): return call("neg", self)  # noqa: E704
    def __pos__(self): return self  # noqa: E704
    def __abs__(self): return call("abs", self)  # noqa: E704
    def __invert__(self): return call("not", self)  # noqa: E704
    def __and__(self, o): return call("and", self, o)  # noqa: E704
    def __rand__(self, o): return call("and", o, self)  # noqa: E704
    def __or__(self, o): return call("or", self, o)  # noqa: E704
    def __ror__(self, o): return call("or", o, self)  # noqa: E704
    def __xor__(self, o): return call("xor", self, o)  # noqa: E704
    def __eq__(self, o): return call("==", self, o)  # noqa: E704
    def __ne__(self, o): return call("!=", self, o)  # noqa: E704
    def __lt__(self, o): return call("<", self, o)  # noqa: E704
    def __le__(self, o): return call("<=", self, o)  # noqa: E704
    def __gt__(self, o): return call(">", self, o)  # noqa: E704
    def __ge__(self, o): return call(">=", self, o)  # noqa: E704
    __hash__ = object.__hash__

    def __repr__(self):
        return deparse(self)


def node(x) -> Node:
    """x as an expression: a number, truth value, text, instant, span, or an object that is one itself."""
    if isinstance(x, Node):
        return x
    if hasattr(x, "as_node"):
        return x.as_node()
    if isinstance(x, bool | str | Instant | Span):
        return Node("lit", value=x)
    if isinstance(x, int | float):
        if x != x:
            raise ExpressionError("a constant may not be missing")
        return Node("lit", value=float(x))
    raise ExpressionError(f"{type(x).__name__} cannot stand in an expression")


def call(op: str, *args) -> Node:
    args = tuple(map(node, args))
    if op == "ifelse" and uses_t(args[0]):
        raise ExpressionError("the condition of ifelse() may not depend on t")
    new = Node(op, args)
    if all(a.op == "lit" for a in args) and op not in ("is_na",):
        from survista.plans.evaluate import evaluate

        value = evaluate(new, {}, None)
        if isinstance(value, float) and value != value:
            raise ExpressionError(f"{deparse(new)} is missing")
        return Node("lit", value=value)
    return new


class _Facts:
    """i.<name> or i["name"]."""

    def __getattr__(self, name: str) -> Node:
        if name.startswith("__"):
            raise AttributeError(name)
        return field(name)

    __getitem__ = __getattr__


def field(name: str) -> Node:
    if name.lower() in RESERVED or name.lower().startswith("e2r_"):
        raise ExpressionError(f"{name} is reserved")
    return Node("field", value=name)


i = _Facts()
t = Node("t")
b = Node("field", value="birth")
x = Node("sub", (t, b))


def exp(a): return call("exp", a)  # noqa: E704
def expm1(a): return call("expm1", a)  # noqa: E704
def log(a): return call("log", a)  # noqa: E704
def log1p(a): return call("log1p", a)  # noqa: E704
def log10(a): return call("log10", a)  # noqa: E704
def sqrt(a): return call("sqrt", a)  # noqa: E704
def sin(a): return call("sin", a)  # noqa: E704
def cos(a): return call("cos", a)  # noqa: E704
def floor(a): return call("floor", a)  # noqa: E704
def ceiling(a): return call("ceiling", a)  # noqa: E704
def trunc(a): return call("trunc", a)  # noqa: E704
def round_(a): return call("round", a)  # noqa: E704
def sign(a): return call("sign", a)  # noqa: E704
def is_na(a): return call("is_na", a)  # noqa: E704
def xor(a, c): return call("xor", a, c)  # noqa: E704
def minimum(a, c): return call("min", a, c)  # noqa: E704
def maximum(a, c): return call("max", a, c)  # noqa: E704
def clamp(a, low, high): return call("clamp", a, low, high)  # noqa: E704
def ifelse(test, yes, no): return call("ifelse", test, yes, no)  # noqa: E704


def isin(a, values) -> Node:
    """Whether a equals one of some texts, or of some numbers."""
    values = list(values)
    if not (all(isinstance(v, str) for v in values) or all(isinstance(v, int | float) and not isinstance(v, bool) for v in values)):
        raise ExpressionError("a set holds texts only, or numbers only")
    return Node("in", (node(a),), tuple(v if isinstance(v, str) else float(v) for v in values))


def uses_t(n: Node) -> bool:
    if n.op == "mortality":
        return n.value.uses_t
    return n.op == "t" or any(map(uses_t, n.args))


def fields(n: Node) -> set[str]:
    if n.op == "mortality":
        return n.value.fields
    return ({n.value} if n.op == "field" else set()).union(*map(fields, n.args))


def is_logical(n: Node) -> bool:
    if n.op == "lit":
        return isinstance(n.value, bool)
    if n.op == "ifelse":
        return is_logical(n.args[1]) and is_logical(n.args[2])
    return n.op in LOGICAL


def leaves(n: Node) -> list:
    """The objects (mortalities) that stand in an expression."""
    return [n.value] if n.op == "mortality" else [x for a in n.args for x in leaves(a)]


_SIGNS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "**", "floordiv": "//", "mod": "%", "and": "&", "or": "|", "xor": "^"}


def deparse(n: Node) -> str:
    if n.op == "lit":
        v = n.value
        if isinstance(v, Instant | Span):
            return f"{v.years:.10g}"
        return repr(v) if isinstance(v, str | bool) else f"{v:.10g}"
    if n.op == "field":
        return "b" if n.value == "birth" else f"i.{n.value}"
    if n.op == "t":
        return "t"
    if n.op == "mortality":
        return n.value.name or type(n.value).__name__.lower()
    if n.op == "sub" and n.args[0].op == "t" and n.args[1].value == "birth":
        return "x"
    if n.op == "in":
        return f"isin({deparse(n.args[0])}, {list(n.value)})"
    if n.op in BINARY and n.op not in ("min", "max"):
        return "(" + f" {_SIGNS.get(n.op, n.op)} ".join(map(deparse, n.args)) + ")"
    if n.op in ("neg", "not"):
        return f"{'-' if n.op == 'neg' else '~'}{deparse(n.args[0])}"
    return f"{n.op}({', '.join(map(deparse, n.args))})"


def short(n: Node, most: int = 60) -> str:
    s = deparse(n)
    return s if len(s) <= most else s[: most - 3] + "..."


def show(n: Node, depth: int = 0) -> str:
    """The tree, a node a line."""
    head = n.op + ("" if n.value is None else f" {n.value!r}")
    return "\n".join(["  " * depth + head, *(show(a, depth + 1) for a in n.args)])


_FUNCTIONS = {f: 1 for f in UNARY if f not in ("neg", "not")} | {"min": 2, "max": 2, "pmin": 2, "pmax": 2, "xor": 2, "clamp": 3, "ifelse": 3}
_OPERATORS = {
    ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Pow: "pow", ast.FloorDiv: "floordiv", ast.Mod: "mod", ast.BitAnd: "and", ast.BitOr: "or", ast.BitXor: "xor",
    ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=",
}


def parse(text: str, **names) -> Node:
    """An expression from text: pronouns, whitelisted operators and functions, and the names given."""

    def walk(e: ast.expr) -> Node:
        if isinstance(e, ast.Constant):
            return node(e.value)
        if isinstance(e, ast.Name):
            if e.id in names:
                return node(names[e.id])
            if e.id in ("t", "b", "x"):
                return {"t": t, "b": b, "x": x}[e.id]
            raise ExpressionError(f"{e.id} is not known")
        if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name) and e.value.id == "i":
            return field(e.attr)
        if isinstance(e, ast.BinOp) and type(e.op) in _OPERATORS:
            return call(_OPERATORS[type(e.op)], walk(e.left), walk(e.right))
        if isinstance(e, ast.UnaryOp):
            a = walk(e.operand)
            return a if isinstance(e.op, ast.UAdd) else call("neg" if isinstance(e.op, ast.USub) else "not", a)
        if isinstance(e, ast.BoolOp):
            out = walk(e.values[0])
            for v in e.values[1:]:
                out = call("and" if isinstance(e.op, ast.And) else "or", out, walk(v))
            return out
        if isinstance(e, ast.Compare) and len(e.ops) == 1:
            if isinstance(e.ops[0], ast.In):
                return isin(walk(e.left), ast.literal_eval(e.comparators[0]))
            if type(e.ops[0]) in _OPERATORS:
                return call(_OPERATORS[type(e.ops[0])], walk(e.left), walk(e.comparators[0]))
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and not e.keywords and e.func.id in _FUNCTIONS:
            if len(e.args) != _FUNCTIONS[e.func.id]:
                raise ExpressionError(f"{e.func.id}() takes {_FUNCTIONS[e.func.id]} arguments")
            return call({"pmin": "min", "pmax": "max"}.get(e.func.id, e.func.id), *map(walk, e.args))
        raise ExpressionError(f"{ast.unparse(e)} is not allowed in an expression")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ExpressionError(str(error)) from None
    return walk(tree.body)


def pronouns(*texts: str, **named: str) -> dict[str, Node]:
    """Expressions from texts, by name, or by their own text."""
    return {s: parse(s) for s in texts} | {k: parse(s) for k, s in named.items()}


def affine_in_t(n: Node) -> tuple[Node, Node] | None:
    """(a, c) with n = a + c * years(t), both without t; None where n is not of that form."""
    zero = Node("lit", value=0.0)
    if not uses_t(n):
        return n, zero
    if n.op == "t":
        return zero, Node("lit", value=1.0)
    if n.op == "neg" and (p := affine_in_t(n.args[0])):
        return call("neg", p[0]), call("neg", p[1])
    if n.op in ("add", "sub"):
        p, q = affine_in_t(n.args[0]), affine_in_t(n.args[1])
        return (call(n.op, p[0], q[0]), call(n.op, p[1], q[1])) if p and q else None
    if n.op == "mul":
        for u, v in (n.args, n.args[::-1]):
            if not uses_t(u) and (p := affine_in_t(v)):
                return call("mul", u, p[0]), call("mul", u, p[1])
    if n.op == "div" and not uses_t(n.args[1]) and (p := affine_in_t(n.args[0])):
        return call("div", p[0], n.args[1]), call("div", p[1], n.args[1])
    if n.op == "ifelse":
        p, q = affine_in_t(n.args[1]), affine_in_t(n.args[2])
        return (call("ifelse", n.args[0], p[0], q[0]), call("ifelse", n.args[0], p[1], q[1])) if p and q else None
    if n.op == "mortality":
        return n.value.affine()
    return None


def finite(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)


def in_years(v):
    return v.clicks * PER_CLICK if isinstance(v, Instant | Span) else v
