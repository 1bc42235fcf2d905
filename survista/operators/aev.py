"""Actual and expected deaths and their variance: A, E and V, over a population or each element of a breakdown.

Each element clips a life's span in its own way and so has its own time grid. Lives are clipped first,
then explode into elements, of which only those with anything left become rows. Deaths are valued on these
rows. Where the log of the hazard is affine in time and weight and relevance are static, the grid's
sum has a closed form per row (`affine_integral`); otherwise rows explode into slots. Sums are combined on the map side,
so that one row an element is shuffled per task, and no shuffle ever carries lives or slots.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.functions.clicks import CLICKS, PER_CLICK
from survista.operators.grid import affine_integral, explode_slots
from survista.operators.include import Include, Includes, as_include, clip
from survista.operators.mortality import Mortality, mortality
from survista.operators.settings import Settings, resolve, valid_name
from survista.plans import expr as E
from survista.plans.columns import BOOL, DOUBLE, Scope, number, typed
from survista.sources.data import E2R, ExpData, stats

Z975 = 1.959963984540054
SCHEMA = "ord bigint, group string, name string, A double, E double, V double"


@dataclass(frozen=True)
class Aev:
    """Records (A, E, V) with labels, in order: a frame of ord, group, name, A, E, V. `of` is the frame of a batch that it is a part
    of, and its number there."""

    df: DataFrame
    of: tuple[DataFrame, int] | None = None

    def __add__(self, other: Aev) -> Aev:
        """Record by record; labels must agree."""
        o = other.df.select(F.col("ord").alias("_ord"), F.col("group").alias("_group"), F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in "AEV"])
        j = self.df.join(o, F.col("ord") == F.col("_ord"), "full")
        same = F.col("group").eqNullSafe(F.col("_group")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("ord").eqNullSafe(F.col("_ord"))
        wrong = F.raise_error(F.lit("records with different labels cannot be added"))
        return Aev(j.select("ord", "group", "name", *[F.when(same, F.col(c) + F.col(f"_{c}")).otherwise(wrong).alias(c) for c in "AEV"]))

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, k) -> Aev:
        """Records by position (from 0) or slice, numbered anew."""
        at = sorted(range(len(self))[k]) if isinstance(k, slice) else [k] if isinstance(k, int) else list(k)
        place = F.array_position(F.array(*[F.lit(a + 1).cast("long") for a in at]), F.col("ord"))
        return Aev(self.df.where(F.col("ord").isin([a + 1 for a in at])).withColumn("ord", place.cast("long")))

    def with_names(self, names: list[str | None]) -> Aev:
        return self._labelled("name", names)

    def with_group_names(self, names) -> Aev:
        return self._labelled("group", names)

    def _labelled(self, column: str, names) -> Aev:
        if not isinstance(names, list | tuple):
            return Aev(self.df.withColumn(column, F.lit(names if names is None else valid_name(names)).cast("string")))
        if len(names) != len(self):
            raise ValueError("one name for each record is needed")
        labels = F.array(*[F.lit(n if n is None else valid_name(n)).cast("string") for n in names])
        return Aev(self.df.withColumn(column, F.get(labels, (F.col("ord") - 1).cast("int"))))

    def property(self, name: str) -> DataFrame:
        """ord and one measure of PROPERTIES."""
        return self.df.select("ord", PROPERTIES[name]().alias(name))

    def to_df(self) -> DataFrame:
        """name, group, A, E, V, A_over_E, log_A_over_E_stddev, deviance_residual."""
        more = ("A_over_E", "log_A_over_E_stddev", "deviance_residual")
        return self.df.orderBy("ord").select("name", "group", "A", "E", "V", *[PROPERTIES[p]().alias(p) for p in more])

    def with_properties(self) -> DataFrame:
        return self.df.select("*", *[f().alias(p) for p, f in PROPERTIES.items()])


def _a() -> Column: return F.col("A")  # noqa: E704
def _e() -> Column: return F.col("E")  # noqa: E704
def _v() -> Column: return F.col("V")  # noqa: E704


#: Below this distance from 1 the deviance is taken from its series.
NEAR = 0.0015


def deviance_residual() -> Column:
    r = ieee.div(_a(), _e())
    alpha = r - 1
    exact = F.signum(alpha) * _e() * F.sqrt(ieee.div(2 * (r * ieee.log(r) - alpha), _v()))
    series = ieee.div(_e(), F.sqrt(_v())) * alpha * (1 + alpha * (-1 / 6 + alpha * (5 / 72 - alpha * 83 / 2160)))
    return F.when(r == 0, -_e() * F.sqrt(ieee.div(ieee.lit(2.0), _v()))).when(F.abs(alpha) > NEAR, exact).otherwise(series)


PROPERTIES = {
    "A_minus_E": lambda: _a() - _e(),
    "A_minus_E_stddev": lambda: F.sqrt(_v()),
    "A_over_E": lambda: ieee.div(_a(), _e()),
    "log_A_over_E": lambda: ieee.log(ieee.div(_a(), _e())),
    "log_A_over_E_stddev": lambda: ieee.div(F.sqrt(_v()), _e()),
    "log_A_over_E_95pc": lambda: ieee.div(Z975 * F.sqrt(_v()), _e()),
    "Pearson_residual": lambda: ieee.div(_a() - _e(), F.sqrt(_v())),
    "deviance_residual": deviance_residual,
}


def create_aev(spark: SparkSession, A: list[float], E: list[float], V: list[float], names=None, groups=None) -> Aev:
    n = len(A)
    names, groups = (list(x) if x is not None else [None] * n for x in (names, groups))
    if {len(x) for x in (E, V, names, groups)} != {n}:
        raise ValueError("all parts need one length")
    if any(v < 0 for x in (E, V) for v in x):
        raise ValueError("E and V may not be negative")
    rows = [(k + 1, g, m, float(a), float(e), float(v)) for k, (g, m, a, e, v) in enumerate(zip(groups, names, A, E, V, strict=True))]
    return Aev(spark.createDataFrame(rows, SCHEMA))


def is_aev(x) -> bool:
    return isinstance(x, Aev)


# ---- what is integrated ----


@dataclass(frozen=True)
class Measure:
    """A mortality with weight and relevance, resolved to expressions."""

    mortality: Mortality
    weight: E.Node | None = None
    relevance: E.Node | None = None
    distance: E.Node | None = None

    @property
    def fields(self) -> set[str]:
        nodes = [n for n in (self.weight, self.relevance, self.distance) if n is not None]
        return set(self.mortality.fields).union(*map(E.fields, nodes)) | {"birth"}

    @property
    def static(self) -> bool:
        return not any(n is not None and E.uses_t(n) for n in (self.weight, self.relevance, self.distance))

    def log_mu(self, scope: Scope) -> Column:
        return number(self.mortality.as_node(), scope)

    def s(self, scope: Scope) -> Column | None:
        if self.relevance is not None:
            return number(self.relevance, scope)
        return None if self.distance is None else F.exp(-number(self.distance, scope))

    def w(self, scope: Scope) -> Column | None:
        return None if self.weight is None else number(self.weight, scope)

    def zero_or_one(self, kinds: dict[str, str]) -> bool:
        """Whether the weight is provably 0 or 1, so that w squared is w."""
        return self.weight is None or zero_or_one(self.weight, kinds)


def zero_or_one(n: E.Node, kinds: dict[str, str]) -> bool:
    if n.op == "lit":
        return n.value in (0.0, 1.0) or isinstance(n.value, bool)
    if n.op == "field":
        return kinds.get(n.value) == BOOL
    if n.op == "ifelse":
        return all(zero_or_one(a, kinds) for a in n.args[1:])
    return E.is_logical(n) or n.op in ("mul", "min", "max") and all(zero_or_one(a, kinds) for a in n.args)


def as_expression(x) -> E.Node | None:
    if x is None:
        return None
    return E.parse(x) if isinstance(x, str) else E.node(x)


def measure(data: ExpData, m, weight=None, val_relevance=None, val_distance=None) -> Measure:
    if val_relevance is not None and val_distance is not None:
        raise ValueError("val_relevance and val_distance exclude each other")
    out = Measure(mortality(m), *map(as_expression, (weight, val_relevance, val_distance)))
    check_relevance(data, out)
    return out


def _interval(n: E.Node, known: dict, t: tuple[float, float]) -> tuple[float, float]:
    """Bounds of n, wide where nothing is known."""
    wide = (float("-inf"), float("inf"))
    if n.op == "lit":
        v = E.in_years(n.value)
        return (float(v), float(v)) if not isinstance(v, str) else wide
    if n.op == "t":
        return t
    if n.op == "field":
        return known.get(n.value, wide)
    if E.is_logical(n):
        return (0.0, 1.0)
    vs = [_interval(a, known, t) for a in n.args]
    if n.op == "ifelse":
        return min(vs[1][0], vs[2][0]), max(vs[1][1], vs[2][1])
    if n.op == "neg":
        return -vs[0][1], -vs[0][0]
    if n.op == "add":
        return vs[0][0] + vs[1][0], vs[0][1] + vs[1][1]
    if n.op == "sub":
        return vs[0][0] - vs[1][1], vs[0][1] - vs[1][0]
    if n.op == "mul":
        ps = [a * c for a in vs[0] for c in vs[1]]
        return wide if any(p != p for p in ps) else (min(ps), max(ps))
    if n.op == "div" and not vs[1][0] <= 0 <= vs[1][1]:
        qs = [a / c for a in vs[0] for c in vs[1]]
        return wide if any(q != q for q in qs) else (min(qs), max(qs))
    if n.op == "abs":
        low, high = vs[0]
        return (0.0 if low <= 0 <= high else min(abs(low), abs(high))), max(abs(low), abs(high))
    if n.op == "exp" and vs[0][1] < 700:
        import math

        return math.exp(max(vs[0][0], -745.0)) if vs[0][0] > -745 else 0.0, math.exp(vs[0][1])
    if n.op == "min":
        return min(vs[0][0], vs[1][0]), min(vs[0][1], vs[1][1])
    if n.op == "max":
        return max(vs[0][0], vs[1][0]), max(vs[0][1], vs[1][1])
    return wide


def check_relevance(data: ExpData, m: Measure) -> None:
    """Refuse a relevance provably outside [0, 1] throughout, or a distance provably below 0."""
    n = m.relevance if m.relevance is not None else m.distance
    if n is None:
        return
    names = [f for f in E.fields(n) if f in data.kinds]
    known = {}
    if names:
        for f, s in stats(data, names).items():
            if s["has_values"]:
                scale = PER_CLICK if data.kinds[f] in ("instant", "span") else 1.0
                known[f] = (float(s["min"]) * scale, float(s["max"]) * scale)
    low, high = _interval(n, known, (data.exp_start.years, data.exp_end.years))
    if m.relevance is not None and (high < 0 or low > 1):
        raise ValueError("the relevance is outside 0 to 1 throughout")
    if m.distance is not None and high < 0:
        raise ValueError("the distance is below 0 throughout")


# ---- rows of elements ----


def clipped(data: ExpData, elements: list[Include], needed: set[str]) -> DataFrame:
    """A row for each life and element (ord, from 1) with exposure left: nu, tau, died and the needed facts."""
    scope = data.scope()
    for e in elements:
        for term in e.terms:
            for n in (term.gate, term.origin):
                needed = needed | (E.fields(n) if n is not None else set())
    keep = sorted(c for c in needed if c in data.df.columns)
    df = data.df.select(*[F.col(f"`{c}`") for c in [*keep, *E2R]])
    start, end, died = F.col("E2R_start"), F.col("E2R_end"), F.col("E2R_died")
    if len(elements) == 1:
        c = clip(elements[0].terms, scope, start, end, died)
        if c.gate is not None:
            df = df.where(c.gate)
        df = df.withColumns({"ord": F.lit(1).cast("long"), "nu": c.nu, "tau": c.tau, "died": c.died}).drop(*E2R)
        return df.where(F.col("nu") < F.col("tau"))
    parts = []
    for k, e in enumerate(elements):
        c = clip(e.terms, scope, start, end, died)
        there = (c.nu < c.tau) if c.gate is None else (c.gate & (c.nu < c.tau))
        parts.append(F.when(there, F.struct(F.lit(k + 1).cast("long").alias("ord"), c.nu.alias("nu"), c.tau.alias("tau"), c.died.alias("died"))))
    return df.withColumn("_e", F.explode(F.array_compact(F.array(*parts)))).select(*[f"`{c}`" for c in keep], "_e.*")


def times(*factors: Column | None) -> Column:
    out = None
    for f in factors:
        if f is not None:
            out = f if out is None else out * f
    return ieee.lit(1.0) if out is None else out


def accumulate(rows: DataFrame, scope: Scope, m: Measure, step: int) -> DataFrame:
    """ord, A, E, V at overdispersion 1."""
    return accumulate_many(rows, scope, [(m, None)], step)


def has_closed_form(m: Measure) -> bool:
    return m.static and E.affine_in_t(m.mortality.as_node()) is not None


def accumulate_many(rows: DataFrame, scope: Scope, measures: list[tuple[Measure, int | None]], step: int) -> DataFrame:
    """ord, A, E, V at overdispersion 1, of several measures in one pass: a measure with the last ord that it is for (None:
    all). All have a closed form, or none."""
    end = scope.at(F.col("tau"))
    closed = has_closed_form(measures[0][0])
    if not closed:
        # the death is valued on the first slot's row, so that one scan gives both
        rows = explode_slots(rows, step)
    now = scope if closed else scope.at(F.col("t"))
    deaths, lives, squares = [], [], []
    for m, _ in measures:
        if closed:
            pair = E.affine_in_t(m.mortality.as_node())
            a, c = (number(n, scope) for n in pair)
            level = pair[1].op == "lit" and pair[1].value == 0.0
            mu = F.exp(a) * ((F.col("tau") - F.col("nu")).cast("double") * PER_CLICK) if level else affine_integral(a, c, F.col("nu"), F.col("tau"), step)
        else:
            mu = F.exp(m.log_mu(now)) * (F.col("width").cast("double") * PER_CLICK)
        s, w = m.s(now), m.w(now)
        deaths.append(F.when(F.col("died") if closed else F.col("died") & (F.col("k") == 0), times(m.s(end), m.w(end))))
        lives.append((mu, s, w))
        squares.append(m.zero_or_one(scope.kinds))

    def choose(columns: list[Column]) -> Column:
        out = columns[-1]
        for (_, last), c in reversed(list(zip(measures[:-1], columns[:-1], strict=True))):
            out = F.when(F.col("ord") <= last, c).otherwise(out)
        return out

    rows = rows.withColumn("_mu", choose([mu for mu, _, _ in lives]))
    mu = F.col("_mu")
    sums = [F.coalesce(F.sum(choose(deaths)), ieee.lit(0.0)).alias("A"), F.sum(choose([times(mu, s, w) for _, s, w in lives])).alias("E")]
    if all(squares):
        return rows.groupBy("ord").agg(*sums).withColumn("V", F.col("E"))
    v = choose([times(mu, s, w if same or w is None else w * w) for (_, s, w), same in zip(lives, squares, strict=True)])
    return rows.groupBy("ord").agg(*sums, F.sum(v).alias("V"))


@dataclass(frozen=True)
class Spec:
    """An A/E analysis made ready: elements, measure, overdispersion and step."""

    elements: list[Include]
    measure: Measure
    omega: float
    step: int


def spec(data: ExpData, mortality, include=None, weight=None, val_relevance=None, val_distance=None, breakdown=None, settings: Settings | None = None, overdispersion=None, time_scale=None) -> Spec:
    omega, step = resolve(settings, overdispersion, time_scale)
    return Spec(elements_of(include, breakdown), measure(data, mortality, weight, val_relevance, val_distance), omega, step)


def run_together(data: ExpData, specs: list[Spec]) -> DataFrame:
    """no (of the spec, from 0), ord, group, name, A, E, V of several analyses: one pass over the lives for those of one
    step with a closed form, and one for those of one step without."""
    spark = data.df.sparkSession
    passes: dict[tuple, list[int]] = {}
    for k, x in enumerate(specs):
        passes.setdefault((x.step, has_closed_form(x.measure)), []).append(k)
    sums, labels = None, []
    for at, ((step, _), mine) in enumerate(passes.items()):
        elements, measures, needed = [], [], set()
        for k in mine:
            labels += [(k, n + 1, e.group_name, e.name, specs[k].omega, at, len(elements) + n + 1) for n, e in enumerate(specs[k].elements)]
            elements += specs[k].elements
            measures.append((specs[k].measure, len(elements)))
            needed |= set(specs[k].measure.fields)
        got = accumulate_many(clipped(data, elements, needed), data.scope(), measures, step).select(F.lit(at).alias("_pass"), F.col("ord").alias("_ord"), "A", "E", "V")
        sums = got if sums is None else sums.unionByName(got)
    names = spark.createDataFrame(labels, "no int, ord bigint, group string, name string, omega double, _pass int, _ord bigint")
    # sums have a row an element at most
    out = names.join(F.broadcast(sums), ["_pass", "_ord"], "left")
    zero = ieee.lit(0.0)
    return out.select("no", "ord", "group", "name", F.coalesce("A", zero).alias("A"), F.coalesce("E", zero).alias("E"), (F.coalesce("V", zero) * F.col("omega")).alias("V"))


def elements_of(include, breakdown) -> list[Include]:
    population = None if include is None else as_include(include)
    if breakdown is None:
        return [population if population is not None else Include(())]
    if not isinstance(breakdown, Includes):
        breakdown = Includes(tuple(breakdown)) if isinstance(breakdown, list | tuple) else Includes((as_include(breakdown),))
    return [e if population is None else replace(Include(population.terms + e.terms), name=e.name, group_name=e.group_name) for e in breakdown]


def aev(data: ExpData, mortality, include=None, weight=None, val_relevance=None, val_distance=None, breakdown=None, settings: Settings | None = None, overdispersion=None, time_scale=None) -> Aev:
    return Aev(run_together(data, [spec(data, mortality, include, weight, val_relevance, val_distance, breakdown, settings, overdispersion, time_scale)]).drop("no"))


def kind_of(data: ExpData, n: E.Node) -> str:
    return typed(n, data.scope(F.col("t"))).kind


__all__ = ["Aev", "Measure", "PROPERTIES", "aev", "create_aev", "is_aev", "DOUBLE", "CLICKS"]
