"""Experience data: lives observed over half-open spans, trimmed to a period; and lives at one instant."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survista.functions.clicks import FIRST, LAST, LONGEST, Instant, instant
from survista.plans.columns import BOOL, DOUBLE, INSTANT, SPAN, TEXT, Scope

SPECIAL = ("birth", "E2R_start", "E2R_end", "E2R_died", "count", "uid")
E2R = ("E2R_start", "E2R_end", "E2R_died")


class DataError(ValueError):
    """Data that break a rule of experience data."""


def as_times(df: DataFrame, instants: list[str] = (), spans: list[str] = ()) -> DataFrame:
    """Mark whole-number columns as instants or spans, in clicks."""
    mark = {c: "instant" for c in instants} | {c: "span" for c in spans}
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c, metadata={"kind": mark[c]}) if c in mark else F.col(f"`{c}`") for c in df.columns])


def _kind(f: T.StructField) -> str | None:
    marked = (f.metadata or {}).get("kind")
    if marked in (INSTANT, SPAN):
        return marked
    if isinstance(f.dataType, T.BooleanType):
        return BOOL
    if isinstance(f.dataType, T.StringType):
        return TEXT
    if isinstance(f.dataType, T.NumericType):
        return DOUBLE
    return None


def _check_names(names: list[str], needed: tuple[str, ...], barred: tuple[str, ...]) -> None:
    if len(set(names)) != len(names):
        raise DataError("column names must be distinct")
    for n in names:
        if not n or "." in n:
            raise DataError(f"{n!r} is no column name: it is empty or holds a full stop")
        if n.lower() == "e2r":
            raise DataError("a column may not be called e2r")
        for s in SPECIAL:
            if n.lower() == s.lower() and n != s:
                raise DataError(f"{n} must be written {s}")
    for n in needed:
        if n not in names:
            raise DataError(f"the column {n} is missing")
    for n in barred:
        if n in names:
            raise DataError(f"the column {n} does not belong here")


def _clean(df: DataFrame, needed: tuple[str, ...], on_unreadable: str) -> tuple[DataFrame, dict[str, str]]:
    """Columns of the kinds the engine knows: numbers as doubles with NaN for null, times as clicks."""
    kinds, out = {}, []
    for f in df.schema.fields:
        kind = _kind(f)
        if f.name in ("birth", "E2R_start", "E2R_end") and kind != INSTANT:
            raise DataError(f"{f.name} must be a column of instants, see as_times()")
        if f.name == "E2R_died" and kind != BOOL:
            raise DataError("E2R_died must be a column of truth values")
        if f.name == "uid":
            out.append(F.col("uid"))
            continue
        if kind is None:
            if on_unreadable == "error":
                raise DataError(f"{f.name} has a type that cannot be read: {f.dataType.simpleString()}")
            if on_unreadable == "warn":
                import warnings

                warnings.warn(f"{f.name} cannot be read in expressions", stacklevel=4)
            out.append(F.col(f"`{f.name}`"))
            continue
        c = F.col(f"`{f.name}`")
        if kind == DOUBLE:
            c = F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(f.name)
        kinds[f.name] = kind
        out.append(c)
    return df.select(*out), kinds


def _violations(df: DataFrame, kinds: dict[str, str], dated: bool) -> dict[str, Column]:
    bad = {}
    for c, kind in kinds.items():
        col = F.col(f"`{c}`")
        if kind in (BOOL, TEXT):
            bad[f"{c} has missing values"] = col.isNull()
        if c in ("birth", "E2R_start", "E2R_end"):
            bad[f"{c} has missing values"] = ~F.coalesce(col.between(FIRST, LAST), F.lit(False))
    if "count" in kinds:
        bad["count has values that are missing, infinite or below 0"] = F.isnan("count") | (F.col("count") < 0) | (F.col("count") == float("inf"))
    if dated:
        bad["E2R_start is after E2R_end"] = F.col("E2R_start") > F.col("E2R_end")
        bad["a death has an empty E2R"] = (F.col("E2R_start") == F.col("E2R_end")) & F.col("E2R_died")
    return bad


def _verify(df: DataFrame, kinds: dict[str, str], dated: bool) -> None:
    """All rules in one pass over the columns that have any."""
    bad = _violations(df, kinds, dated)
    if not bad:
        return
    found = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"v{k}") for k, c in enumerate(bad.values())]).first()
    for (what, _), n in zip(bad.items(), found, strict=True):
        if n:
            raise DataError(f"{what} ({n} rows)")


@dataclass(frozen=True)
class _Table:
    df: DataFrame
    kinds: dict

    def scope(self, t: Column | None = None) -> Scope:
        return Scope({k: v for k, v in self.kinds.items() if k not in (*E2R, "count")}, t)


@dataclass(frozen=True)
class ExpData(_Table):
    """Lives with birth, E2R_start, E2R_end, E2R_died, trimmed to [exp_start, exp_end)."""

    exp_start: Instant
    exp_end: Instant

    def with_column(self, name: str, column: Column, verify: bool = True) -> ExpData:
        if name in E2R:
            return exp_data(self.df.withColumn(name, column), self.exp_start, self.exp_end, verify=verify)
        df, kinds = _clean(self.df.withColumn(name, column), (), "error")
        _check_names(df.columns, (), ())
        if verify:
            _verify(df, {name: kinds[name]} if name in kinds else {}, False)
        return replace(self, df=df, kinds=kinds)

    def __repr__(self):
        return f"ExpData [{self.exp_start.years:g}, {self.exp_end.years:g}) {', '.join(f'{k}: {v}' for k, v in self.kinds.items())}"


@dataclass(frozen=True)
class ValData(_Table):
    """Lives at the instant as_at."""

    as_at: Instant

    def with_column(self, name: str, column: Column, verify: bool = True) -> ValData:
        return val_data(self.df.withColumn(name, column), self.as_at, verify=verify)

    def __repr__(self):
        return f"ValData at {self.as_at.years:g} {', '.join(f'{k}: {v}' for k, v in self.kinds.items())}"


def exp_data(df: DataFrame, exp_start, exp_end, on_unreadable: str = "error", verify: bool = True) -> ExpData:
    """Check and trim. verify=False leaves out the pass over the data that checks values."""
    start, end = instant(exp_start), instant(exp_end)
    if not start < end:
        raise DataError("exp_start must be before exp_end")
    _check_names(df.columns, ("birth", *E2R), ())
    df, kinds = _clean(df, ("birth", *E2R), on_unreadable)
    if verify:
        _verify(df, kinds, True)
    if "count" in kinds:
        df = df.where("count <> 0")
    keep = F.col("E2R_end") <= end.clicks
    new = {
        "E2R_start": F.greatest(F.col("E2R_start"), F.lit(start.clicks)),
        "E2R_end": F.when(keep, F.col("E2R_end")).otherwise(F.lit(end.clicks)),
        "E2R_died": keep & F.col("E2R_died"),
    }
    df = df.withColumns(new).where(F.col("E2R_start") < F.col("E2R_end"))
    return ExpData(as_times(df, ["E2R_start", "E2R_end"]), kinds, start, end)


def val_data(df: DataFrame, as_at, on_unreadable: str = "error", verify: bool = True) -> ValData:
    _check_names(df.columns, ("birth",), E2R)
    df, kinds = _clean(df, ("birth",), on_unreadable)
    if verify:
        _verify(df, kinds, False)
    return ValData(df.where("count <> 0") if "count" in kinds else df, kinds, instant(as_at))


def val_from_exp_data(data: ExpData, as_at=None) -> ValData:
    """Who was alive and observed at as_at (by default the period's end, where survivors count)."""
    at = data.exp_end if as_at is None else instant(as_at)
    if not data.exp_start <= at <= data.exp_end:
        raise DataError("as_at is outside the period of the data")
    t = F.lit(at.clicks)
    there = ((F.col("E2R_start") <= t) & (t < F.col("E2R_end"))) | ((F.col("E2R_end") == t) & ~F.col("E2R_died"))
    return ValData(data.df.where(there).drop(*E2R), {k: v for k, v in data.kinds.items() if k not in E2R}, at)


def is_exp_data(x) -> bool:
    return isinstance(x, ExpData)


def is_val_data(x) -> bool:
    return isinstance(x, ValData)


def exp_start(x: ExpData) -> Instant:
    return x.exp_start


def exp_end(x: ExpData) -> Instant:
    return x.exp_end


def as_at(x: ValData) -> Instant:
    return x.as_at


def stats(data: _Table, names: list[str] | None = None) -> dict[str, dict]:
    """Per readable column: whether values are missing or present, whether it is constant, least and greatest."""
    names = [n for n in (names or data.kinds) if data.kinds[n] in (DOUBLE, INSTANT, SPAN, BOOL)]
    if not names:
        return {}
    aggs = []
    for k, n in enumerate(names):
        c = F.col(f"`{n}`").cast("double") if data.kinds[n] in (DOUBLE, BOOL) else F.col(f"`{n}`")
        ok = F.when(~F.isnan(c), c) if data.kinds[n] == DOUBLE else c
        aggs += [F.min(ok).alias(f"l{k}"), F.max(ok).alias(f"h{k}"), F.count(ok).alias(f"n{k}"), F.count(F.lit(1)).alias(f"a{k}")]
    r = data.df.agg(*aggs).first()
    return {n: {"min": r[f"l{k}"], "max": r[f"h{k}"], "has_values": r[f"n{k}"] > 0, "has_missing": r[f"n{k}"] < r[f"a{k}"], "constant": r[f"n{k}"] > 0 and r[f"l{k}"] == r[f"h{k}"]} for k, n in enumerate(names)}


__all__ = ["DataError", "ExpData", "ValData", "LONGEST", "as_at", "as_times", "exp_data", "exp_end", "exp_start", "is_exp_data", "is_val_data", "stats", "val_data", "val_from_exp_data"]
