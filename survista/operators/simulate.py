"""Experience simulated from a mortality: a life dies where its hazard, summed over the grid, reaches -log U."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.functions.clicks import CLICKS, PER_CLICK, halve, instant, mid_day_column
from survista.operators.mortality import mortality
from survista.operators.settings import time_step
from survista.plans import expr as E
from survista.plans.columns import Scope, number
from survista.sources.data import DataError, ExpData, _clean, as_times, exp_data


def hash_uniform(seed: int, *key: Column) -> Column:
    """A uniform on (0, 1), the same for a life wherever and whenever it is computed."""
    h = F.xxhash64(F.lit(seed).cast("long"), *key)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def simulate(m, lives: DataFrame, exp_start, exp_end, nsim: int = 1, seed: int = 0, time_scale=None, uniform: Column | None = None, key: str = "uid") -> ExpData:
    """Experience of `lives` (birth, perhaps E2R_start and E2R_cap, facts, and a distinct `key`), nsim times (sim, from 1).

    Deaths are recorded at midday of their day, within the life's span. Where the log hazard is affine in time the slot of
    death is solved for, else a life walks its own grid inside its row: no slot becomes a row, and nothing is shuffled.
    """
    m, step = mortality(m), time_step(time_scale)
    start, end = instant(exp_start), instant(exp_end)
    if not start < end:
        raise DataError("exp_start must be before exp_end")
    for c in ("E2R_end", "E2R_died"):
        if c in lives.columns:
            raise DataError(f"{c} is what is simulated")
    if key not in lives.columns:
        raise DataError(f"the lives need a distinct {key}")
    df, kinds = _clean(lives, ("birth",), "error")
    bound = lambda c, limit, f: f(F.coalesce(F.col(c), F.lit(limit)), F.lit(limit)) if c in df.columns else F.lit(limit)
    df = df.withColumns({"nu": bound("E2R_start", start.clicks, F.greatest).cast("long"), "tau": bound("E2R_cap", end.clicks, F.least).cast("long")})
    df = df.drop("E2R_start", "E2R_cap").where("nu < tau")
    df = df.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(nsim)))) if nsim != 1 else df.withColumn("sim", F.lit(1))
    u = uniform if uniform is not None else hash_uniform(seed, F.col("sim"), F.col(key))
    df = df.withColumn("target", -F.ln(u))
    facts = [c for c in df.columns if c not in ("nu", "tau", "target")]
    pair = E.affine_in_t(m.as_node())
    out = let(df, at=_walked(m, kinds, step)) if pair is None else _solved(df, *(number(n, Scope(kinds, None)) for n in pair), step)
    midday = mid_day_column(F.col("at"))
    death = F.least(F.when(midday <= F.col("nu"), F.col("at")).otherwise(midday), F.col("tau"))
    out = out.withColumns({"E2R_start": F.col("nu"), "E2R_end": F.coalesce(death, F.col("tau")), "E2R_died": F.col("at").isNotNull()}).select(*facts, "E2R_start", "E2R_end", "E2R_died")
    times = [c for c in facts if kinds.get(c) == "instant"] + ["E2R_start", "E2R_end"]
    return exp_data(as_times(out, times, [c for c in facts if kinds.get(c) == "span"]), start, end, verify=False)


def _walked(m, kinds: dict, step: int) -> Column:
    """Where the summed hazard of a life's grid reaches its target, slot by slot; null where it does not."""
    last = F.floor((F.col("tau") - F.col("nu") - 1) / F.lit(step)).cast("long")

    def walk(acc: Column, k: Column) -> Column:
        """The hazard up to the end of slot k, and where it reached the target."""
        begin = F.col("nu") + k * F.lit(step)
        end = F.least(begin + F.lit(step), F.col("tau"))
        width = (end - begin).cast("double")
        gained = F.exp(number(m.as_node(), Scope(kinds, halve(begin + end)))) * width * PER_CLICK
        hazard = acc["hazard"] + gained
        at = F.rint(begin.cast("double") + (F.col("target") - (hazard - gained)) / gained * width).cast("long")
        return F.struct(hazard.alias("hazard"), F.coalesce(acc["at"], F.when(hazard >= F.col("target"), at)).alias("at"))

    first = F.struct(F.lit(0.0).cast("double").alias("hazard"), F.lit(None).cast("long").alias("at"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), last), first, walk)["at"]


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once: they come from a generator of one row, which what reads them below is not
    merged with."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select(*[F.col(f"`{c}`") for c in df.columns], made).select(*[F.col(f"`{c}`") for c in df.columns], "_made.*")


def _solved(df: DataFrame, a: Column, c: Column, step: int) -> DataFrame:
    """df with `at`, the same for a hazard exp(a + c t): over full steps its sum is a geometric series, solved for the step that
    reaches the target; then comes the rest of the span."""
    nu, tau, target = F.col("nu"), F.col("tau"), F.col("target")
    h = step * PER_CLICK
    columns = df.columns
    n = F.floor((tau - nu) / F.lit(step)).cast("long")
    df = let(df, _a=a, _c=c, _n=n, _rest=(tau - nu) - n * F.lit(step), _base=ieee.lit(h) * F.exp(a + c * ((nu + F.lit(step // 2)).cast("double") * PER_CLICK)))
    a, c, n, rest, base = (F.col(x) for x in ("_a", "_c", "_n", "_rest", "_base"))
    ratio = c * ieee.lit(h)
    flat = F.abs(ratio) < 1e-12
    summed = lambda k: base * F.when(flat, k).otherwise(F.expm1(ratio * k) / F.expm1(ratio))
    df = let(df, _steps=F.coalesce(F.when(flat, target / base).otherwise(F.log1p(target / base * F.expm1(ratio)) / ratio), ieee.lit(float("inf"))))
    df = let(df, _k=F.when(F.col("_steps") > n, n).otherwise(F.greatest(F.ceil("_steps") - 1, F.lit(0))).cast("double"))
    k = F.col("_k")
    # a step off where rounding says so
    df = let(df, _l=F.when((k > 0) & (summed(k) >= target), k - 1).when((k < n) & (summed(k + 1) < target), k + 1).otherwise(k))
    k = F.col("_l")
    whole = k < n
    middle = halve(nu + n * F.lit(step) + tau).cast("double") * PER_CLICK
    df = let(df, _gained=F.when(whole, base * F.exp(ratio * k)).otherwise(F.exp(a + c * middle) * (rest.cast("double") * PER_CLICK)), _before=summed(k))
    gained, before = F.col("_gained"), F.col("_before")
    width = F.when(whole, ieee.lit(float(step))).otherwise(rest.cast("double"))
    at = F.rint(nu.cast("double") + k * F.lit(float(step)) + (target - before) / gained * width).cast("long")
    return let(df, at=F.when(whole | ((rest > 0) & (before + gained >= target)), at)).select(*[F.col(f"`{x}`") for x in columns], "at")


YEAR = CLICKS
