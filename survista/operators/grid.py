"""The time grid: full steps at their midpoints from the start of a span, then what is left at its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.functions.clicks import PER_CLICK, halve, halve_int


def slots_of(nu: int, tau: int, step: int) -> list[tuple[int, int]]:
    """(time, width) in clicks of the slots of one span."""
    n, rest = divmod(tau - nu, step)
    out = [(nu + step // 2 + k * step, step) for k in range(n)]
    return out + ([(halve_int(nu + n * step + tau), rest)] if rest else [])


def explode_slots(df: DataFrame, step: int, nu: str = "nu", tau: str = "tau", slot: str = "k") -> DataFrame:
    """A row a slot, with t and width in clicks. Rows come from a generator, so they are never shuffled."""
    span = F.col(tau) - F.col(nu)
    last = F.floor((span - 1) / F.lit(step)).cast("long")
    df = df.withColumn(slot, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col(nu) + F.col(slot) * F.lit(step)
    end = F.least(begin + F.lit(step), F.col(tau))
    return df.withColumns({"t": halve(begin + end), "width": end - begin})


def affine_integral(a: Column, c: Column, nu: Column, tau: Column, step: int) -> Column:
    """Sum of exp(a + c t) * width over the grid's slots, t and width in years, without listing them.

    The full steps are a geometric series: exp at the first midpoint times expm1(n c h) / expm1(c h).
    """
    h = step * PER_CLICK
    span = tau - nu
    n = F.floor(span / F.lit(step)).cast("long")
    rest = span - n * F.lit(step)
    first = (nu + F.lit(step // 2)).cast("double") * PER_CLICK
    ratio = c * ieee.lit(h)
    count = n.cast("double")
    small = F.abs(ratio * count) < 1e-12
    series = F.when(small | (count <= 1), count).otherwise(F.expm1(ratio * count) / F.expm1(ratio))
    full = F.when(n > 0, F.exp(a + c * first) * series).otherwise(ieee.lit(0.0))
    middle = halve(nu + n * F.lit(step) + tau).cast("double") * PER_CLICK
    tail = F.when(rest > 0, F.exp(a + c * middle) * (rest.cast("double") * PER_CLICK)).otherwise(ieee.lit(0.0))
    return ieee.lit(h) * full + tail


def integrate(f, nu: int, tau: int, step: int) -> float:
    """The same rule for one span and a Python function of the time in clicks."""
    return math.fsum(f(t) * w * PER_CLICK for t, w in slots_of(nu, tau, step))
