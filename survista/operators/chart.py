"""The frame behind an A/E chart: status, place on the axis, runs of groups. Drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survista.functions import ieee
from survista.operators.aev import PROPERTIES, Aev

LIMITS = (-0.5, 0.5)
STEP = 0.1
#: Sizes of a residual at which its colour starts, turns and is full.
RAMP = (0.5, 1.5, 3.0)


def status(limits: tuple[float, float] = LIMITS) -> Column:
    """ok, empty, missing or off_scale, judged by one standard deviation around log A/E."""
    a, e, v = F.col("A"), F.col("E"), F.col("V")
    centre, reach = ieee.log(ieee.div(a, e)), ieee.div(F.sqrt(v), e)
    on = ieee.compare(">=", centre + reach, ieee.lit(limits[0])) & ieee.compare("<=", centre - reach, ieee.lit(limits[1]))
    missing = F.isnan(a) | F.isnan(e) | F.isnan(v)
    empty = (a == 0) & (e == 0) & (v == 0)
    return F.when(missing, "missing").when(empty, "empty").when(~on, "off_scale").otherwise("ok")


def plot_frame(x: Aev, limits: tuple[float, float] = LIMITS) -> DataFrame:
    df = x.df.withColumns({p: f() for p, f in PROPERTIES.items()}).withColumn("status", status(limits))
    log_ratio = F.col("log_A_over_E")
    df = df.withColumns({
        "clamped": ieee.clamp(log_ratio, ieee.lit(limits[0]), ieee.lit(limits[1])),
        "name": F.coalesce("name", F.col("ord").cast("string")),
        "chevron": F.when((F.col("status") == "off_scale") & ieee.compare(">", log_ratio, ieee.lit(limits[1])), "up").when((F.col("status") == "off_scale") & ieee.compare("<", log_ratio, ieee.lit(limits[0])), "down"),
        "ramp": residual_ramp(F.col("deviance_residual")),
    })
    return df.withColumn("group_run", group_run())


def group_run() -> Column:
    """Number of the run of consecutive records with one group. Records are few: one per element."""
    order = Window.orderBy("ord")
    new = ~F.col("group").eqNullSafe(F.lag("group").over(order)) | (F.row_number().over(order) == 1)
    return F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))


def residual_ramp(z: Column) -> Column:
    """0 to 1 between the first two sizes of RAMP, 1 to 2 between the last two."""
    size = F.abs(z)
    part = lambda low, high: ieee.clamp((size - low) / (high - low), ieee.lit(0.0), ieee.lit(1.0))
    return part(RAMP[0], RAMP[1]) + part(RAMP[1], RAMP[2])


def check_scale(limits: tuple[float, float], step: float) -> None:
    low, high = limits
    if not low < high:
        raise ValueError("the range must be two increasing numbers")
    if max(abs(low), abs(high)) >= 1:
        raise ValueError("the range must lie within -1 and 1")
    if not step > 0:
        raise ValueError("the step must be above 0")
    if any(abs(v / step - round(v / step)) >= 1e-8 for v in limits):
        near = (math.floor(low / step) * step, math.ceil(high / step) * step)
        raise ValueError(f"the step must divide both ends of the range; {near[0]:g} to {near[1]:g} would do")


def breaks(limits: tuple[float, float] = LIMITS, step: float = STEP) -> list[float]:
    """Grid lines of log A/E, ends exact."""
    check_scale(limits, step)
    n = round((limits[1] - limits[0]) / step)
    return [limits[0], *[limits[0] + step * k for k in range(1, n)], limits[1]]
