"""Doubles as IEEE has them, on Spark columns: NaN is the only missing value and never equals anything,
logs of zero and less are -Inf and NaN, division by zero is no error, minima and maxima propagate NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def nan_if_null(x: Column) -> Column:
    return F.coalesce(x.cast("double"), lit(NAN))


def div(x: Column, y: Column) -> Column:
    # pow(0, -1) is Inf of the zero's sign, and the product gives 0/0 its NaN
    return F.when(y != 0, x / y).otherwise(x * F.pow(y, lit(-1.0)))


def floor(x: Column) -> Column:
    """floor() as double; whole numbers beyond 2**53 and non-finite ones are their own floor."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def ceiling(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**53, F.ceil(x).cast("double")).otherwise(x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceiling(x)).otherwise(floor(x))


def floor_div(x: Column, y: Column) -> Column:
    return floor(div(x, y))


def mod(x: Column, y: Column) -> Column:
    return x - floor_div(x, y) * y


def power(x: Column, y: Column) -> Column:
    """1 to any power and anything to the power 0 are 1, NaN included; (-1) ** +-Inf is 1."""
    one = (x == 1) | (y == 0) | ((x == -1) & (F.abs(y) == lit(INF)))
    return F.when(one, lit(1.0)).otherwise(F.pow(x, y))


def _log(f, low: float):
    return lambda x: F.when(F.isnan(x), lit(NAN)).when(x > low, f(x)).when(x == low, lit(-INF)).otherwise(lit(NAN))


log = _log(F.ln, 0.0)
log10 = _log(F.log10, 0.0)
log1p = _log(F.log1p, -1.0)


def _lowest(x: Column, y: Column, least: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), lit(NAN)).otherwise(least)


def minimum(x: Column, y: Column) -> Column:
    # -0 counts as less than 0: their sum has the sign that is asked for only when both are zeros
    zero = (x == 0) & (y == 0)
    return _lowest(x, y, F.when(zero, F.when(_negative(x), x).otherwise(y)).otherwise(F.least(x, y)))


def maximum(x: Column, y: Column) -> Column:
    zero = (x == 0) & (y == 0)
    return _lowest(x, y, F.when(zero, F.when(_negative(x), y).otherwise(x)).otherwise(F.greatest(x, y)))


def _negative(x: Column) -> Column:
    """Whether a zero is -0, as its inverse tells."""
    return F.pow(x, lit(-1.0)) < 0


def clamp(x: Column, low: Column, high: Column) -> Column:
    return minimum(maximum(x, low), high)


def m_from_q(q: Column) -> Column:
    return -log1p(-q)


def _known(x: Column, y: Column) -> Column:
    return ~F.isnan(x) & ~F.isnan(y)


def compare(op: str, x: Column, y: Column) -> Column:
    known = _known(x, y)
    if op == "!=":
        return ~known | (x != y)
    test = {"==": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return known & test
