"""The vector kernels, on arrays of doubles: arguments of one length, or of length one, which is repeated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession


def _arrays(*xs) -> list[np.ndarray]:
    out = [np.atleast_1d(np.asarray(x, float)) for x in xs]
    sizes = {len(x) for x in out if len(x) != 1}
    if len(sizes) > 1:
        raise ValueError("arguments must have equal lengths, or length 1")
    return out


def _kernel(f, arity: int):
    def run(*xs):
        if len(xs) != arity:
            raise TypeError(f"{arity} arguments are needed")
        with np.errstate(all="ignore"):
            return f(*_arrays(*xs))

    return run


vec_neg = _kernel(np.negative, 1)
vec_exp = _kernel(np.exp, 1)
vec_expm1 = _kernel(np.expm1, 1)
vec_log = _kernel(np.log, 1)
vec_log1p = _kernel(np.log1p, 1)
vec_m_from_q = _kernel(lambda q: -np.log1p(-q), 1)
vec_add = _kernel(np.add, 2)
vec_sub = _kernel(np.subtract, 2)
vec_mul = _kernel(np.multiply, 2)
vec_div = _kernel(np.divide, 2)
vec_pow = _kernel(np.power, 2)
vec_min = _kernel(np.minimum, 2)
vec_max = _kernel(np.maximum, 2)
vec_clamp = _kernel(lambda x, low, high: np.minimum(np.maximum(x, low), high), 3)


def vec_active_tier(spark: SparkSession) -> str:
    """How expressions run: by generated code, or interpreted. The JVM picks vector instructions itself."""
    return "codegen" if spark.conf.get("spark.sql.codegen.wholeStage") == "true" else "interpreted"


def vec_active_lanes(spark: SparkSession) -> int:
    """Doubles a column function takes at once, as far as Spark shows: one."""
    return 1
