"""Small symmetric systems: Cholesky with a test of pivots, and the dependency where one fails."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOLERANCE = 1e-7


@dataclass(frozen=True)
class Dependent:
    """Column `at` is, as near as can be told, the combination `of` of those before it."""

    at: int
    of: np.ndarray


def cholesky(a: np.ndarray) -> np.ndarray | Dependent:
    """The lower factor, or the first column whose pivot is not above TOLERANCE times its diagonal."""
    n = len(a)
    low = np.zeros((n, n))
    for j in range(n):
        pivot = a[j, j] - low[j, :j] @ low[j, :j]
        if not pivot > 0 or pivot < TOLERANCE * a[j, j]:
            of = np.linalg.solve(a[:j, :j], a[:j, j]) if j else np.zeros(0)
            return Dependent(j, of)
        low[j, j] = np.sqrt(pivot)
        low[j + 1 :, j] = (a[j + 1 :, j] - low[j + 1 :, :j] @ low[j, :j]) / low[j, j]
    return low


def solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = b.astype(float).copy()
    for i in range(len(low)):
        y[i] = (y[i] - low[i, :i] @ y[:i]) / low[i, i]
    for i in reversed(range(len(low))):
        y[i] = (y[i] - low[i + 1 :, i] @ y[i + 1 :]) / low[i, i]
    return y
