"""Quantiles of the chi-squared distribution, by bisection on the regularised incomplete gamma function."""

from __future__ import annotations

import math


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300  # continued fraction
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi_squared_quantile(p: float, df: float) -> float:
    low, high = 0.0, max(1.0, df)
    while gamma_p(df / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(df / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2
