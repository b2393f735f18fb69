"""Quantiles of Student's t distribution, for confidence intervals of small samples."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist


def _upper_tail(t: float, df: int) -> float:
    """P(T > t) for t >= 0 by the finite trigonometric sums for integer df."""
    theta = math.atan(t / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    if df % 2:
        term, s = math.cos(theta), 0.0
        for k in range(1, df - 1, 2):
            s += term
            term *= c2 * (k + 1) / (k + 2)
        inside = 2 / math.pi * (theta + math.sin(theta) * s)
    else:
        term, s = 1.0, 0.0
        for k in range(0, df - 1, 2):
            s += term
            term *= c2 * (k + 1) / (k + 2)
        inside = math.sin(theta) * s
    return (1 - inside) / 2


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    """Inverse of the distribution function; beyond 500 degrees a normal expansion is exact enough."""
    z = NormalDist().inv_cdf(p)
    if df > 500:
        g1 = (z ** 3 + z) / 4
        g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
        return z + g1 / df + g2 / df ** 2
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if _upper_tail(mid, df) > 1 - p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
