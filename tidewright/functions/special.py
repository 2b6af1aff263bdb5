"""Quantiles that Spark lacks, for driver-side tables of a bounded number of distinct arguments."""

from __future__ import annotations

import math
from statistics import NormalDist


def z_of(level: float) -> float:
    """The two-sided normal quantile of a confidence level."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def beta_quantile(q: float, a: float, b: float) -> float:
    """By bisection, to the last bits."""
    lo, hi = 0.0, 1.0
    while True:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            return mid
        if incomplete_beta(a, b, mid) < q:
            lo = mid
        else:
            hi = mid


def jeffreys(k: int, n: int, level: float) -> tuple[float, float]:
    """Equal-tailed interval of Beta(k + 1/2, n - k + 1/2), from 0 at k = 0 and to 1 at k = n."""
    tail = (1 - level) / 2
    a, b = k + 0.5, n - k + 0.5
    return (0.0 if k == 0 else beta_quantile(tail, a, b)), (1.0 if k == n else beta_quantile(1 - tail, a, b))
