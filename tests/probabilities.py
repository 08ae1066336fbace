"""Probabilities of the tests in plain Python, to hold the column expressions against.

The t probability is the incomplete beta function by its continued fraction, the
normal one comes from the standard library, so neither shares a method with the library.
"""

import math
from statistics import NormalDist

from runlens.functions.pvalues import (
    LARGE_LOG_SD,
    LARGE_MEAN,
    LAST_WEIGHT,
    NEXT_WEIGHT,
    SMALL_GAMMA,
    SMALL_LOG_SD,
    SMALL_MEAN,
)

_NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    fraction = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            fraction *= step
        if abs(step - 1.0) < 1e-16:
            break
    return front * fraction / a


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def signed_rank_exact(v: float, n: int) -> float:
    """Two-sided exact probability by counting the subsets of 1..n per rank sum."""
    top = n * (n + 1) // 2
    ways = [1] + [0] * top
    for rank in range(1, n + 1):
        for total in range(top, rank - 1, -1):
            ways[total] += ways[total - rank]
    low = sum(ways[: int(v) + 1])
    high = sum(ways[int(v) :])
    return min(1.0, 2.0 * min(low, high) / 2.0**n)


def signed_rank_normal(v: float, n: int, tie_sum: float) -> float:
    """Two-sided normal probability with tie variance and continuity correction."""
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - tie_sum / 48.0
    if variance <= 0:
        return math.nan
    gap = v - n * (n + 1) / 4.0
    z = (gap - math.copysign(0.5, gap) * (gap != 0)) / math.sqrt(variance)
    return 2.0 * min(_NORMAL.cdf(z), _NORMAL.cdf(-z))


def _poly(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_weights(n: int) -> list[float]:
    """Weights of the upper half of the ordered sample, largest first."""
    half = n // 2
    if n == 3:
        return [math.sqrt(0.5)]
    m = [_NORMAL.inv_cdf((n - i - 0.375) / (n + 0.25)) for i in range(half)]
    norm = 2.0 * sum(v * v for v in m)
    root, u = math.sqrt(norm), 1.0 / math.sqrt(n)
    fixed = [m[0] / root + _poly(LAST_WEIGHT, u)]
    if n > 5:
        fixed.append(m[1] / root + _poly(NEXT_WEIGHT, u))
    k = len(fixed)
    phi = (norm - 2.0 * sum(v * v for v in m[:k])) / (1.0 - 2.0 * sum(a * a for a in fixed))
    return fixed + [v / math.sqrt(phi) for v in m[k:]]


def shapiro(ordered) -> tuple[float, float]:
    """W and its probability for an ascending sample of 3 to 5000 values."""
    n = len(ordered)
    if not 3 <= n <= 5000 or ordered[-1] - ordered[0] < 1e-19:
        return math.nan, math.nan
    mean = math.fsum(ordered) / n
    spread = math.fsum((x - mean) ** 2 for x in ordered)
    weights = shapiro_weights(n)
    contrast = math.fsum(a * (ordered[n - 1 - i] - ordered[i]) for i, a in enumerate(weights))
    w = min(1.0, contrast * contrast / spread)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if w >= 1.0:
        return w, 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean_y, sd_y = _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        ln = math.log(n)
        mean_y, sd_y = _poly(LARGE_MEAN, ln), math.exp(_poly(LARGE_LOG_SD, ln))
    return w, _NORMAL.cdf(-(y - mean_y) / sd_y)
