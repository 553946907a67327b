"""Distribution functions for a handful of test statistics."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def mann_kendall(s: float, variance: float) -> tuple[float, float, str]:
    """(z, two-sided p, verdict at 5 %) with continuity correction."""
    z = 0.0 if s == 0 or variance <= 0 else (s - math.copysign(1, s)) / math.sqrt(variance)
    p = 2 * (1 - normal_cdf(abs(z)))
    return z, p, "no significant trend" if p >= 0.05 else "increasing" if z > 0 else "decreasing"


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d, tiny = 1.0, 1.0, 0.0, 1e-300
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: int) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
