"""Tail probabilities for the few tests reported to users (driver-side scalars)."""

from __future__ import annotations

import math


def kolmogorov_p(statistic: float, n_first: int, n_second: int) -> float:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    size = n_first * n_second / (n_first + n_second)
    x = math.sqrt(size) * statistic
    if x < 1e-3:
        return 1.0
    if x < 1.18:  # theta-function form converges fast for small x
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 21))
        return max(0.0, min(1.0, 1.0 - math.sqrt(2 * math.pi) / x * total))
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return max(0.0, min(1.0, 2 * total))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value / a


def student_t_p(t: float, degrees: int) -> float:
    """Two-sided p-value of a t statistic."""
    return incomplete_beta(degrees / 2, 0.5, degrees / (degrees + t * t))
