"""Student's t quantile (by bisection on the incomplete beta function) and critical values of the ESD test."""

from __future__ import annotations

import functools
import math


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def upper_tail(t: float, dof: float) -> float:
    return 0.5 * regularised_beta(dof / 2, 0.5, dof / (dof + t * t))


@functools.lru_cache(maxsize=1 << 16)
def t_quantile(tail: float, dof: float) -> float:
    """The t with an upper tail of ``tail``."""
    lo, hi = 0.0, 1.0
    while upper_tail(hi, dof) > tail:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper_tail(mid, dof) > tail else (lo, mid)
    return (lo + hi) / 2


@functools.lru_cache(maxsize=1 << 16)
def critical(m: int, alpha: float) -> float:
    """Of the removal that leaves m samples; infinite below two."""
    if m < 2:
        return math.inf
    t = t_quantile(alpha / (2 * (m + 1)), m - 1.0)
    return m * t / math.sqrt((m - 1 + t * t) * (m + 1))
