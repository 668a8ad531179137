"""Distribution functions for the tests' p-values, in plain Python on single numbers."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def incomplete_gamma_upper(a: float, x: float) -> float:
    """Regularised Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        c = b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _unit(p: float) -> float:
    return min(1.0, max(0.0, p))


def t_two_sided(t: float, df: float) -> float:
    """p of Student's t on both sides; infinite t: 0, no degrees of freedom: 1."""
    if df <= 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    return _unit(incomplete_beta(df / 2, 0.5, df / (df + t * t)))


def t_critical(alpha: float, df: float) -> float:
    """t whose two-sided p is alpha; no degrees of freedom: 0."""
    if df <= 0:
        return 0.0
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > alpha:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > alpha else (low, mid)
    return (low + high) / 2


def chi_square_upper(x: float, df: float) -> float:
    """p of a chi-square statistic; no degrees of freedom: 1."""
    return 1.0 if df <= 0 else _unit(incomplete_gamma_upper(df / 2, x / 2))


def interpretation(p: float) -> str:
    return "significant" if p < 0.05 else "not significant"


def nice_number(x: float, rounded: bool) -> float:
    """Heckbert's nice number near x (rounded) or not below it."""
    if x <= 0:
        return 0.0
    exponent = math.floor(math.log10(x))
    f = x / 10**exponent
    steps = ((1.5, 1), (3, 2), (7, 5)) if rounded else ((1, 1), (2, 2), (5, 5))
    nice = next((v for limit, v in steps if (f < limit if rounded else f <= limit)), 10)
    return nice * 10.0**exponent
