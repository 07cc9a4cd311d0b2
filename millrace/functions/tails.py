"""Tail probabilities of the normal, t, F and chi-square laws.

Spark has no such functions. They run on a handful of aggregated rows (one per test).
The incomplete beta and gamma ratios use their continued fractions and power series
(Abramowitz & Stegun 6.5 and 26.5).
"""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-15


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _fraction(step, limit: int = 10_000) -> float:
    """Evaluate b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz scheme; step(k) -> (a, b)."""
    _, value = step(0)
    value = value or _TINY
    c, d = value, 0.0
    for k in range(1, limit):
        a, b = step(k)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return value


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_ratio(b, a, 1.0 - x)

    def step(k: int) -> tuple[float, float]:
        if k == 0:
            return 0.0, 1.0
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    return min(1.0, front / (a * _fraction(step)))


def upper_gamma_ratio(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)

    def step(k: int) -> tuple[float, float]:
        return (0.0 if k == 0 else -k * (k - a)), x + 2 * k + 1.0 - a

    return front / _fraction(step)


def student_two_sided(t: float, df: float) -> float:
    return beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def fisher_upper(f: float, df1: float, df2: float) -> float:
    return beta_ratio(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi_square_upper(value: float, df: float) -> float:
    return upper_gamma_ratio(df / 2.0, value / 2.0)


def exact_rank_two_sided(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p of the Mann-Whitney U without ties.

    The counts of U are the coefficients of the Gaussian binomial (n1+n2 over n1), built
    with exact integers factor by factor: times (1 - q^(n2+i)), divided by (1 - q^i).
    """
    size = n1 * n2 + 1
    counts = [0] * size
    counts[0] = 1
    for i in range(1, n1 + 1):
        for k in range(size - 1, n2 + i - 1, -1):
            counts[k] -= counts[k - n2 - i]
        for k in range(i, size):
            counts[k] += counts[k - i]
    top = max(u, n1 * n2 - u)
    upper = sum(counts[math.ceil(top):])
    return min(1.0, 2.0 * upper / math.comb(n1 + n2, n1))
