"""Tail probabilities and small solvers for statistics that were summed in executors."""

from __future__ import annotations

import math

import numpy as np


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def signed_rank_p(w: float, n: int) -> float:
    """Two-sided p of the sum of positive ranks without ties: exact to n = 25, else normal with continuity."""
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    if n == 0:
        return 1.0
    if n <= 25:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        ways /= ways.sum()
        low, high = ways[: int(math.floor(w)) + 1].sum(), ways[int(math.ceil(w)) :].sum()
        return float(min(1.0, 2 * min(low, high)))
    return normal_p((abs(w - mean) - 0.5) / math.sqrt(var))


def signed_rank_ways(ranks: list[int]) -> np.ndarray:
    """How many of the sign patterns (as shares) give each sum of positive ranks; ``ranks`` are whole numbers."""
    ways = np.zeros(sum(ranks) + 1)
    ways[0], top = 1.0, 0
    for r in ranks:
        top += r
        ways[r : top + 1] = (ways[r : top + 1] + ways[: top + 1 - r]) / 2
        ways[:r] /= 2
    return ways


def signed_rank_tail(ways: np.ndarray, w: int, alternative: str = "two-sided") -> float:
    """p of a sum of positive ranks under a null distribution; ``greater`` asks for large sums, ``less`` for small ones."""
    low, high = float(ways[: w + 1].sum()), float(ways[w:].sum())
    return min(1.0, {"two-sided": 2 * min(low, high), "greater": high, "less": low}[alternative])


def signed_rank_normal(w: float, n: int, ties: float, alternative: str = "two-sided") -> float:
    """Normal approximation; ``ties`` is the sum of t^3 - t over groups of t equal sizes."""
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return {"two-sided": normal_p(z), "greater": math.erfc(z / math.sqrt(2)) / 2, "less": math.erfc(-z / math.sqrt(2)) / 2}[alternative]
