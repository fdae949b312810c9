"""Arithmetic on array columns. Cast to ``array<double>`` first with ``as_double``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def v_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def v_axpy(scale: Column | float, a: Column, b: Column) -> Column:
    """scale * a + b"""
    return F.zip_with(a, b, lambda x, y: x * scale + y)


def v_dot(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def v_norm(a: Column) -> Column:
    return F.when(a.isNotNull(), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)))


def v_scale(a: Column, scale: Column | float) -> Column:
    return F.transform(a, lambda x: x * scale)


def v_cos(a: Column, b: Column, eps: float = 0.0) -> Column:
    size = v_norm(a) * v_norm(b) + eps
    return F.when(size > 0, v_dot(a, b) / F.when(size > 0, size))


def v_angle(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Angle in radians; the cosine is clipped to -1..1 and its denominator raised by ``eps``."""
    cosine = v_dot(a, b) / (v_norm(a) * v_norm(b) + eps)
    return F.when(cosine.isNotNull(), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))  # least and greatest skip nulls


def v_unit(a: Column) -> Column:
    """``a`` at length one; null for a zero vector."""
    n = v_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / F.when(n > 0, n)))


def v_combine(vectors: list[Column], weights: list[float]) -> Column:
    """Weighted sum of vectors of one length in a single pass; null if one is null."""
    first, ok = vectors[0], F.lit(True)
    for v in vectors:
        ok = ok & v.isNotNull()

    def term(i: Column) -> Column:
        out = F.lit(0.0)
        for v, w in zip(vectors, weights, strict=True):
            out = out + F.get(v, i) * F.lit(float(w))
        return out

    return F.when(ok, F.transform(F.sequence(F.lit(0), F.size(first) - 1), term))


def extrapolation_weights(k: int, degree: int = 1) -> list[float]:
    """Weights (oldest first) that extrapolate the least-squares polynomial over k points by one step."""
    x = np.vander(np.arange(k), degree + 1, increasing=True).astype(float)
    at = np.power(float(k), np.arange(degree + 1))
    return [float(w) for w in at @ np.linalg.solve(x.T @ x, x.T)]


def slope_weights(k: int) -> list[float]:
    """Weights (oldest first) of the least-squares slope over k points."""
    x = np.arange(k) - (k - 1) / 2
    return [float(w) for w in x / (x @ x)]
