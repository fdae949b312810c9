"""Linear models from sums of products: one distributed pass, small systems on the driver.

A pass yields X'X of all columns at once, so any number of models over subsets of columns
come from it. Fixed effects are absorbed inside it: sums of products by group are corrected
by the product of group sums over the group size, which equals demeaning, and needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions.tails import normal_p, student_p


@dataclass
class Gram:
    """Sums of products around the means (or around group means), of complete rows."""

    cols: list[str]
    n: int
    groups: int  # fixed-effect groups; 1 without fixed effects
    products: np.ndarray
    means: np.ndarray

    def of(self, a: list[str], b: list[str] | None = None) -> np.ndarray:
        at = {c: i for i, c in enumerate(self.cols)}
        return self.products[np.ix_([at[c] for c in a], [at[c] for c in (b or a)])]


def listwise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Complete rows only."""
    return df.na.drop(subset=cols)


def _sums(cols: list[str]) -> list:
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    d = lambda c: F.col(c).cast("double")
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(d(c)).alias(f"_s{i}") for i, c in enumerate(cols)], *[F.sum(d(cols[i]) * d(cols[j])).alias(f"_p{i}_{j}") for i, j in pairs]]


def _moments(row, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    s = np.array([row[f"_s{i}"] or 0.0 for i in range(k)])
    p = np.zeros((k, k))
    for i, j in combinations_with_replacement(range(k), 2):
        p[i, j] = p[j, i] = row[f"_p{i}_{j}"] or 0.0
    return row["_n"], s, p


def gram(df: DataFrame, cols: list[str], fe: str | None = None) -> Gram:
    rows, k = listwise(df, cols), len(cols)
    # shifted by the global means: sums of products then lose no digits to large means
    mean = rows.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()
    mean = [m or 0.0 for m in mean]
    rows = rows.select(*([fe] if fe else []), *[(F.col(c).cast("double") - F.lit(m)).alias(c) for c, m in zip(cols, mean, strict=True)])
    if fe is None:
        n, s, p = _moments(rows.agg(*_sums(cols)).first(), k)
        return Gram(cols, n, 1, p - np.outer(s, s) / max(n, 1), np.array(mean))
    by = rows.groupBy(fe).agg(*_sums(cols))
    fixed = [F.sum(F.col(f"_p{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("_n")).alias(f"_p{i}_{j}") for i, j in combinations_with_replacement(range(k), 2)]
    row = by.agg(F.sum("_n").alias("_n"), F.count("*").alias("_g"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)], *fixed).first()
    n, _, p = _moments(row, k)
    return Gram(cols, n or 0, row["_g"], p, np.array(mean))


def gram_by(df: DataFrame, cols: list[str], by: list[str]) -> dict[tuple, Gram]:
    """A Gram for each key, in one grouped pass; the keys are models (families, lags, layers), not items."""
    rows = listwise(df, cols).groupBy(*by).agg(*_sums(cols)).collect()
    out = {}
    for r in rows:
        n, s, p = _moments(r, len(cols))
        out[tuple(r[b] for b in by)] = Gram(cols, n, 1, p - np.outer(s, s) / max(n, 1), s / max(n, 1))
    return out


def partial_r(g: Gram, x: str, y: str, controls: list[str]) -> tuple[float, float, int]:
    """Correlation of x and y given controls (and fixed effects), its p, and n."""
    a = g.of([x, y])
    if controls:
        b = g.of([x, y], controls)
        a = a - b @ np.linalg.pinv(g.of(controls)) @ b.T
    if a[0, 0] <= 0 or a[1, 1] <= 0:
        return float("nan"), float("nan"), g.n
    r = float(a[0, 1] / math.sqrt(a[0, 0] * a[1, 1]))
    df = g.n - (len(controls) + g.groups) - 2
    return r, student_p(r * math.sqrt(df / max(1e-300, 1 - r * r)), df) if df > 0 else float("nan"), g.n


@dataclass
class Fit:
    cols: list[str]
    beta: np.ndarray
    se: np.ndarray
    p: np.ndarray
    r2: float
    n: int
    bread: np.ndarray


def ols(g: Gram, y: str, cols: list[str]) -> Fit:
    """Least squares with an intercept (or absorbed fixed effects); classical standard errors."""
    bread = np.linalg.pinv(g.of(cols))
    beta = bread @ g.of(cols, [y])[:, 0]
    total = float(g.of([y])[0, 0])
    rest = max(0.0, total - float(beta @ g.of(cols, [y])[:, 0]))
    df = g.n - len(cols) - g.groups
    se = np.sqrt(np.maximum(np.diag(bread) * rest / max(df, 1), 0))
    p = np.array([student_p(b / s, df) if s > 0 else float("nan") for b, s in zip(beta, se, strict=True)])
    return Fit(cols, beta, se, p, 1 - rest / total if total else float("nan"), g.n, bread)


def within(df: DataFrame, cols: list[str], fe: str | None) -> DataFrame:
    """Columns as deviations from the means (of their group): a second pass needs rows, not sums."""
    keep = [c for c in df.columns if c not in cols]
    if fe is None:
        means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
        rows = df.crossJoin(F.broadcast(means))  # one row
    else:
        means = df.groupBy(F.col(fe).alias("_fe")).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
        rows = df.join(means.hint("shuffle_hash"), F.col(fe).eqNullSafe(F.col("_fe")))
    return rows.select(*keep, *[(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(cols)])


def clustered(df: DataFrame, g: Gram, fit: Fit, y: str, cluster: str, fe: str | None = None) -> Fit:
    """``fit`` with standard errors robust to dependence inside clusters (CR1 factor, normal p)."""
    rows = within(listwise(df, [*g.cols]).select(*dict.fromkeys([*fit.cols, y, cluster, *([fe] if fe else [])])), [*fit.cols, y], fe)
    e = F.col(y)
    for c, b in zip(fit.cols, fit.beta, strict=True):
        e = e - F.col(c) * F.lit(float(b))
    k = len(fit.cols)
    scores = rows.withColumn("_e", e).groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("_e")).alias(f"_s{i}") for i, c in enumerate(fit.cols)])
    row = scores.agg(F.count("*").alias("_g"), *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"_p{i}_{j}") for i, j in combinations_with_replacement(range(k), 2)]).first()
    meat = np.zeros((k, k))
    for i, j in combinations_with_replacement(range(k), 2):
        meat[i, j] = meat[j, i] = row[f"_p{i}_{j}"]
    n_g, p = row["_g"], k + 1  # the intercept counts; absorbed effects nested in clusters do not
    factor = n_g / (n_g - 1) * (g.n - 1) / (g.n - p)
    se = np.sqrt(np.maximum(np.diag(fit.bread @ meat @ fit.bread) * factor, 0))
    return Fit(fit.cols, fit.beta, se, np.array([normal_p(b / s) if s > 0 else float("nan") for b, s in zip(fit.beta, se, strict=True)]), fit.r2, fit.n, fit.bread)


def dissociation(df: DataFrame, measures: list[str], targets: list[str], controls: list[str], samples: dict, fe: str | None = None) -> list[tuple]:
    """(sample, measure, target, r, p, n) of every combination: one Gram for each sample holds them all."""
    out = []
    for name, keep in samples.items():
        g = gram(df if keep is None else df.where(keep), [*measures, *targets, *controls], fe)
        out += [(name, m, t, *partial_r(g, m, t, controls)) for m in measures for t in targets]
    return out
