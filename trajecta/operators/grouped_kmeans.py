"""K-means for many groups at once: folds, layers and restarts are models of one job.

A row says in which models it takes part. Every round is one pass over the rows: a task keeps
sums for each (model, centroid) and sends them on, so neither folds nor layers nor restarts
multiply the passes or are looped over. Centroids (models x k x dimensions) travel with the
tasks and come back to the driver; rows don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trajecta.operators.aggregates import quantiles


@dataclass
class GroupedCentroids:
    """Of each model: centroids (k x d), the bandwidth, the sum of squared distances and the rows it was fitted on."""

    centroids: np.ndarray
    sigma: np.ndarray
    cost: np.ndarray
    n: np.ndarray


def _vectors(b: pa.RecordBatch, name: str = "v") -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)


def _members(b: pa.RecordBatch, models: int) -> np.ndarray:
    """rows x models: whether a row takes part."""
    lists = b.column("m")
    out = np.zeros((b.num_rows, models), dtype=bool)
    out[np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def start_vectors(rows: DataFrame, models: int, k: int, seed: int, sample: int) -> np.ndarray:
    """First centroids by k-means++ on a sample of ``sample`` rows, the same for the same rows wherever they lie.

    The sample is the rows with the smallest hashes; each model chooses from those it is fitted on.
    """
    got = rows.select("v", "m").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).collect()
    x, out = np.array([r["v"] for r in got], dtype=float), []
    for m in range(models):
        own = x[[m in r["m"] for r in got]]
        if not len(own):
            raise ValueError(f"no row of the sample takes part in model {m}: take a larger one")
        rng = np.random.default_rng([seed, m])
        chosen = [own[rng.integers(len(own))]]
        far = ((own - chosen[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(own[rng.choice(len(own), p=far / far.sum())] if far.sum() > 0 else own[rng.integers(len(own))])
            far = np.minimum(far, ((own - chosen[-1]) ** 2).sum(1))
        out.append(chosen)
    return np.array(out)


def fit_grouped(df: DataFrame, vec: str, members: Column, models: int, k: int, restarts: int = 1, iterations: int = 20, tol: float = 1e-6, seed: int = 0, sample: int = 20_000, start: np.ndarray | None = None) -> GroupedCentroids:
    """``models`` K-means fits of ``k`` centroids each; ``members`` is an array of the models that a row is fitted in.

    Of ``restarts`` fits the one with the least cost stays. Rounds end when no centroid moves more
    than ``tol``, or after ``iterations``. A centroid without rows stays where it is. ``start``
    (models x k x d) takes the place of the sampled first centroids. Rows with a null vector or
    without models are left out. The bandwidth is the exact median distance to the nearest centroid.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("v"), members.alias("m")).where("v is not null and size(m) > 0").persist()
    if start is None:
        centroids = np.concatenate([start_vectors(rows, models, k, seed + i, sample) for i in range(restarts)])
    else:
        centroids, restarts = np.array(start, dtype=float), 1
    total, dims = models * restarts, centroids.shape[2]
    kind = pa.schema([("model", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()), ("s", pa.list_(pa.float64()))])

    def one_round(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, cost, sums) by model and centroid."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, cost, sums = np.zeros((total, k), np.int64), np.zeros((total, k)), np.zeros((total, k, dims))
            for b in batches:
                if not b.num_rows:
                    continue
                x, part = _vectors(b), _members(b, models)
                for m in range(total):
                    z = x[part[:, m % models]]
                    at = _nearest(z, own[m])
                    n[m] += np.bincount(at, minlength=k)
                    cost[m] += np.bincount(at, weights=((z - own[m][at]) ** 2).sum(1), minlength=k)
                    sums[m] += (at[None] == np.arange(k)[:, None]).astype(float) @ z
            on = np.argwhere(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(on[:, 0], pa.int32()), pa.array(on[:, 1], pa.int32()), pa.array(n[n > 0]), pa.array(cost[n > 0]), pa.array(list(sums[n > 0]), pa.list_(pa.float64()))], schema=kind)

        parts = rows.mapInArrow(run, "model int, k int, n long, cost double, s array<double>")
        got = parts.groupBy("model", "k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s")).collect()
        n, cost, sums = np.zeros((total, k)), np.zeros((total, k)), np.zeros((total, k, dims))
        for r in got:
            n[r["model"], r["k"]], cost[r["model"], r["k"]], sums[r["model"], r["k"]] = r["n"], r["cost"], r["s"]
        return n, cost, sums

    for _ in range(iterations):
        n, _, sums = one_round(centroids)
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centroids)
        far, centroids = float(np.sqrt(((moved - centroids) ** 2).sum(2)).max()), moved
        if far <= tol:
            break
    n, cost, _ = one_round(centroids)
    best = cost.sum(1).reshape(restarts, models).argmin(0) * models + np.arange(models)
    centroids = centroids[best]
    distances = rows.mapInArrow(lambda b: _distances(b, centroids), "model int, d double")
    found = {r["model"]: r["q"][0] for r in quantiles(distances, "d", [0.5], ["model"]).collect()}
    rows.unpersist()
    return GroupedCentroids(centroids, np.array([found.get(m, np.nan) for m in range(models)]), cost.sum(1)[best], n.sum(1)[best].astype(np.int64))


def _distances(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, part = _vectors(b), _members(b, len(centroids))
        for m, c in enumerate(centroids):
            z = x[part[:, m]]
            d = np.sqrt(((z - c[_nearest(z, c)]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), m), pa.int32()), pa.array(d)], names=["model", "d"])


def squared_distances_by(vec: Column, model: Column, centroids: np.ndarray) -> Column:
    """Squared distances to the centroids of each row's model; null without a vector or a model."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def distances(v: pd.Series, m: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        ok = v.notna() & m.notna()
        for own in m[ok].unique():
            at = np.flatnonzero(ok & (m == own))
            x = np.array(v.iloc[at].tolist(), dtype=float)
            for i in range(0, len(at), 1024):
                d = ((x[i : i + 1024, None, :] - centroids[int(own)][None]) ** 2).sum(-1)
                for j, row in zip(at[i : i + 1024], d, strict=True):
                    out.iat[j] = row
        return out

    return distances(vec, model)


def numbered(df: DataFrame, group: str) -> tuple[DataFrame, list]:
    """``df`` with ``_model``, the number of its group among all groups in order, and those groups: one a model."""
    values = sorted((r[0] for r in df.select(group).distinct().collect()), key=lambda v: (v is not None, v))
    at = F.lit(None).cast("int")
    for i, v in enumerate(values):
        at = F.when(F.col(group).eqNullSafe(F.lit(v)), i).otherwise(at)
    return df.withColumn("_model", at), values


def assign(df: DataFrame, vec: str, fitted: GroupedCentroids) -> DataFrame:
    """``df`` (with ``_model``) with ``distances``, ``cluster`` and ``sigma`` of each row's model."""
    sigma = F.array(*[F.lit(float(s)) for s in fitted.sigma])
    out = df.withColumn("distances", squared_distances_by(F.col(vec), F.col("_model"), fitted.centroids))
    nearest = (F.array_position("distances", F.array_min("distances")) - 1).cast("int")
    return out.withColumn("cluster", nearest).withColumn("sigma", sigma[F.col("_model")]).drop("_model")


def held_out(df: DataFrame, fold: str, vec: str, k: int, restarts: int = 1, seed: int = 0, **fit) -> DataFrame:
    """Each fold assigned to centroids fitted on the other folds: adds ``distances``, ``cluster`` and ``sigma``.

    All folds are fitted in one job. A null fold is a fold; a null vector has null results.
    """
    rows, folds = numbered(df, fold)
    others = F.filter(F.array(*[F.lit(i) for i in range(len(folds))]), lambda m: m != F.col("_model"))
    return assign(rows, vec, fit_grouped(rows, vec, others, len(folds), k, restarts, seed=seed, **fit))


def by_layer(df: DataFrame, layer: str, vec: str, k: int, restarts: int = 1, seed: int = 0, **fit) -> DataFrame:
    """Each layer assigned to centroids of its own, all layers fitted in one job."""
    rows, layers = numbered(df, layer)
    return assign(rows, vec, fit_grouped(rows, vec, F.array("_model"), len(layers), k, restarts, seed=seed, **fit))


def sample_layers(n: int, parts: int = 12) -> list[int]:
    """Of the states 0 (before the first layer) to ``n``: those a twelfth of the layers apart, and the last one."""
    return sorted({*range(0, n + 1, max(1, n // parts)), n})
