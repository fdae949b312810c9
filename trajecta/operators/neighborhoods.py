"""Soft neighbourhoods: trajectories over the assignment to centroids, and flow of nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import vectors as V
from trajecta.operators.aggregates import quantiles
from trajecta.operators.grouped_kmeans import by_layer, held_out, sample_layers  # noqa: F401


def squared_distances(vec: Column, centroids: np.ndarray) -> Column:
    """Squared distance to each centroid; the centroids are a small model and travel with the function."""
    own = np.asarray(centroids, dtype=float)

    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float)
        return pd.Series(list(((x[:, None, :] - own[None]) ** 2).sum(-1))) if len(x) else pd.Series([], dtype=object)

    return distances(vec)


def nearest(distances: Column) -> Column:
    """Index (from 0) of the nearest centroid; ties go to the first."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def bandwidth(df: DataFrame, distances: str, by: list[str] | None = None) -> DataFrame:
    """``sigma``: the exact median distance to the nearest centroid, of all rows or of each group."""
    rows = df.select(*(by or []), F.sqrt(F.array_min(distances)).alias("_d"))
    return quantiles(rows, "_d", [0.5], by).select(*(by or []), F.col("q")[0].alias("sigma"))


def soft_assign(distances: Column, sigma: Column) -> Column:
    """Square roots of the softmax of -d^2 / 2 sigma^2; the largest exponent is subtracted first."""
    power = F.transform(distances, lambda d: F.exp((F.array_min(distances) - d) / (2 * sigma * sigma)))
    total = F.aggregate(power, F.lit(0.0), lambda s, x: s + x)
    return F.transform(power, lambda x: F.sqrt(x / total))


def fit_neighborhoods(df: DataFrame, vec: str, k: int, restarts: int = 4, seed: int = 0) -> np.ndarray:
    """Centroids of the best of several K-means runs."""
    rows = df.select(array_to_vector(F.col(vec)).alias("features")).persist()
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i).fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    rows.unpersist()
    return np.array(best.clusterCenters())


def save_neighborhoods(spark, centroids: np.ndarray, sigma: float, path: str) -> None:
    """A fitted model as a small table: one row a centroid, and the bandwidth."""
    rows = [(i, [float(x) for x in c], float(sigma)) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "k int, centroid array<double>, sigma double").coalesce(1).write.mode("overwrite").parquet(path)


def load_neighborhoods(spark, path: str) -> tuple[np.ndarray, float]:
    rows = spark.read.parquet(path).orderBy("k").collect()
    return np.array([r["centroid"] for r in rows]), rows[0]["sigma"]


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of numbers, given as arrays or as bytes of doubles."""
    if len(vectors) and isinstance(vectors.iloc[0], bytes):
        return np.frombuffer(b"".join(vectors), float).reshape(len(vectors), -1)
    return np.array(vectors.tolist(), dtype=float)


def _nearest_of(n: int):
    """The n nearest rows of a corpus group for each query of a query group, ties to the smaller id."""

    def near(_key, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(own):
            v, ids, groups = _matrix(own["vec"]), own["id"].to_numpy(), own["grp"].to_numpy()
            vv = (v * v).sum(1)
            for at in range(0, len(asked), 256):
                f = asked.iloc[at : at + 256]
                u, names = _matrix(f["vec"]), f["id"].to_numpy()
                uu = (u * u).sum(1)
                rough = np.maximum(uu[:, None] + vv[None] - 2 * u @ v.T, 0)
                rough[f["grp"].to_numpy()[:, None] == groups[None]] = np.inf
                cut = np.partition(rough, min(n, len(v)) - 1, axis=1)[:, min(n, len(v)) - 1][:, None]
                # all that may be as near as the n-th; rough distances are rounded
                i, j = np.nonzero(np.isfinite(rough) & ~(rough > cut + 1e-9 * (uu[:, None] + vv[None] + cut)))
                exact = np.empty(len(i))
                for lo in range(0, len(i), 1 << 15):
                    w = slice(lo, lo + (1 << 15))
                    exact[w] = np.sqrt(((v[j[w]] - u[i[w]]) ** 2).sum(1))
                order = np.lexsort((ids[j], exact, i))
                place = np.arange(len(i)) - np.searchsorted(i, i)  # pairs come by query, before and after sorting
                order = order[place < n]
                found.append(pd.DataFrame({"query_id": names[i[order]], "vec_id": ids[j[order]], "distance": exact[order]}))
        out = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        return out.astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})

    return near


def flow_neighbors(queries: DataFrame, corpus: DataFrame, n: int, block: int = 4096, piece: int = 16_384) -> DataFrame:
    """``query_id, vec_id, distance, rank``: the exact n nearest corpus rows from other groups.

    ``queries`` and ``corpus`` have ``id, grp, vec``. Both are dealt to blocks; every pair of a query block
    and a corpus piece is one group that keeps its n nearest for each query, and a ranking
    of those gives the result. No vector reaches the driver, and no task holds more than a block of each.
    """
    def dealt(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // size))
        own = [F.col(c).alias(c) for c in ("id", "grp", "vec")]  # columns of its own, also where both sides are one frame
        return df.select(*own, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")), parts

    (q, blocks), (x, pieces) = dealt(queries, block), dealt(corpus, piece)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumnRenamed("part", "b").withColumn("p", spread(pieces))
    x = x.withColumnRenamed("part", "p").withColumn("b", spread(blocks))

    out = q.groupBy("b", "p").cogroup(x.groupBy("b", "p")).applyInPandas(_nearest_of(n), "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _probed(margins: np.ndarray, probes: int) -> np.ndarray:
    """rows x probes: which bits to turn, those first whose planes are near the row (of the eight nearest planes)."""
    width = min(8, margins.shape[1])
    order = np.argsort(np.abs(margins), axis=1)[:, :width]
    subsets = ((np.arange(1 << width)[:, None] >> np.arange(width)) & 1).astype(float)
    cost = np.take_along_axis(margins, order, axis=1) ** 2 @ subsets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.einsum("rpw,rw->rp", subsets[best].astype(np.int64), np.int64(1) << order)


def flow_neighbors_approx(queries: DataFrame, corpus: DataFrame, n: int, tables: int = 6, probes: int = 8, bucket: int = 2_000, piece: int = 16_384, seed: int = 0) -> DataFrame:
    """``flow_neighbors`` from buckets of random projections instead of all pairs, reranked by exact distances.

    A row's bucket in a table is given by the sides of random planes through the corpus mean that
    it lies on; there are as many planes as make buckets of about ``bucket`` rows. A query looks into
    the ``probes`` buckets whose planes it is nearest to, in every table. The corpus is shuffled once a table and
    queries once a table and probe, in proportion to the input; a bucket of more than ``piece`` rows is cut and
    asked in parts. A query that finds fewer than n rows is compared with all of them.
    """
    corpus = corpus.select("id", "grp", "vec").persist()  # read by every step
    size = corpus.count()
    bits = max(0, int(np.ceil(np.log2(max(size, 1) / bucket))))
    if not bits:
        return flow_neighbors(queries, corpus, n)
    dims = len(corpus.select("vec").first()[0])
    center = np.array(corpus.agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dims)])).first()[0], dtype=float)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))

    def sides(many: bool):
        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                x = np.array(f["vec"].tolist(), dtype=float)
                f, x = f.assign(vec=[r.tobytes() for r in x]), x - center
                for t in range(tables):
                    margins = x @ planes[t].T
                    code = ((margins > 0) << np.arange(bits)).sum(1)
                    if not many:
                        yield f.assign(t=t, b=code)
                        continue
                    codes = code[:, None] ^ _probed(margins, probes)
                    out = f.loc[f.index.repeat(codes.shape[1])].assign(t=t)
                    yield out.assign(b=codes.ravel())

        return run

    schema = corpus.select("id", "grp", F.lit(b"").alias("vec")).schema.add("t", "integer").add("b", "long")
    own = corpus.mapInPandas(sides(False), schema)
    asked = queries.select("id", "grp", "vec").mapInPandas(sides(True), schema)
    cuts = own.groupBy("t", "b").agg(F.ceil(F.count("*") / piece).cast("long").alias("cuts")).where("cuts > 1").hint("merge")
    own = own.join(cuts, ["t", "b"], "left").withColumn("p", F.pmod(F.xxhash64("id"), F.coalesce("cuts", F.lit(1)))).drop("cuts")
    asked = asked.join(cuts, ["t", "b"], "left").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
    found = asked.groupBy("t", "b", "p").cogroup(own.groupBy("t", "b", "p")).applyInPandas(_nearest_of(n), "query_id long, vec_id long, distance double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))  # a row is found in several tables
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).persist()  # searched once, read several times
    enough = ranked.where(F.col("rank") == n).select(F.col("query_id").alias("id"))
    few = queries.join(enough.hint("merge"), "id", "left_anti")
    if not few.count():
        corpus.unpersist()
        return ranked
    rest = flow_neighbors(few, corpus, n)
    return ranked.join(enough.withColumnRenamed("id", "query_id").hint("merge"), "query_id", "left_semi").unionByName(rest)


def flow_prediction(neighbors: DataFrame, steps: DataFrame) -> DataFrame:
    """``query_id, flow``: the mean next step of the neighbours; ``steps`` has ``vec_id, step``."""
    from trajecta.operators.trajectory import centroid_by

    return centroid_by(neighbors.hint("merge").join(steps, "vec_id").select("query_id", "step"), ["query_id"], "step", "flow")


def hellinger(a: Column, b: Column) -> Column:
    """Distance of two square-root assignments."""
    return V.v_norm(V.v_sub(a, b)) / F.sqrt(F.lit(2.0))
