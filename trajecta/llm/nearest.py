"""Approximate nearest neighbours by multi-index hashing.

Vectors get learned binary codes (principal axes, then a rotation that brings them close to
the corners of a cube). Codes are cut into bytes and each byte position is a table. Two
codes within a Hamming radius r differ by at most r // tables bits in some byte, so probing
all bytes that close in every table retrieves every code within the radius. Those
candidates are ranked by exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

BITS, TABLES = 64, 8
RADIUS = 31  # of 64 bits; every byte within three bits is probed
SAMPLE = 20_000  # vectors that the codes are learned from, at most
CHUNK, QUERIES = 20_000, 5_000  # vectors and queries compared in one group
BUCKET = 2_000  # neighbouring buckets of a table share a group until it has about so many vectors


@dataclass
class Coder:
    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.axes > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def learn_codes(x: np.ndarray, rounds: int = 30, seed: int = 5) -> Coder:
    """Principal axes of a sample and the rotation that minimises the quantisation error."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(axis=0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :BITS]
    if d < BITS:  # more bits than dimensions: further directions are random
        axes = np.hstack([axes, np.linalg.qr(rng.normal(size=(BITS, BITS)))[0][:d, : BITS - d]])
    z = z @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    return Coder(mean, axes @ turn)


def _bytes_of(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.uint8).reshape(-1, TABLES)


def _near_bytes(reach: int, shift: int) -> list[np.ndarray]:
    """Groups of buckets that hold a byte within ``reach`` bits of each byte."""
    v = np.arange(256, dtype=np.uint8)
    return [np.unique(np.flatnonzero(np.bitwise_count(v ^ np.uint8(x)) <= reach) >> shift).astype(np.int32) for x in range(256)]


def _compare(radius: int, reach: int, k: int, dtype):
    def run(_key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            table = int(own["j"].iloc[0])
            vectors = lambda f: np.frombuffer(b"".join(f["vec"]), dtype).reshape(len(f), -1).astype(np.float64)
            x, q = vectors(own), vectors(asked)
            cx, cq = (f["code"].to_numpy().view(np.uint64) for f in (own, asked))
            ids = own["ids"].tolist()
            first = np.array([i[0] for i in ids])
            xx = (x * x).sum(1)
            for at in range(0, len(q), 64):
                differ = cq[at : at + 64, None] ^ cx[None]
                keep = (np.bitwise_count(differ) <= radius) & (np.bitwise_count((differ >> np.uint64(8 * table)).astype(np.uint8)) <= reach)
                for j in range(table):  # a pair counts in the first table that retrieves it
                    keep &= np.bitwise_count((differ >> np.uint64(8 * j)).astype(np.uint8)) > reach
                rough = np.where(keep, xx[None] - 2 * q[at : at + 64] @ x.T, np.inf)
                for i in range(len(rough)):
                    n = int(keep[i].sum())
                    if not n:
                        continue
                    edge = np.partition(rough[i], k - 1)[k - 1] if n > k else np.inf
                    near = np.flatnonzero(keep[i] & (rough[i] <= edge + 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else keep[i]))
                    score = np.sqrt(((x[near] - q[at + i]) ** 2).sum(1))
                    order = np.lexsort((first[near], score))[:k]
                    found += [(asked["cls"].iloc[at + i], v, s) for o, s in zip(near[order], score[order], strict=True) for v in ids[o]]
        return pd.DataFrame(found, columns=["cls", "vec_id", "score"]).astype({"cls": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _search(coded: DataFrame, queries: DataFrame, radius: int, tables: int, k: int, dtype) -> DataFrame:
    """cls, vec_id, score of all codes within the radius, the ``k`` nearest of each group of the index."""
    reach = radius // tables
    shift = 8 - min(8, max(0, (coded.count() // BUCKET).bit_length()))
    near = _near_bytes(min(8, reach), shift)
    fill = coded.sparkSession.createDataFrame

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = _bytes_of(b["code"].to_numpy())
            yield pd.concat([b.assign(j=j, v=(own[:, j] >> shift).astype(np.int32)) for j in range(tables)])

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = _bytes_of(b["code"].to_numpy())
            for j in range(tables):
                values = [near[x] for x in own[:, j]]
                out = b.loc[b.index.repeat([len(v) for v in values])].assign(j=j)
                yield out.assign(v=np.concatenate(values) if len(values) else np.zeros(0, np.int32))

    index = coded.mapInPandas(entries, "cls long, ids array<long>, code long, vec binary, j int, v int")
    sizes = index.groupBy("j", "v").count().collect()  # at most 256 rows for each table
    pieces = fill([(r["j"], r["v"], -(-r["count"] // CHUNK)) for r in sizes], "j int, v int, pieces int")
    parts = max(1, -(-queries.count() // QUERIES))
    index = index.join(F.broadcast(pieces), ["j", "v"]).withColumn("piece", F.pmod(F.xxhash64("cls"), F.col("pieces"))).drop("pieces")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else index.withColumn("part", F.lit(0))
    asked = queries.select("cls", "code", "vec").mapInPandas(probes, "cls long, code long, vec binary, j int, v int")
    asked = asked.join(F.broadcast(pieces), ["j", "v"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1))).drop("pieces")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int"))
    keys = ["j", "v", "piece", "part"]
    return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_compare(radius, reach, k, dtype), "cls long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 10, radius: int = RADIUS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query row.

    ``vectors`` has ``vec_id`` and ``embedding`` (an array); ``is_query`` is a condition. The
    measure is the Euclidean distance in double precision; ties go to the smaller vec_id. A
    query that has fewer than ``k`` codes within the radius is compared with all rows. Rows
    with a null id, and vectors that are null, zero, not of the usual length or hold a null or
    non-finite component take no part. Equal vectors are indexed once with their ``k + 1``
    smallest ids, which is all any list of ``k`` can need. Rows that repeat a vec_id are rows of
    their own: each has a list (``query_row`` counts the rows of an id, by vector), and is in
    others' lists, also in those of its id; a list lacks its own row alone. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    dtype = np.float32 if kind == "array<float>" else np.float64
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if dtype is np.float32 else "array<double>").alias("e"), is_query.alias("asked"))
    rows = rows.where("vec_id is not null and e is not null").where(
        F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    )
    usual = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row int")
    rows = rows.where(F.size("e") == usual["d"])
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = kept.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "ids", "e"), "classes")  # written, so that numbers stay
    picked = classes.select("e").orderBy(F.xxhash64("e"), "e").limit(SAMPLE).toPandas()["e"]  # bounded by SAMPLE
    coder = spark.sparkContext.broadcast(learn_codes(np.stack(picked.to_list()).astype(np.float64)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["e"].to_list()).astype(dtype)
                yield pd.DataFrame({"cls": b["cls"], "ids": b["ids"], "code": coder.value(x.astype(np.float64)).view(np.int64), "vec": [v.tobytes() for v in x]})

    coded = materialize(classes.mapInPandas(encode, "cls long, ids array<long>, code long, vec binary"), "codes")
    asking = rows.where("asked").select(F.col("vec_id").alias("query_id"), "e")
    asking = asking.withColumn("query_row", F.row_number().over(Window.partitionBy("query_id").orderBy("e")))
    asking = asking.join(classes.select("cls", "e").hint("merge"), "e").select("query_id", "query_row", "cls")
    asking = materialize(asking, "asking")
    queries = materialize(coded.join(asking.select("cls").distinct().hint("shuffle_hash"), "cls", "left_semi"), "queries")
    best = Window.partitionBy("cls").orderBy("score", "vec_id")

    def shortened(found: DataFrame) -> DataFrame:
        return materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "found")

    found = shortened(_search(coded, queries, radius, TABLES, k + 1, dtype))
    got = found.groupBy("cls").count().where(F.col("count") > k).select("cls")
    few = materialize(queries.join(got.hint("merge"), "cls", "left_anti"), "few")
    if few.limit(1).count():
        wide = shortened(_search(coded, few, BITS, 1, k + 1, dtype))
        found = found.join(few.select("cls").hint("merge"), "cls", "left_anti").unionByName(wide)
    # a query's own row is one of those with its id at no distance; rows alike are interchangeable
    pairs = asking.join(found.hint("merge"), "cls").withColumn("same", (F.col("query_id") == F.col("vec_id")) & (F.col("score") == 0))
    alike = Window.partitionBy("query_id", "query_row", "same").orderBy("score", "vec_id")
    pairs = pairs.withColumn("n", F.row_number().over(alike)).where("not (same and n = 1)")
    own = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """Contract query: the ten nearest rows of every row whose id is divisible by 100."""
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
