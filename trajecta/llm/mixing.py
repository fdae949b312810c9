"""Mixing sources to target weights over fixed-length token blocks.

Every source is one stream of words (its documents in a fixed order) cut into blocks of
``block`` words. A mix of ``share`` times all words is laid out in output shards: each shard
draws its source counts from a multinomial over the targets, the k-th slot of a source takes
the block that a pseudorandom permutation of that source's block indexes gives for k, and
slots and documents meet in a join on (source, block index). A pass over a source is one
permutation, so no block comes a second time before all came once. Slots drawn beyond a
source's target stay empty and what a source was drawn too little goes to settling shards
at the end, so targets are met to the word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize, mix64, read_table, slices

_U = np.uint64
WEIGHTS = (3, 1, 2)
BLOCK, SHARD = 512, 4096  # words in a block, slots in an output shard
MAX_SOURCES = 1_000_000  # the source list, like its weights, is a parameter-sized object


def targets(sizes: list[int], weights: list[int], share: Fraction, most: int = 2) -> list[float]:
    """Shares by weight, stopped at ``most`` times a size; the excess goes to the others by weight."""
    left, out = Fraction(share) * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s]
    while free:
        rate = left / sum(weights[i] for i in free)
        over = [i for i in free if rate * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = float(rate * weights[i])
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        free = [i for i in free if i not in set(over)]
    return out


class Permutation:
    """A keyed permutation of range(n): a Feistel network over a x b >= n that walks until inside n."""

    def __init__(self, n: int, key: int):
        self.n, self.a = n, max(1, math.isqrt(n - 1) + 1)
        self.b = -(-n // self.a)
        self.keys = mix64(np.arange(1, 7, dtype=np.uint64) + mix64(np.array([key % 2**64], dtype=np.uint64)))

    def _round(self, half: np.ndarray, i: int, size: int) -> np.ndarray:
        return (mix64(half.astype(np.uint64) + self.keys[i]) % _U(size)).astype(np.int64)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in range(5, -1, -1) if back else range(6):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(left, i, self.b)) % self.b
            else:
                left = (left + sign * self._round(right, i, self.a)) % self.a
        return left * self.b + right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.int64), back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], back)
        return x


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 64 + turn


def _plan(names: list, sizes: list[int], goal: list[float], block: int, seed: int) -> pd.DataFrame:
    """One row for each source: its blocks, whole passes, slots and the words of its last slot."""
    rows = []
    for i, (name, size, target) in enumerate(zip(names, sizes, goal, strict=True)):
        want = min(round(target), 2 * size)
        if not want:
            continue
        blocks = -(-size // block)
        short = blocks * block - size  # what the last block lacks
        turns, rest = divmod(want, size)
        slots, last = turns * blocks, block
        if rest:
            at = int(Permutation(blocks, _key(seed, i, turns))(np.array([blocks - 1]), back=True)[0])
            m = -(-rest // block)
            if m > at:
                m = max(at + 1, -(-(rest + short) // block))
            before = (m - 1) * block - (short if m - 1 > at else 0)
            slots, last = slots + m, rest - before
        rows.append((i, name, size, blocks, turns, slots, last if rest else 0, float(want)))
    return pd.DataFrame(rows, columns=["sid", "source", "size", "blocks", "turns", "slots", "last", "want"])


def _positions(docs: DataFrame, group: int = 2_000) -> DataFrame:
    """Adds the start of each document in its source's stream.

    A source is dealt to buckets of about ``group`` rows; a window runs inside a bucket and a
    second one over the bucket totals, so a source with a third of all rows is spread.
    """
    per = docs.groupBy("sid").agg(F.ceil(F.count("*") / group).alias("n_buckets"))
    dealt = docs.join(F.broadcast(per), "sid")  # a row for each source, as bounded as the source list
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.col("n_buckets")).cast("int"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # alike rows follow each other
    dealt = materialize(dealt.withColumn("ends", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside)), "dealt")
    totals = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return dealt.join(offsets.hint("shuffle_hash"), ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("ends") - F.col("size"))


def _slots(spark, plan: pd.DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """shard, slot, sid, block, words: every slot of the mix and the block it takes."""
    chances = (plan["slots"] / max(1, plan["slots"].sum())).to_numpy()
    sids, quota, total = plan["sid"].to_numpy(), plan["slots"].to_numpy(), int(plan["slots"].sum())
    shards = -(-total // shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                n = np.random.default_rng([seed, int(s)]).multinomial(min(shard, total - int(s) * shard), chances)
                on = np.flatnonzero(n)
                yield pd.DataFrame({"sid": sids[on], "shard": int(s), "drawn": n[on], "quota": quota[on]})

    drawn = spark.range(shards).mapInPandas(draw, "sid int, shard long, drawn long, quota long")
    undrawn = spark.createDataFrame([(int(i), 0, 0, int(x)) for i, x in zip(sids, quota, strict=True)], "sid int, shard long, drawn long, quota long")
    drawn = drawn.union(undrawn)  # a source that no shard drew has a row too
    order = Window.partitionBy("sid").orderBy("shard")
    runs = drawn.withColumn("upto", F.sum("drawn").over(order)).withColumn("next", F.lead("shard").over(order))
    runs = runs.withColumn("first", F.col("upto") - F.col("drawn"))
    settle = runs.where("next is null and upto < quota").select("sid", F.lit(shards).cast("long").alias("shard"), F.col("upto").alias("first"), F.col("quota").alias("upto"))
    runs = runs.where("first < quota").select("sid", "shard", "first", F.least("upto", "quota").alias("upto")).unionByName(settle)
    each = runs.where("first < upto").select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("upto") - 1)).alias("k"))
    facts = {r.sid: (int(r.blocks), int(r.slots), int(r.size), int(r.last)) for r in plan.itertuples()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, g in b.groupby("sid"):
                blocks, slots, size, last = facts[sid]
                k = g["k"].to_numpy()
                at = np.zeros(len(g), dtype=np.int64)
                for turn in np.unique(k // blocks):
                    own = k // blocks == turn
                    at[own] = Permutation(blocks, _key(seed, int(sid), int(turn)))(k[own] % blocks)
                words = np.where(at == blocks - 1, size - (blocks - 1) * block, block)
                if last:
                    words = np.where(k == slots - 1, last, words)
                yield g.assign(block=at, words=words)[["sid", "shard", "k", "block", "words"]]

    return each.mapInPandas(place, "sid int, shard long, k long, block long, words long")


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, source, row (a hash, to order missing and repeated ids) and size in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size = pa.array(count_words(b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("row"), size], names=["doc_id", "source", "row", "size"])

    rows = docs.select("doc_id", "source", row.alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, row long, size long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=Fraction(3, 2), block: int = BLOCK, shard: int = SHARD, seed: int = 17, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, per document) of a mix of ``docs(doc_id, text, source)``.

    Pieces tell, for each slot of each output shard, which words of which document it takes:
    ``shard, k, source, block, doc_id, first, last`` (word numbers, end exclusive; k is the
    slot's number in its source). The second frame has a row for each document: ``doc_id,
    source, row, size, source_size, target, taken``.
    ``weights`` repeat over the sources in code-point order, null last; a target is at most
    twice its source's size. Null and empty texts have size 0 and are never taken; a null
    source is a source of its own; repeated rows and ids are separate documents; other columns
    are ignored. ``row`` tells rows of one id apart (by default a hash of the text). Reruns agree, whatever the partitioning. At most ``MAX_SOURCES`` sources.
    """
    spark = docs.sparkSession
    sized = materialize(_sized(docs, F.xxhash64("text") if row is None else row), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    names, sizes = [r["source"] for r in found], [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], Fraction(share))
    plan = _plan(names, sizes, goal, block, seed)
    known = spark.createDataFrame(
        [(i, n, s, t) for i, (n, s, t) in enumerate(zip(names, sizes, goal, strict=True))], "sid int, source string, source_size long, target double"
    )
    rows = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop(known["source"])  # the source list
    placed = materialize(_positions(rows), "placed")
    over = placed.where("size > 0").select("sid", "bucket", "nth", "doc_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    slots = _slots(spark, plan, block, shard, seed) if len(plan) else spark.createDataFrame([], "sid int, shard long, k long, block long, words long")
    lo = F.greatest(F.col("block") * block, F.col("start"))
    hi = F.least(F.col("block") * block + F.col("words"), F.col("start") + F.col("size"))
    pieces = over.join(slots.hint("merge"), ["sid", "block"]).where(hi > lo).select(
        "sid", "bucket", "nth", "shard", "k", "block", "doc_id", (lo - F.col("start")).alias("first"), (hi - F.col("start")).alias("last")
    )
    pieces = materialize(pieces, "pieces")
    taken = pieces.groupBy("sid", "bucket", "nth").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    per_doc = placed.join(taken.hint("merge"), ["sid", "bucket", "nth"], "left").select(
        "doc_id", "source", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )
    named = pieces.join(F.broadcast(known.select("sid", "source")), "sid").select("shard", "k", "source", "block", "doc_id", "first", "last")
    return named, per_doc


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Contract query: weights 3, 1, 2 over the sources and 150 % of all words."""
    per_doc = mix_sources(read_table(spark, sf_dir, "documents"))[1]
    return per_doc.select("doc_id", "size", "source_size", "target", "taken", "source")
