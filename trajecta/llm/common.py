"""Helpers that several corpus operators share: a scratch folder, Arrow word hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every word rule in this package.
WHITE = [9, 10, 11, 12, 13, 32]
WORD_RE = r"[^\x20\x09-\x0D]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[WHITE] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_SPAN = 1 << 20
_tables: dict[str, np.ndarray] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if it is set.

    Without that setting a context checkpoint directory is used, then a temporary
    folder for a local master (tests) or the warehouse for any other one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root and sc.getCheckpointDir():
        root = sc.getCheckpointDir()
    if not root:
        if sc.master.startswith("local[") or sc.master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            sc.setCheckpointDir(root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage, survives lost executors and gives later joins true sizes. The shuffle
    files of the write go as soon as the table is there, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that was made of them is written too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing in numpy


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche, so that products and low bits are usable."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, _SPAN + 4096)
        p = np.full(size, _BASE, dtype=np.uint64)
        p[0] = 1
        q = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        q[0] = 1
        _tables["pow"], _tables["inv"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n+1 row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text (or one row), so that a task's memory is bounded."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(start, end - start)
            start = end


def word_spans(data: np.ndarray, rows: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the word offsets (n+1) of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    m = np.frombuffer(data.tobytes().translate(is_word.tobytes()), bool)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[rows] = True
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~before | cut[:-1]))
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (spans ascending): prefix sums of a polynomial, then mixing."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SPAN, side="right")))
        hi = int(ends[j - 1])
        if hi - lo > _SPAN:  # one span longer than the window
            out[i] = _U(xxhash.xxh64_intdigest(data[lo:hi].tobytes()))
        else:
            power, inverse = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + _U(1)) * power[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z lower-cased), and the word offsets (n+1) of the rows."""
    data, rows = text_bytes(column)
    data = _LOWER[data]
    starts, ends, offsets = word_spans(data, rows)
    return hash_spans(data, starts, ends), offsets


def count_words(column: pa.Array) -> np.ndarray:
    data, rows = text_bytes(column)
    return np.diff(word_spans(data, rows)[2])


# ---------------------------------------------------------------- components


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row a key and ``n``, how many of the ``total`` rows have it.

    A key with more than one in 500 of all rows is broadcast (there are fewer than 500 of them), so that
    its rows stay where they are; the others are dealt by key. A null key matches nothing, and the other
    columns of ``groups`` hold no nulls. With one such column, both uses of the broadcast share one table.
    """
    most = max(100, total // 500)
    told = next(c for c in groups.columns if c not in (key, "n"))
    hot = F.broadcast(groups.where(F.col("n") > most).drop("n"))
    rest = groups.where(F.col("n") <= most).drop("n")
    cold = rows.join(hot, key, "left").where(F.col(told).isNull()).select(rows.columns).join(rest.hint("merge"), key)
    return cold.unionByName(rows.join(hot, key))


def connected_components(edges: DataFrame, name: str = "cc", limit: int = 1_000) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star steps (joins and minimum aggregates only): each
    rewires neighbours to the smallest neighbour, so the number of edges never grows, and
    nothing but two counters reaches the driver. Minima are taken before the shuffle, and
    nodes with very many neighbours are broadcast, so none of them meets all its edges in
    one task. Each step is written before the next: a plan of both would read the edges
    dozens of times, and the driver holds every version of it. Rounds go on until nothing
    changes; more than ``limit`` of them (their number grows with the logarithm of the
    longest path) are an error.
    """
    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        if large:  # neighbours above u move to the smallest of u and its neighbours
            moved = join_groups(both.where("v > u"), low, "u", 2 * total).select("v", "m")
        else:  # edges point from larger to smaller; u and its smaller neighbours move to their minimum
            moved = join_groups(both, low, "u", total).select("v", "m").union(low.select(F.col("u").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    told = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = told(e)
    for _ in range(limit):
        if not state[0]:
            break
        before, last = e, state
        # a large star makes at most one edge of each, so its edges are bounded by the count before
        raised = materialize(star(e, True, state[0]), name)
        e = materialize(star(raised, False, state[0]), name)
        state = told(e)
        discard(before, raised)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
