"""Near-duplicate documents by SetSketch registers, exact confirmation and components.

1. Each document's set of word shingles is sketched into registers
   ``floor(1 - log_b(min h))`` of exponentially distributed minima. Registers merge by
   maximum and two sets agree in a register with about the probability of their Jaccard
   similarity.
2. Documents of the same set form one class; only classes go on.
3. Bands of registers put classes in buckets. Each bucket gives star pairs to its first and
   last class, so candidates grow in line with the bucket, never with its square.
4. A likelihood estimate from the registers and both set sizes drops pairs far below the
   threshold, and the full sets confirm the rest.
5. What the stars left apart inside a bucket is settled exactly: prefix filtering with the
   positional bound, and parity bits that bound the difference of two sets, find every pair
   at the threshold between different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, join_groups, materialize, mix64, read_table, slices, word_hashes

_U = np.uint64
REGISTERS, ROWS = 120, 5  # registers by default, and in a band
MISSED = 1e-6  # at most the chance that a pair at the threshold shares no band
BASE, RATE, TOP = 1.005, 20.0, 8191  # spacing, rate and truncation of the registers


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row; fewer words make one shingle."""
    h, at = word_hashes(column)
    n = len(h)
    grams = np.zeros(n, dtype=np.uint64)
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            acc = mix64(acc + h[j : n - k + 1 + j] + _U(j + 1))
        grams[: n - k + 1] = acc
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            one = np.full(1, hi - lo, dtype=np.uint64)
            for x in h[lo:hi]:
                one = mix64(one * _U(31) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_id(s: np.ndarray) -> int | None:
    """One 63-bit id for each distinct set; none for the empty set."""
    if not len(s):
        return None
    whole = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s), len(s)], dtype=np.uint64)
    return int(mix64(mix64(whole[:1]) + mix64(whole[1:2] + whole[2:]))[0] >> _U(1))


def _factors(m: int) -> np.ndarray:
    return mix64(np.arange(1, m + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def registers(values: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    factors, low = _factors(m), np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(low, (values[i : i + 1024, None] * factors).min(axis=0), out=low)
    x = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.int16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the two sets."""
    return np.maximum(a, b)


def joint_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketched pairs (rows), given the set sizes."""
    above, below = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    same = ra.shape[1] - above - below
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    grid = np.linspace(0, 1, 65)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(u - v * grid), 1e-12, 1), np.clip(p(v - u * grid), 1e-12, 1)
    fit = above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def bands_for(percent: int) -> int:
    """Bands that a pair at the threshold misses with a probability of at most ``MISSED``: 24 at 85, 35 at 80."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def _sketch(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = mix64(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))
        for b in slices(batches):
            sizes, nodes, regs, keys = [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), regs.append(None), keys.append(None)
                    continue
                r = registers(s, bands * ROWS)
                nodes.append(class_id(s))
                regs.append(r.tobytes())
                acc = tag.copy()
                for c in r.reshape(bands, ROWS).T.astype(np.uint64):
                    acc = mix64(acc + c)
                keys.append((acc >> _U(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_shingles", "node", "regs", "bands"],
            )

    return run


def _own_sets(k: int):
    """Sets of the rows whose text is the class's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), k)
            mine = [i for i, (s, x) in enumerate(zip(sets, b.column("node").to_pylist(), strict=True)) if class_id(s) == x]
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(pa.array(mine, pa.int64())), pa.array([len(sets[i]) for i in mine], pa.int64()), pa.array([sets[i].tobytes() for i in mine], pa.binary())],
                names=["node", "n", "hashes"],
            )

    return run


def _estimate(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int16).reshape(b.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = joint_estimate(ra, rb, na, nb) >= floor
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha"), b.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


_SLOTS = 1 << 20


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SLOTS, dtype=np.int64)
    for b in batches:
        for x in b.column("hashes"):
            np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) >> _U(44)).astype(np.int64), 1)
    parts = total.reshape(64, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())], names=["part", "counts"])


def _prefixes(percent: int, counts):
    """The first shingles of each set, rarest first by a fixed order, with their positions.

    Each row also has 256 parity bits of its set: two sets differ in at least as many
    shingles as their parities differ in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for b in batches:
            node, comp, late, size, key, pos = [], [], [], [], [], []
            parity: list[list[np.ndarray]] = [[], [], [], []]
            for x, c, s, h in zip(*(b.column(i) for i in ("node", "comp", "late", "hashes")), strict=True):
                h = np.frombuffer(h.as_buffer(), np.uint64)
                take = len(h) - -(-percent * len(h) // 100) + 1
                order = np.lexsort((h, seen[(h >> _U(44)).astype(np.int64)]))[:take]
                key.append((h[order] >> _U(1)).astype(np.int64)), pos.append(np.arange(len(order)))
                odd = np.packbits((np.bincount((h & _U(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                for out, v in zip(parity, odd, strict=True):
                    out.append(np.full(len(order), v))
                for out, v in ((node, x), (comp, c), (late, s), (size, len(h))):
                    out.append(np.full(len(order), v if out is size else v.as_py()))
            if node:
                cat = [np.concatenate(z) for z in (key, pos, node, comp, late, size, *parity)]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in cat], names=["key", "pos", "node", "comp", "late", "n", "p0", "p1", "p2", "p3"])

    return run


def near_duplicate_rows(docs: DataFrame, k: int = 5, percent: int = 85, margin: float = 0.15) -> DataFrame:
    """``doc_id, row, n_shingles, node, first_id, first``: the component of each row, with or without a doc_id.

    ``row`` is a hash of the text; with the doc_id it names a row, so missing and repeated
    ids stay apart. A component is named by its smallest (doc_id, row), null ids last:
    ``first_id`` is that doc_id, and ``first`` tells its row (rows that repeat both are all
    first). A row without words has no ``node``, no component, and is first.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    sketched = materialize(docs.mapInArrow(_sketch(k, bands_for(percent)), "doc_id long, row long, n_shingles long, node long, regs binary, bands array<long>"), "sketch")
    classes = materialize(
        sketched.where("node is not null").groupBy("node", "n_shingles", "regs", "bands").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("rep")), "classes"
    )
    rows = materialize(sketched.select("doc_id", "row", "n_shingles", "node"), "rows")
    members = materialize(classes.select("node", F.explode("bands").alias("key")), "bands")
    discard(sketched)
    shared = materialize(members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "buckets")
    inside = materialize(join_groups(members, shared, "key", members.count()), "inside")  # only classes that share a bucket
    discard(members, shared)
    stars = inside.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).union(
        inside.where("node <> lo and node <> hi").select(F.col("node").alias("a"), F.col("hi").alias("b"))
    )
    pairs = stars.distinct()
    wanted = inside.select("node").distinct()
    picked = wanted.join(classes.select("node", "rep").hint("merge"), "node")
    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("row") == F.col("rep.row"))
    texts = docs.where("text is not null").join(picked.hint("merge"), same).select("node", "text")
    sets = materialize(
        texts.mapInArrow(_own_sets(k), "node long, n long, hashes binary").dropDuplicates(["node"]), "sets"
    )

    def side(pairs: DataFrame, table: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
        for key, columns in names.items():
            own = table.select(F.col("node").alias(key), *[F.col(c).alias(c[0] + key) for c in columns])
            pairs = pairs.join(own.hint("merge"), key)
        return pairs

    def confirmed(pairs: DataFrame) -> DataFrame:
        return side(pairs, sets, {"a": ("hashes",), "b": ("hashes",)}).select("a", "b", "ha", "hb").mapInArrow(_confirm(percent), "a long, b long")

    known = classes.select("node", "regs", F.col("n_shingles").alias("n"))
    likely = side(pairs, known, {"a": ("regs", "n"), "b": ("regs", "n")}).where(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    ).mapInArrow(_estimate(percent / 100 - margin), "a long, b long")
    comps = materialize(connected_components(confirmed(likely)), "comps")

    def labelled(nodes: DataFrame) -> DataFrame:
        own = comps.select("node", F.col("component").alias("own"))
        return nodes.join(own.hint("merge"), "node", "left").withColumn("comp", F.coalesce("own", "node")).drop("own")

    now = materialize(labelled(inside.select("key", "node")), "now")
    discard(inside)
    open_keys = now.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("n")
    ).where("parts > 1").drop("parts")
    open_keys = materialize(open_keys, "open")
    unsettled = join_groups(now, open_keys, "key", now.count()).groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("late"))
    unsettled = materialize(unsettled.join(sets.hint("merge"), "node").select("node", "comp", "late", "hashes"), "unsettled")
    discard(now, open_keys)
    slots = unsettled.select("hashes").mapInArrow(_slot_counts, "part int, counts binary").groupBy("part").applyInPandas(
        lambda g: g.iloc[:1].assign(counts=[np.sum([np.frombuffer(x, np.int32) for x in g["counts"]], axis=0, dtype=np.int64).clip(max=2**31 - 1).astype(np.int32).tobytes()]),
        "part int, counts binary",
    )
    table = np.zeros((64, _SLOTS // 64), dtype=np.int32)  # of a fixed size, whatever the input
    for row in slots.collect():
        table[row["part"]] = np.frombuffer(row["counts"], np.int32)
    counts = spark.sparkContext.broadcast(table.reshape(-1))
    prefixes = materialize(unsettled.mapInArrow(_prefixes(percent, counts), "key long, pos long, node long, comp long, late boolean, n long, p0 long, p1 long, p2 long, p3 long"), "prefixes")
    discard(unsettled)
    counts.destroy()
    x, y = (prefixes.select("key", *[F.col(c).alias(c + t) for c in ("pos", "node", "comp", "late", "n", "p0", "p1", "p2", "p3")]) for t in "xy")
    need = f"ceil({percent} * (nx + ny) / {100 + percent}.0 - 1e-9)"
    apart = " + ".join(f"bit_count(p{i}x ^ p{i}y)" for i in range(4))
    more = x.where("latex").join(y.hint("merge"), "key").where(
        "compx <> compy and (not latey or nodex < nodey)"
        f" and 100 * least(nx, ny) >= {percent} * greatest(nx, ny) and least(nx - posx, ny - posy) >= {need}"
        f" and {apart} <= nx + ny - 2 * {need}"
    ).select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()
    late_links = confirmed(more)
    ends = labelled(late_links.select("b", F.col("a").alias("node"))).select(F.col("comp").alias("a"), F.col("b").alias("node"))
    merged = connected_components(labelled(ends).select("a", F.col("comp").alias("b")))  # of the components so far

    named = labelled(classes.select("node", "rep")).join(merged.select(F.col("node").alias("comp"), "component").hint("merge"), "comp", "left")
    named = materialize(named.select("node", "rep", F.coalesce("component", "comp").alias("component")), "named")
    discard(classes, sets, comps, prefixes)
    first = materialize(named.groupBy("component").agg(F.min("rep").alias("rep"), F.count("*").alias("n")), "first")
    label = join_groups(named.select("node", "component"), first, "component", named.count()).select("node", "rep")
    out = rows.join(label.hint("merge"), "node", "left")
    own = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("row") == F.col("rep.row"))
    return out.select("doc_id", "row", "n_shingles", "node", F.col("rep.doc_id").alias("first_id"), (F.col("node").isNull() | own).alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, margin: float = 0.15) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are runs of
    non-white characters with A-Z lower-cased. Returns ``doc_id, n_shingles, component_id,
    kept``: the component is named by its smallest doc_id, whose row is kept. A null or
    empty text has an empty set and is linked with nothing. Rows with a null doc_id have a
    null component and are kept; rows that repeat a doc_id are each judged on their text.
    There are as many bands as it takes for a pair at the threshold to miss all of them
    with a probability below 1e-6, whatever the threshold; pairs that share a bucket are decided exactly. ``margin`` is how far below the threshold an
    estimate may lie for the pair to be confirmed on full sets (over four deviations).
    """
    out = near_duplicate_rows(docs, k, percent, margin)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles at a similarity of 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Distinct sets are joined on shared shingles, and classes reach each other along links.
ORACLE_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
c AS (SELECT min(doc_id) AS cls, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
m AS (SELECT doc_id, cls, c.n FROM s JOIN c ON list_sort(s.s) = c.s),
u AS (SELECT cls, n, unnest(s) AS g FROM c),
p AS (SELECT a.cls AS a, b.cls AS b FROM u a JOIN u b ON a.g = b.g AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.cls, b.cls HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT cls, cls FROM c WHERE n > 0 UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, CAST(m.n AS BIGINT) AS n_shingles, CASE WHEN m.n = 0 THEN doc_id ELSE k.component END AS component_id, doc_id = CASE WHEN m.n = 0 THEN doc_id ELSE k.component END AS kept FROM m LEFT JOIN k ON k.a = m.cls"""
