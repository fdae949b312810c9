"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items.

The index holds, for each term, its impact on the items and the largest impact in each
block of items. As in block-max WAND, a passage looks at a block of items only if the
bounds of the terms it holds can reach the threshold, and scores only the items of such
blocks. Scores are shares of an item's own score, so one threshold holds for all items.
Hits at the threshold are verified by the five-word shingles of the item's question and answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, hash_spans, materialize, mix64, read_table, slices, text_bytes, word_spans

_U = np.uint64
K1, B = 1.2, 0.75
RETRIEVE = 0.5  # share of an item's own BM25 score
REST = 0.2  # at most this share is left to an item's common terms when candidates are looked up
OVERLAP, PART = 0.8, 0.5  # share of an item's shingles, and of its question's and answer's
SHINGLE, GROUP = 5, 4  # words in a shingle, items in a block of the index
INDEX_BYTES = 64 << 20  # text of test items held in one index; more items make more passes

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the alphanumeric words (A-Z and Latin-1 capitals folded) and word offsets of the rows."""
    data, rows = text_bytes(column)
    data = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[after] += 32
    for lead, width in ((0xC2, 2), (0xE2, 3)):  # Latin-1 signs, general punctuation and symbols
        at = np.flatnonzero(data == lead)
        for j in range(width):
            data[np.minimum(at + j, len(data) - 1)] = 32
    starts, ends, offsets = word_spans(data, rows, _IS_TERM)
    return hash_spans(data, starts, ends), offsets


def shingles(h: np.ndarray) -> np.ndarray:
    acc = np.zeros(max(0, len(h) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        acc = mix64(acc + h[j : len(h) - SHINGLE + 1 + j] + _U(j + 1))
    return acc


def _question_words(text: str) -> int:
    """Number of words before the last sentence (0: one sentence only)."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)|\n+(?=\S)", text)]
    return int(terms(pa.array([text[: cut[-1]]]))[1][-1]) if cut else 0


@dataclass
class Index:
    window: int  # words in a passage; passages start every half window
    items: list[int]
    vocab: np.ndarray  # sorted term hashes
    known: np.ndarray  # by the top 16 bits, whether a term may be there
    impact: list[dict[int, float]]  # by item, the share of each term
    post_at: np.ndarray  # offsets of each term's looked-up blocks
    post_block: np.ndarray
    post_bound: np.ndarray
    rest: np.ndarray  # by block, what the terms that are not looked up may add
    grams: list[np.ndarray]
    answer: list[np.ndarray]  # by item, whether a shingle ends in the answer


@dataclass
class Facts:
    """What BM25 needs of all test items: their number, mean length, and how many hold each term (sorted hashes)."""

    items: int
    mean: float
    term: np.ndarray
    df: np.ndarray


def facts_of(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of items, their mean length in terms, and (term, df) of all items, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, at = terms(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[new].view(np.int64), 0)), pa.array(np.append(np.ones(new.sum(), np.int64), 0)), pa.array(np.append(np.zeros(new.sum(), np.int64), len(h)))], names=["term", "n", "length"])

    each = materialize(items.select("text").mapInArrow(run, "term long, n long, length long"), "terms")
    size = each.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return (n := items.count()), max(1.0, size / max(1, n)), materialize(each.where("n > 0").groupBy("term").agg(F.sum("n").alias("df")), "df")


def build_index(rows: list[tuple[int, str]], window: int, facts: Facts) -> Index:
    h, at = terms(pa.array([t for _, t in rows], pa.string()))
    vocab, ids = np.unique(h, return_inverse=True)
    per = [np.unique(ids[lo:hi], return_counts=True) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    df = facts.df[np.searchsorted(facts.term, vocab)]
    idf = np.log(1 + (facts.items - df + 0.5) / (df + 0.5))
    mean = facts.mean
    impact, looked, rest = [], [], []
    for i, (t, tf) in enumerate(per):
        w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (at[i + 1] - at[i]) / mean))
        w /= w.sum()
        impact.append(dict(zip(t.tolist(), w.tolist(), strict=True)))
        order = np.lexsort((t, -idf[t]))
        left = 1 - np.cumsum(w[order])
        n = int(np.argmax(left <= REST)) + 1
        looked.append(set(t[order[:n]].tolist()))
        rest.append(max(0.0, float(left[n - 1])))
    blocks = -(-len(rows) // GROUP)
    bound: list[dict[int, float]] = [{} for _ in vocab]
    for i, own in enumerate(impact):
        for t in looked[i]:
            bound[t][i // GROUP] = max(bound[t].get(i // GROUP, 0.0), own[t])
    for i, own in enumerate(impact):  # a term looked up for one item of a block bounds the others too
        for t, w in own.items():
            if i // GROUP in bound[t]:
                bound[t][i // GROUP] = max(bound[t][i // GROUP], w)
    known = np.zeros(1 << 16, dtype=bool)
    known[(vocab >> _U(48)).astype(np.int64)] = True
    grams, answer = [], []
    for i, (_, text) in enumerate(rows):
        own = h[at[i] : at[i + 1]]
        grams.append(shingles(own))
        answer.append(np.arange(len(own) - SHINGLE + 1) + SHINGLE - 1 >= _question_words(text))
    return Index(
        window, [i for i, _ in rows], vocab, known, impact, np.concatenate([[0], np.cumsum([len(x) for x in bound])]).astype(np.int64),
        np.array([k for x in bound for k in x], dtype=np.int64), np.array([v for x in bound for v in x.values()]),
        np.array([max(rest[i : i + GROUP]) for i in range(0, len(rows), GROUP)]) if blocks else np.zeros(0), grams, answer,
    )


def build_indexes(rows: list[tuple[int, str]], facts: Facts) -> tuple[list[Index], dict[int, list[int]]]:
    """An index for each length class of items, so that no passage is much longer than its items, and short items by their hash."""
    h, at = terms(pa.array([t for _, t in rows], pa.string()))
    classes: dict[int, list] = {}
    short: dict[int, list[int]] = {}
    for row, lo, hi in zip(rows, at[:-1], at[1:], strict=True):
        if hi - lo >= SHINGLE:
            classes.setdefault(64 << max(0, 2 * -(-(int(hi - lo) - 1).bit_length() // 2) - 6), []).append(row)
        elif hi > lo:
            short.setdefault(_whole(h[lo:hi]), []).append(row[0])
    return [build_index(own, 2 * longest, facts) for longest, own in sorted(classes.items())], short


def _whole(h: np.ndarray) -> int:
    acc = np.full(1, len(h), np.uint64)
    for x in h:
        acc = mix64(acc * _U(31) + x)
    return int(acc[0])


def _candidates(x: Index, ids: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(passage start, block) rows whose bound reaches the threshold; ids: term of each word or -1."""
    hit = np.flatnonzero(ids >= 0)
    hit = hit[x.post_at[ids[hit] + 1] > x.post_at[ids[hit]]]
    half = x.window // 2
    first = at[row[hit]]
    late = (hit - first) // half  # the passage that starts last before the word; the one before it has the word too
    pos = np.concatenate([first + late * half, (first + (late - 1) * half)[late > 0]])
    term = np.concatenate([ids[hit], ids[hit][late > 0]])
    pair = np.unique(np.stack([pos, term], axis=1), axis=0) if len(pos) < 2 else None
    if pair is None:
        key = np.unique(pos * len(x.vocab) + term)
        pos, term = key // len(x.vocab), key % len(x.vocab)
    else:
        pos, term = pair[:, 0], pair[:, 1]
    n = x.post_at[term + 1] - x.post_at[term]
    entry = np.repeat(x.post_at[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    key = np.repeat(pos, n) * len(x.rest) + x.post_block[entry]
    key, back = np.unique(key, return_inverse=True)
    reach = np.bincount(back, weights=x.post_bound[entry], minlength=len(key)) + x.rest[key % len(x.rest)]
    key = key[reach >= RETRIEVE - 1e-9]
    return np.stack([key // len(x.rest), key % len(x.rest)], axis=1)


def _match(column: pa.Array, indexes: list[Index], short: dict[int, list[int]]) -> list[tuple]:
    """(row, item, score, question overlap, answer overlap) of each verified hit."""
    h, at = terms(column)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    best: dict[tuple[int, int], tuple] = {}
    for i in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SHINGLE)) if short else ():
        for item in short.get(_whole(h[at[i] : at[i + 1]]), ()):
            best[int(i), item] = (1.0, 1.0, 1.0)
    for x in indexes:
        ids = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(x.known[(h >> _U(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(x.vocab, h[maybe]), len(x.vocab) - 1)
        fits = x.vocab[spot] == h[maybe]
        ids[maybe[fits]] = spot[fits]
        for start, block in _candidates(x, ids, row, at):
            own = slice(start, min(start + x.window, at[row[start] + 1]))
            held, grams = set(ids[own].tolist()), None
            for i in range(block * GROUP, min((block + 1) * GROUP, len(x.items))):
                score = sum(w for t, w in x.impact[i].items() if t in held)
                if score < RETRIEVE:
                    continue
                grams = shingles(h[own]) if grams is None else grams
                found = np.isin(x.grams[i], grams)
                answer = x.answer[i]
                a = float(found[answer].mean()) if answer.any() else float(found.mean())
                q = float(found[~answer].mean()) if (~answer).any() else float(found.mean())
                if found.mean() >= OVERLAP and min(a, q) >= PART:
                    key = (int(row[start]), x.items[i])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
    return [(*k, *v) for k, v in sorted(best.items(), key=lambda kv: kv[0])]


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of test items found in documents.

    Passages cover every whole text, so an item that a document holds is wholly inside one.
    Null and empty texts match nothing, and an item of fewer than five words only a document that is that item as a whole.
    Scores at the threshold count; of several passages with an item the best counts (ties: the same values). Term weights come from all items, whatever
    passes they are dealt to. Repeated rows are each reported; columns other than ``keys``, which name a row, are ignored. The index is broadcast and holds at most
    ``index_bytes`` of item text: a larger benchmark is dealt to several passes over the documents.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // index_bytes))
    n, mean, df = facts_of(items)
    out = None
    for i in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        rows = sorted((r["item_id"], r["text"]) for r in own.collect())  # bounded by index_bytes
        held = np.unique(terms(pa.array([t for _, t in rows], pa.string()))[0]).view(np.int64)
        if passes == 1:
            counted = df.collect()
        else:  # the terms of this pass only
            mine = spark.createDataFrame([(int(x),) for x in held], "term long")
            counted = df.join(mine.hint("merge"), "term", "left_semi").collect()
        pairs = np.array(sorted((r["term"] % 2**64, r["df"]) for r in counted), dtype=np.uint64).reshape(-1, 2)
        shared = spark.sparkContext.broadcast(build_indexes(rows, Facts(n, mean, pairs[:, 0], pairs[:, 1].astype(np.int64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                hits = _match(b.column("text"), *shared.value)
                cols = list(zip(*hits, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).take(pa.array(cols[0], pa.int64())) for k in keys], pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                    names=[*keys, "item_id", "score", "question_overlap", "answer_overlap"],
                )

        named = ", ".join(f"{k} long" for k in keys)
        found = docs.select(*keys, "text").mapInArrow(run, f"{named}, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_benchmark_text(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
