"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

Each word gets a score per language, the log-likelihood of its byte trigrams (white space
counts as a boundary). Languages whose training text lacks the word's script are ruled out.
A Viterbi pass with a penalty for each switch labels every word; all documents of a batch
advance together, so the pass is a loop over word positions and not over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_WORD, _LOWER, read_table, slices, text_bytes, word_spans

SLOTS = 1 << 17
SAMPLE = 20_000  # labelled rows that the models are fitted on, at most
SWITCH = 12.0  # natural log units for a change of language between two words
RARE = 0.001  # a script with a smaller share of a language's letters is not its own
OUT = -1e4

_SPACED = _LOWER.copy()
_SPACED[[9, 10, 11, 12, 13]] = 32


#: First code points of blocks whose letters are of one script: 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 9 other, 10 East Asian.
_BLOCKS = ((0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 9), (0x1E00, 1), (0x1F00, 2), (0x2000, 9), (0x2E80, 10), (0xA000, 9), (0xAC00, 10), (0xD800, 9), (0xF900, 10), (0xFB00, 9), (0xFF00, 10), (0x10000, 9), (0x20000, 10), (0x32000, 9))


def _scripts() -> np.ndarray:
    """Script number of every code point; 0: not a letter."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    starts = np.array([c for c, _ in _BLOCKS])
    return np.where(letter, np.array([n for _, n in _BLOCKS], np.uint8)[np.searchsorted(starts, np.arange(0x110000), side="right") - 1], 0).astype(np.uint8)


_SCRIPT: list[np.ndarray] = []  # made once a process


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # SLOTS x languages, float32 log-probabilities
    scripts: np.ndarray  # 16 x languages, whether the language uses the script


def _features(data: np.ndarray) -> np.ndarray:
    """Slot of the trigram that ends at each byte; the text starts after a space."""
    d = np.full(len(data) + 2, 32, dtype=np.uint32)
    d[2:] = _SPACED[data]
    x = d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)
    return (x ^ (x >> np.uint32(15))) & np.uint32(SLOTS - 1)


def _script_bytes(data: np.ndarray) -> np.ndarray:
    """Script of the letter that starts at each byte of UTF-8 text; 0 elsewhere."""
    if not _SCRIPT:
        _SCRIPT.append(_scripts())
    out = _SCRIPT[0][np.where(data < 0x80, data, 0)]
    out[data >= 0x80] = 0
    for lo, hi, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        at = np.flatnonzero((data >= lo) & (data < hi))
        at = at[at + more < len(data)]
        point = data[at].astype(np.int64) & ((1 << (6 - more)) - 1)
        for k in range(1, more + 1):
            point = point << 6 | data[at + k].astype(np.int64) & 63
        out[at] = _SCRIPT[0][np.minimum(point, 0x10FFFF)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in slices(batches):
        data, rows = text_bytes(b.column("text"))
        if not len(data):
            continue
        slots, scripts = _features(data), _script_bytes(data)
        for lang in set(langs := b.column("lang").to_pylist()):
            own = np.concatenate([np.arange(lo, hi) for lo, hi, x in zip(rows[:-1], rows[1:], langs, strict=True) if x == lang])
            seen = total.setdefault(lang, np.zeros(SLOTS + 16, dtype=np.int64))
            seen[:SLOTS] += np.bincount(slots[own], minlength=SLOTS)
            seen[SLOTS:] += np.bincount(scripts[own], minlength=16)
    for lang, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tobytes()], pa.binary())], names=["lang", "counts"])


def _add(g: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": g["lang"].iloc[:1], "counts": [np.sum([np.frombuffer(x, np.int64) for x in g["counts"]], axis=0).tobytes()]})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``; at most about ``sample`` rows, chosen by a hash of the id.

    Only one fixed-size table of counts for each language reaches the driver.
    """
    rows = labelled.where("text is not null and lang is not null").withColumn("_pick", F.xxhash64("doc_id"))
    last = rows.select("_pick").orderBy("_pick").limit(sample).agg(F.max("_pick")).first()[0]
    if last is None:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((16, 0), bool))
    picked = rows.where(F.col("_pick") <= last).select("text", "lang")
    counts = picked.mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInPandas(_add, "lang string, counts binary").collect()
    counts = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in counts)
    n = np.stack([c[:SLOTS] for _, c in counts], axis=1).astype(float)
    used = np.count_nonzero(n.sum(1))
    table = np.log((n + 0.05) / (n.sum(0) + 0.05 * (used + 1)))
    letters = np.stack([c[SLOTS:] for _, c in counts], axis=1).astype(float)
    letters[0] = 0
    return Model([x for x, _ in counts], table.astype(np.float32), letters >= RARE * np.maximum(letters.sum(0), 1))


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word in each language, and its script (0: no letter)."""
    out = np.empty((len(starts), len(m.langs)), dtype=np.float32)
    script = np.zeros(len(starts), dtype=np.uint8)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + (1 << 22) // max(8, len(m.langs)), side="right")))
        hi = min(int(ends[j - 1]) + 1, len(data))
        piece = data[lo:hi] if hi > ends[j - 1] else np.append(data[lo:hi], np.uint8(32))
        sums = np.zeros((len(piece) + 1, out.shape[1]))
        np.cumsum(m.table[_features(piece)], axis=0, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = sums[e + 1] - sums[s]
        script[i:j] = np.maximum.reduceat(_script_bytes(piece), s)
        i = j
    ruled = m.scripts[script]
    ruled |= ~ruled.any(axis=1)[:, None]
    out += np.where(ruled, 0, OUT).astype(np.float32)
    return out, script


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; ``at`` has the word offsets (n+1) of the rows."""
    label = np.zeros(len(scores), dtype=np.int32)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order) or scores.shape[1] < 2:
        return label
    first, size = at[order].astype(np.int64), size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # rows with more than t words
    moved, best = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int32)
    v = scores[first].astype(np.float64)
    for t in range(1, size[0]):
        n = alive[t]
        top = v[:n].max(axis=1)[:, None] - switch
        here = first[:n] + t
        moved[here], best[here] = top > v[:n], v[:n].argmax(axis=1)
        v[:n] = np.maximum(v[:n], top) + scores[here]
    now = v.argmax(axis=1)  # of each row's last word; a row's values rest once it ends
    lanes = np.arange(len(first))
    for t in range(size[0] - 1, -1, -1):
        n = alive[t]
        here = first[:n] + t
        label[here] = now[:n]
        turn = moved[here, now[lanes[:n]]]
        now[:n] = np.where(turn, best[here], now[:n])
    return label


def _label(model, spans: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in slices(batches, 8 << 20):
            column = b.column("text")
            data, rows = text_bytes(column)
            starts, ends, at = word_spans(data, rows, _IS_WORD)
            n = b.num_rows
            if len(starts) and m.langs:
                scores, script = word_scores(data, starts, ends, m)
                label = viterbi(scores, at, SWITCH)
                row = np.repeat(np.arange(n), np.diff(at))
                weight = np.bincount(row * len(m.langs) + label, weights=(script > 0).astype(float), minlength=n * len(m.langs)).reshape(n, -1)
            else:
                label, weight = np.zeros(len(starts), np.int32), np.zeros((n, max(1, len(m.langs))))
            total = weight.sum(axis=1)
            pred, share = weight.argmax(axis=1), weight.max(axis=1) / np.maximum(total, 1)
            told, score, parts = [], [], []
            for i in range(n):
                known = bool(m.langs) and total[i] > 0
                told.append(m.langs[pred[i]] if known else "und")
                score.append(float(share[i]) if known else 0.0)
                if spans:
                    own = label[at[i] : at[i + 1]]
                    cut = np.flatnonzero(np.diff(own)) + 1
                    parts.append([{"first": int(x), "last": int(y), "lang": m.langs[own[x]] if m.langs else "und"} for x, y in zip([0, *cut], [*cut, len(own)], strict=True) if y > x])
            new = [pa.array(told, pa.string()), pa.array(score, pa.float64())]
            if spans:
                new.append(pa.array(parts, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))))
            kept = [c for c, x in zip(b.columns, b.schema.names, strict=True) if x not in RESULT]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=names)

    return run


RESULT = ("_lang_pred", "_score", "_spans")


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_score`` (0 to 1), the share of words with letters in that language.

    With ``spans``, ``_spans`` lists the runs of words (numbers, end exclusive) and their
    languages. A null text or one without a letter (by code point) is ``und`` with score 0; so is every text
    if nothing was learned. Ties go to the language that sorts first. Whole texts are read, however long;
    repeated rows are each labelled. Only ``text`` is read; other columns pass
    through, but columns that have the name of a result are replaced.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in RESULT]
    new = ["_lang_pred string", "_score double", *(["_spans array<struct<first:bigint,last:bigint,lang:string>>"] if spans else [])]
    names = [*[f.name for f in docs.schema.fields if f.name not in RESULT], *RESULT[: len(new)]]
    return docs.mapInArrow(_label(broadcast, spans, names), ", ".join([*kinds, *new]))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "text", "lang")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn on two thirds of the documents, label all."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
