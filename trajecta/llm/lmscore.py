"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased), then one end, coded in order as bits. Where the last four
words occur in another training text, or the last two earlier in this one, a first bit tells whether
the word that followed there comes again. Else a bit tells whether training text has the word, and more bits follow the
path of its hashed class in a prefix code, down to a group of rare classes. Each bit is predicted by counts in
several hashed contexts: none, the last frequent word, the last two, the word before (for the
first bit how often such guesses came true in a row). The stretched predictions are combined by weights that a gate selects, and
a table by gate and prediction refines the result. Weights start from a fit to training
text and go on learning while a text is scored, block by block. Inside its group a word has the
share of its count; a new word is spelled by bit predictors of its bytes.

A training document is always predicted without its own occurrence, word by word, so it is
scored like a new text. Word counts meet in a window over (batch, word) rows and go back to the
batches, and continuations of four-word runs are joined back; both grow with the corpus and stay with the executors. Context tables
grow up to a fixed size. Nothing depends on how the input is partitioned: counts are
integers, fits are rounded, and each document is scored alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, spelling
from .common import _LOWER, discard, hash_spans, mix64, read_table, slices, text_bytes, word_spans

_U, _U32 = np.uint64, np.uint32
CLASSES = 1 << 16  # hashed classes of words; one more is the end of a text
END, START, NONE = CLASSES, CLASSES + 1, CLASSES + 2
KNOWN = 20  # the bit of a coded token that tells whether training text has it
OFTEN = 512  # classes so frequent that the last of them says what kind of text this is
DEPTH = 12  # decisions on the path to a class; classes that part further down are one group
BITS = (17, 20, 21, 21)  # of the context tables, at most; a bound on the model's memory
RUNS = 16  # numbers of guesses in a row that are told apart
INPUTS, GATES, STEPS = len(BITS), 18, 33  # gates: 3 amounts seen of the word before, 2 of two frequent ones, 3 kinds of decision
FRESH = (0.3, 0.3, 0.3, 0.3)  # weights before any fit
BLOCK, RATE = 32, 0.001  # words after which a text's weights are updated, and by how much
PIECE = 1 << 13  # words whose bits are worked out at a time; their arrays stay in a core's cache
PLACE = 30  # bits of a token's place in what is read at a time; a text has at most 2^31 bytes, so fewer words
GRAM, EVERY, NEXT = 4, 16, 24  # words of a run, share of the runs that are looked up (one in), words told of what followed


# ---------------------------------------------------------------- codes and contexts


@dataclass
class ClassCode:
    """A prefix code of the classes (number of bits, offsets into its steps) and the tables' sizes."""

    size: np.ndarray
    at: np.ndarray
    step: np.ndarray  # node * 2 + bit; the last one is a filler
    often: np.ndarray
    count: np.ndarray  # of each class in training text
    group: np.ndarray  # count of all classes that share its path
    bits: list[int]  # of the context tables
    offsets: np.ndarray


def class_code(counts: np.ndarray) -> ClassCode:
    """Code of the classes with a count (classes and the end); nodes 0 and 1 are kept for whether a word is known, and guessed."""
    leaves = np.flatnonzero(counts)
    n = len(leaves)
    heap = [(int(counts[c]), i) for i, c in enumerate(leaves)]
    heapq.heapify(heap)
    up, side = np.zeros(max(1, 2 * n), np.int64), np.zeros(max(1, 2 * n), np.uint8)
    new = n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y], side[y] = new, new, 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    depth = np.zeros(max(1, 2 * n), np.int64)
    for x in range(new - 2, -1, -1):
        depth[x] = depth[up[x]] + 1
    total = np.zeros(max(1, 2 * n), np.int64)
    total[:n] = counts[leaves]
    for x in range(new - 1):  # children come before their parents
        total[up[x]] += total[x]
    now = np.arange(n)  # where the path to each class ends
    while (on := np.flatnonzero(depth[now] > DEPTH)).size:
        now[on] = up[now[on]]
    size, group = np.zeros(CLASSES + 3, np.int64), np.ones(CLASSES + 3, np.int64)
    size[leaves], group[leaves] = depth[now], total[now]
    at, left = np.concatenate([[0], np.cumsum(size)]), depth[now].copy()
    step = np.zeros(at[-1] + 1, np.uint32)
    while (on := np.flatnonzero(left > 0)).size:
        step[at[leaves[on]] + left[on] - 1] = 2 * (up[now[on]] - n + 2) + side[now[on]]
        now[on], left[on] = up[now[on]], left[on] - 1
    often = np.zeros(CLASSES + 3, bool)
    often[sorted((c for c in leaves if c < CLASSES), key=lambda c: (-counts[c], c))[:OFTEN]] = True
    grown = int(counts.sum()).bit_length()  # tables grow with the text up to their bound
    bits = [BITS[0], *[max(12, min(most, grown - (BITS[-1] - most))) for most in BITS[1:]]]
    return ClassCode(size, at, step, often, counts, group, bits, np.concatenate([[0], np.cumsum([1 << b for b in bits])]))


@dataclass
class Tokens:
    """Tokens of some documents in order, their contexts, and what a match guesses (a class, -1: nothing)."""

    cls: np.ndarray
    known: np.ndarray
    own: np.ndarray  # whether training counts hold this occurrence
    at: np.ndarray  # offsets (n+1) of the documents
    context: np.ndarray  # orders 1 and up x tokens
    guess: np.ndarray
    hit: np.ndarray  # whether the guess is right
    record: np.ndarray  # two contexts x tokens, for that: how many guesses before it came true, and this with the word before


def tokens_of(value: np.ndarray, at: np.ndarray, learn: np.ndarray, told: np.ndarray, often: np.ndarray) -> Tokens:
    """Tokens from their coded values; ``told`` is what the corpus match guesses."""
    n = len(value)
    cls, t = (value & ((1 << KNOWN) - 1)).astype(np.int64), np.arange(n)
    size = np.diff(at)
    first = np.repeat(at[:-1], size)
    latest = np.maximum.accumulate(np.where(often[cls], t, -1)) if n else t

    def frequent(i: np.ndarray) -> np.ndarray:
        """The last frequent token before token i of the same text, or -1."""
        found = np.where(i > first, latest[np.maximum(i - 1, 0)], -1)
        return np.where(found >= first, found, -1)

    f1 = frequent(t)
    f2 = np.where(f1 >= 0, frequent(f1), -1)
    named = lambda i: np.where(i >= 0, cls[i], NONE).astype(np.uint64)
    back = lambda k: np.where(t - k >= first, cls[np.maximum(t - k, 0)], START).astype(np.uint64)
    w1, w2 = back(1), back(2)
    hashed = lambda x, k: (mix64(x + (_U(k) << _U(50))) >> _U(32)).astype(np.uint32)
    n1 = named(f1)
    context = np.stack([hashed(n1, 1), hashed(n1 << _U(20) | named(f2), 2), hashed(w1, 3)])
    doc = np.repeat(np.arange(len(size)), size)
    on = np.flatnonzero(t - 2 >= first)
    # two classes (17 bits each) and the place: plain sorting keeps the order of the text
    key = w1[on] << _U(17 + PLACE) | w2[on] << _U(PLACE) | on.astype(np.uint64)
    key.sort()
    spot = (key & _U((1 << PLACE) - 1)).astype(np.int64)
    key >>= _U(PLACE)
    same = (key[1:] == key[:-1]) & (doc[spot[1:]] == doc[spot[:-1]])
    guess = np.full(n, -1, np.int64)
    guess[spot[1:][same]] = cls[spot[:-1][same]]
    guess = np.where(told >= 0, told, guess)
    known = (value >> KNOWN & 1).astype(np.int64)
    hit = (guess == cls) & (known > 0)
    missed = np.maximum.accumulate(np.where(hit, 0, t + 1)) if n else t
    run = np.zeros(n, np.int64)
    run[1:] = np.minimum(t[1:] - missed[:-1], RUNS - 1)
    run[at[:-1][size > 0]] = 0
    asked = np.flatnonzero(guess >= 0)
    run = run[asked].astype(np.uint64) + (_U(RUNS) * (told[asked] >= 0).astype(np.uint64))
    record = np.zeros((2, n), np.uint32)
    record[0, asked], record[1, asked] = hashed(run, 5), hashed(run << _U(20) | w1[asked], 6)
    return Tokens(cls, known, np.repeat(learn, size), at, context, guess, hit, record)


@dataclass
class Decisions:
    size: np.ndarray  # of each token asked for
    bit: np.ndarray
    kind: np.ndarray  # 0: on the path to a class, 1: whether the word is known, 2: whether it is the one guessed
    slot: list[np.ndarray]  # by order, places in the context tables


def decisions(f: Tokens, w: np.ndarray | slice, code: ClassCode) -> Decisions:
    """All decisions of the tokens ``w``, in their order."""
    cls, known, hit = f.cls[w], f.known[w], f.hit[w]
    guessed = (f.guess[w] >= 0).astype(np.int64)
    size = guessed + np.where(hit, 0, 1 + known * code.size[cls])
    first = np.cumsum(size) - size
    spot = np.repeat(code.at[cls] - 1 - guessed - first, size)
    spot += np.arange(len(spot))
    flag, asked = (first + guessed)[~hit], first[guessed > 0]
    spot[flag] = spot[asked] = len(code.step) - 1
    step = np.take(code.step, spot, mode="clip")  # all places exist; numpy takes faster if it need not check them first
    step[flag], step[asked] = known[~hit], 2 + hit[guessed > 0]
    kind = np.zeros(len(spot), np.int8)
    kind[flag], kind[asked] = 1, 2
    bit = step.astype(np.int8)
    bit &= np.int8(1)
    step >>= _U32(1)
    slot, node, high = [step.view(np.int32)], step * _U32(0x9E3779B1), np.empty_like(step)
    for k, context in enumerate(f.context, start=1):
        x = np.repeat(context[w], size)
        if k < 3:
            x[asked] = f.record[k - 1, w][guessed > 0]
        x += node
        x *= _U32(0x85EBCA6B)
        x ^= np.right_shift(x, _U32(15), out=high)
        x *= _U32(0xC2B2AE35)
        x >>= _U32(32 - code.bits[k])
        x += _U32(code.offsets[k])
        slot.append(x.view(np.int32))
    return Decisions(size, bit, kind, slot)


# ---------------------------------------------------------------- counting and mixing


def empty_counts(code: ClassCode) -> np.ndarray:
    return np.zeros(2 * int(code.offsets[-1]), np.int64)


def _pieces(f: Tokens) -> Iterator[slice]:
    return (slice(lo, min(lo + PIECE, len(f.cls))) for lo in range(0, len(f.cls), PIECE))


def count_tokens(f: Tokens, code: ClassCode, counts: np.ndarray) -> None:
    """Add the decisions of all tokens to the context tables."""
    one = counts.dtype.type(1)
    for w in _pieces(f):
        d = decisions(f, w, code)
        for slot in d.slot:
            place = slot.astype(np.int64)
            place *= 2
            place += d.bit
            np.add.at(counts, place, one)


@dataclass
class Model:
    code: ClassCode | None
    counts: np.ndarray | None  # of both bits in one number for each place, scaled to 16 bits
    weights: np.ndarray  # gates x inputs
    refine: np.ndarray  # gates x steps x 2


def fresh_refinement() -> np.ndarray:
    p = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    return np.repeat(20 * np.stack([1 - p, p], 1)[None], GATES, 0)


def scaled(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both bits in 16 bits each, in about their proportion; what was seen stays seen."""
    scale = np.maximum(-(-np.maximum(n0, n1) // 65535), 1)
    return (-(-n0 // scale)).astype(np.uint16), (-(-n1 // scale)).astype(np.uint16)


def model_of(counts: np.ndarray, code: ClassCode) -> Model:
    small = [x.astype(np.uint32) for x in scaled(counts[::2], counts[1::2])]
    return Model(code, small[0] | small[1] << _U32(16), np.tile(FRESH, (GATES, 1)), fresh_refinement())


def inputs(f: Tokens, w: np.ndarray | slice, d: Decisions, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (inputs x decisions) and the gate of each decision."""
    n = len(d.bit)
    x, gate = np.empty((INPUTS, n), np.float32), d.kind * np.int8(6)
    less = d.bit.astype(np.uint32)  # without the own occurrence
    less *= _U32(0xFFFF)
    less += _U32(1)
    less *= np.repeat(f.own[w].astype(np.uint32), d.size)
    seen, n1, down = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.float32)
    for k, (slot, up) in enumerate(zip(d.slot, x, strict=True)):
        np.take(m.counts, slot, out=seen, mode="clip")
        seen -= less
        np.right_shift(seen, _U32(16), out=n1)
        seen &= _U32(0xFFFF)
        np.add(n1.view(np.int32), np.float32(0.4), out=up, dtype=np.float32, casting="unsafe")
        np.add(seen.view(np.int32), np.float32(0.4), out=down, dtype=np.float32, casting="unsafe")
        up /= down
        np.log(up, out=up)
        if k > 1:
            n1 += seen
            much = (n1 > 7).view(np.int8)
            if k == 2:
                much *= np.int8(3)
            else:
                gate += (n1 > 0).view(np.int8)
            gate += much
    return x, gate


def fit_sums(f: Tokens, m: Model) -> np.ndarray:
    """For each gate, gradient and curvature of the log-likelihood at the model's weights (gates x inputs x inputs+1)."""
    out = np.zeros((GATES, INPUTS, INPUTS + 1))
    for w in _pieces(f):
        d = decisions(f, w, m.code)
        x, gate = inputs(f, w, d, m)
        order = np.argsort(gate, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))])
        sorted_x, bit = np.take(x, order, axis=1, mode="clip"), np.take(d.bit, order)
        for g, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if lo == hi:
                continue
            z = sorted_x[:, lo:hi].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(m.weights[g] @ z, -12, 12)))
            out[g, :, 0] += z @ (bit[lo:hi] - p)
            out[g, :, 1:] += (z * (p * (1 - p))) @ z.T
    return out


def score_tokens(f: Tokens, m: Model, refine: np.ndarray | None = None) -> np.ndarray:
    """Natural-log probability of the words of each document in their groups.

    All documents go on together, a block of each at a time; each starts from the model's weights and updates
    its own after every block. With ``refine``, what the mixed predictions met is added to that table.
    """
    size = np.diff(f.at)
    lanes = np.argsort(-size, kind="stable")
    lane = np.empty(len(size), np.int64)
    lane[lanes] = np.arange(len(size))
    doc = np.repeat(np.arange(len(size)), size)
    step = (np.arange(len(doc)) - f.at[doc]) // BLOCK
    order = np.lexsort((lane[doc], step))
    edge = np.searchsorted(step[order], np.arange(int(step.max(initial=-1)) + 2))
    # of every lane and gate two pairs of weights, each taken and updated at once, as one number
    pairs = [np.tile(m.weights[:, k : k + 2].astype(np.float32), (len(size), 1)) for k in range(0, INPUTS, 2)]
    chance = (0.5 * m.refine / m.refine.sum(-1, keepdims=True)).astype(np.float32).ravel()  # half of what the table says of a bit
    inside = np.log(np.maximum(m.code.group[f.cls] - f.own, 1) / np.maximum(m.code.count[f.cls] - f.own, 1))  # a right guess tells the class
    total, s = np.bincount(doc, weights=np.where(f.hit, inside, 0), minlength=len(size))[lanes], 0  # by lane
    while s < len(edge) - 1:
        end = max(s + 1, int(np.searchsorted(edge, edge[s] + PIECE, side="right")) - 1)
        w = order[edge[s] : edge[end]]
        d = decisions(f, w, m.code)
        x, gate = inputs(f, w, d, m)
        tokens, firsts = lane[doc[w]], np.concatenate([[0], np.cumsum(d.size)])
        cut = firsts[edge[s : end + 1] - edge[s]]
        spot, dots = np.repeat(tokens * GATES, d.size), np.empty(len(gate), np.float32)
        spot += gate
        chances, change = np.empty(len(gate), np.float32), np.empty((int(np.diff(cut).max(initial=0)), 2), np.float32)
        for step_of, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True), start=s + 1):
            at, z, dot, moved = spot[lo:hi], x[:, lo:hi], dots[lo:hi], change[: hi - lo]
            for k, pair in enumerate(pairs):
                own = np.take(pair.view(np.float64).ravel(), at, mode="clip").view(np.float32).reshape(-1, 2)
                own[:, 0] *= z[2 * k]
                own[:, 1] *= z[2 * k + 1]
                if k:
                    dot += own[:, 0] + own[:, 1]
                else:
                    np.add(own[:, 0], own[:, 1], out=dot)
            np.clip(dot, -12, 12, out=dot)
            p = np.exp(np.negative(dot), out=chances[lo:hi])
            p += 1
            np.reciprocal(p, out=p)
            error = d.bit[lo:hi] - p
            error *= np.float32(RATE)
            n = (int(tokens[edge[step_of] - 1 - edge[s]]) + 1) * GATES  # lanes are in order
            for k, pair in enumerate(pairs):
                np.multiply(error, z[2 * k], out=moved[:, 0])
                np.multiply(error, z[2 * k + 1], out=moved[:, 1])
                met = np.zeros(n, np.complex64)
                np.add.at(met, at, moved.view(np.complex64).ravel())
                pair[:n] += met.view(np.float32).reshape(-1, 2)
        dots *= 2
        dots += 16
        near = np.clip(np.rint(dots, out=dots), 0, STEPS - 1, out=dots).astype(np.int64)
        near += gate.astype(np.int64) * STEPS
        near *= 2
        near += d.bit
        if refine is not None:
            refine += np.bincount(near, minlength=refine.size).reshape(refine.shape)
        chances -= 1 - d.bit  # of the bit that comes: p, or 1 - p
        np.abs(chances, out=chances)
        chances *= np.float32(0.5)
        chances += np.take(chance, near, mode="clip")
        np.clip(chances, 1e-6, 1 - 1e-6, out=chances)
        np.log(chances, out=chances)
        new = np.flatnonzero(np.diff(tokens, prepend=-1))  # each lane's part of a block
        filled = new[firsts[np.append(new[1:], len(tokens))] > firsts[new]]
        np.add.at(total, tokens[filled], np.add.reduceat(chances, firsts[filled], dtype=np.float64) if len(filled) else 0)
        s = end
    out = np.empty(len(size))
    out[lanes] = total
    return out


# ---------------------------------------------------------------- the distributed passes


def materialize(df: DataFrame, name: str) -> DataFrame:
    return common.materialize(df, name, "zstd")  # these tables are as large as the corpus


def _squeeze(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _open(blob: bytes, size: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(pa.decompress(blob, size * dtype.itemsize, codec="zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


_PACK = pa.schema([
    ("batch", pa.int64()), ("h", pa.int64()), ("word", pa.string()), ("n", pa.int64()),
    ("doc_id", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("ids", pa.binary()), ("bytes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
])
_PACKED = "batch long, h long, word string, n long, doc_id array<long>, learn array<boolean>, ends array<long>, ids binary, bytes array<long>, sizes array<long>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of documents: a row for each distinct word with its training count, and one row with the documents."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, b in enumerate(slices(batches, 24 << 20)):
        data, rows = text_bytes(b.column("text"))
        raw = data.tobytes().translate(_LOWER.tobytes())
        data = np.frombuffer(raw, np.uint8)
        starts, ends, at = word_spans(data, rows)
        ids, unique = pd.factorize(hash_spans(data, starts, ends))
        where, order = np.zeros(len(unique), np.int64), np.argsort(unique)
        where[ids[::-1]] = np.arange(len(ids))[::-1]  # a word's first place
        rank = np.empty(len(unique), np.int64)
        rank[order] = np.arange(len(unique))
        unique, where, ids = unique[order], where[order], rank[ids]
        learn, n = np.array(b.column("learn").to_pylist(), bool), len(unique)
        seen = np.bincount(ids, weights=np.repeat(learn, np.diff(at)), minlength=n).astype(np.int64)
        taught, used = np.repeat(learn, np.diff(rows)), np.zeros(256, np.int64)
        for lo in range(0, len(data), 1 << 18):  # bincount widens what it is given
            used += np.bincount(data[lo : lo + (1 << 18)][taught[lo : lo + (1 << 18)]], minlength=256)
        size = np.bincount(np.repeat(np.arange(b.num_rows), np.diff(at)), weights=ends - starts + 1, minlength=b.num_rows).astype(np.int64)
        name = task << 32 | number
        # a word is read again only where it may be new, or told from one other text
        words = pa.array([raw[s:e].decode() if few else None for s, e, few in zip(starts[where].tolist(), ends[where].tolist(), (seen < 2).tolist(), strict=True)], pa.string())
        for lo in range(0, n, 20_000):
            own = min(20_000, n - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(own, name)), pa.array(unique[lo : lo + own].view(np.int64)), words[lo : lo + own], pa.array(seen[lo : lo + own]), *[pa.nulls(own, x.type) for x in list(_PACK)[4:]]],
                schema=_PACK,
            )
        documents = {
            "batch": name, "doc_id": b.column("doc_id").to_pylist(), "learn": learn.tolist(), "ends": at[1:].tolist(), "ids": _squeeze(ids.astype(np.uint32)),
            "bytes": used.tolist(), "sizes": size.tolist(),
        }
        yield pa.RecordBatch.from_pylist([documents], schema=_PACK)


_CODED = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, inside double, size long, seq binary"


def _code(group: np.ndarray, tokens: int, kinds: int, ends: int, spelled_end: float, most: int = 1 << 19):
    """Per batch: each document's tokens as classes, and what of its score doesn't depend on contexts."""
    whole = math.log10(tokens + 0.1 * (kinds + 1))

    def some(doc_ids: list, learn: np.ndarray, ids: np.ndarray, at: np.ndarray, sizes, count, cls, share, smoothed) -> pd.DataFrame:
        n, size = len(doc_ids), np.diff(at) + 1
        doc = np.repeat(np.arange(n), np.diff(at))
        c, own = count[ids], learn[doc].astype(np.int64)
        known = c > own
        part = share[own, ids]
        end_known = ends - learn > 0
        value = np.empty(len(ids) + n, np.int32)
        value[np.arange(len(ids)) + doc] = cls[ids] | known.astype(np.int64) << KNOWN
        value[at[1:] + np.arange(n)] = END | end_known.astype(np.int64) << KNOWN
        base = np.bincount(doc, weights=smoothed[ids], minlength=n) + math.log10(ends + 0.1) - size * whole
        inside = np.bincount(doc, weights=part, minlength=n) + np.where(end_known, 0, spelled_end)
        n_known = np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0)
        edge = np.concatenate([[0], np.cumsum(size)])
        seq = [_squeeze(value[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "learn": learn, "n_tokens": size, "n_known": n_known, "base_score": base, "inside": inside, "size": sizes, "seq": seq})

    def run(_key, docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        h = words["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)  # a batch numbers its words by their hashes
        count, cls, spell = words["c"].to_numpy(np.int64)[order], (h[order] >> _U(48)).astype(np.int64), words["spell"].to_numpy(np.float64)[order]
        # of each word, without and with an occurrence of its own
        share = np.stack([np.where(count > own, np.log(np.maximum(count - own, 1) / np.maximum(group[cls] - own, 1)), spell) for own in (0, 1)])
        smoothed, out = np.log10(count + 0.1), []
        for r in docs.itertuples():
            at = np.concatenate([[0], r.ends]).astype(np.int64)
            ids, learn, lo = _open(r.ids, int(at[-1]), np.uint32), np.array(r.learn, bool), 0
            while lo < len(learn):  # some documents at a time
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
                out.append(some(list(r.doc_id[lo:hi]), learn[lo:hi], ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], r.sizes[lo:hi], count, cls, share, smoothed))
                lo = hi
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _CODED.split(", ")})

    return run


def _tokens(batches: Iterator[pa.RecordBatch], often: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Coded documents of the batches, about ``most`` words (or one document) at a time."""
    for whole in batches:
        size = whole.column("n_tokens").to_numpy()
        ends, start = np.cumsum(size), 0
        while start < whole.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            b = whole.slice(start, stop - start)
            value = np.concatenate([_open(s.as_py(), int(n), np.int32) for s, n in zip(b.column("seq"), size[start:stop], strict=True)])
            at, told = np.concatenate([[0], np.cumsum(size[start:stop])]), np.full(len(value), -1, np.int64)
            found = b.column("told")
            of, found = pc.list_parent_indices(found).to_numpy(), found.flatten()
            first = at[:-1][of] + pc.struct_field(found, "pos").to_numpy() + 1
            words = np.minimum(pc.binary_length(pc.struct_field(found, "next")).to_numpy() // 2, at[1:][of] - 1 - first)  # the end isn't guessed
            order = np.argsort(first, kind="stable")  # of two for one word the later one holds
            said = b"".join(x[: 2 * n] for x, n in zip(pc.struct_field(found, "next").take(pa.array(order)).to_pylist(), words[order].tolist(), strict=True))
            first, words = first[order], words[order]
            told[np.repeat(first - np.cumsum(words) + words, words) + np.arange(int(words.sum()))] = np.frombuffer(said, np.uint16)
            yield b, tokens_of(value, at, np.array(b.column("learn").to_pylist(), bool), told, often)
            start = stop


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word runs that are looked up (chosen by their hash), where each ends, and what follows it."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 1_000):
            b = whole.slice(lo, 1_000)
            size = b.column("n_tokens").to_numpy()
            cls = np.concatenate([_open(s.as_py(), int(n), np.int32) for s, n in zip(b.column("seq"), size, strict=True)]) & ((1 << KNOWN) - 1)
            doc, last = np.repeat(np.arange(b.num_rows), size), np.repeat(np.cumsum(size) - 1, size)  # the end is no word
            gram = np.zeros(max(0, len(cls) - GRAM + 1), np.uint64)
            for k in range(GRAM):
                gram = mix64(gram + cls[k : len(gram) + k].astype(np.uint64) + _U(k + 1))
            on = np.flatnonzero(gram % _U(EVERY) == 0)
            on = on[on + GRAM <= last[on]]
            raw, follow = cls.astype(np.uint16).tobytes(), on + GRAM
            said = [raw[2 * p : 2 * q] for p, q in zip(follow.tolist(), np.minimum(follow + NEXT, last[on]).tolist(), strict=True)]
            first = last - np.repeat(size, size) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(doc[on])), b.column("learn").take(pa.array(doc[on])), pa.array((gram[on] >> _U(1)).astype(np.int64)), pa.array((follow - 1 - first[on]).astype(np.int32)), pa.array(said, pa.binary())],
                names=["key", "learn", "gram", "pos", "next"],
            )


def with_continuations(coded: DataFrame, tasks: int) -> DataFrame:
    """``coded`` in ``tasks`` parts, with ``told``: for the runs that another training document has too, what follows there.

    Of the training documents with a run the two that bound their keys are kept, so one is always another.
    """
    coded = coded.withColumn("key", F.xxhash64("doc_id", "seq"))
    runs = materialize(coded.select("key", "learn", "n_tokens", "seq").mapInArrow(_runs, "key long, learn boolean, gram long, pos int, next binary"), "runs")
    source = F.when(F.col("learn"), F.struct("key", "next"))
    shared = runs.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("gram")
    shared = materialize(runs.join(materialize(shared, "shared").hint("merge"), "gram"), "runs")
    known = shared.where("learn").groupBy("gram").agg(F.min(F.struct("key", "next")).alias("lo"), F.max(F.struct("key", "next")).alias("hi"))
    known = materialize(known, "known")
    asked = shared.select(F.col("key").alias("asks"), "gram", "pos")
    other = F.when(F.col("lo.key") != F.col("asks"), F.col("lo.next")).when(F.col("hi.key") != F.col("asks"), F.col("hi.next"))
    found = asked.join(known.hint("merge"), "gram").select("asks", "pos", other.alias("next")).where("next is not null")
    found = found.groupBy("asks", "pos").agg(F.min("next").alias("next")).groupBy("asks").agg(F.collect_list(F.struct("pos", "next")).alias("told"))  # a text's own runs
    found = materialize(found, "told").repartition(tasks, "asks")
    out = coded.repartition(tasks, "key").join(found.hint("merge"), F.col("key") == F.col("asks"), "left").drop("key", "asks")
    out = materialize(out, "told")
    discard(runs, shared, known)
    return out


PARTS = 32


def _summed(df: DataFrame, dtype: type, size: int, parts: int = PARTS) -> np.ndarray:
    """Sum of arrays of a fixed size that tasks sent in parts (part, task, n, values); two levels, so no group grows large."""
    def add(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["n"].iloc[0])
        total = np.zeros(n, dtype)
        for blob in g["values"]:
            total += _open(blob, n, dtype)
        return g.iloc[:1].assign(values=[_squeeze(total)])

    shape = "part int, task int, n long, values binary"
    found = df.withColumn("task", F.col("task") % 64).groupBy("part", "task").applyInPandas(add, shape).groupBy("part").applyInPandas(add, shape).collect()
    out = np.zeros(size, dtype)
    for r in found:
        lo = r["part"] * size // parts
        out[lo : lo + r["n"]] = _open(r["values"], r["n"], dtype)
    return out


_SENT = "part int, task int, n long, values binary"


def _send(values: np.ndarray, parts: int = PARTS) -> pd.DataFrame:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    cut = [values[i * len(values) // parts : (i + 1) * len(values) // parts] for i in range(parts)]
    return pd.DataFrame({"part": range(parts), "task": task, "n": [len(c) for c in cut], "values": [_squeeze(c) for c in cut]}).astype({"part": "int32", "task": "int32"})


def _sent(values: np.ndarray, parts: int = PARTS) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(_send(values, parts), preserve_index=False)


def _spelled(words: pa.Array) -> bytes:
    return b"".join(w.encode() + b" " for w in words.to_pylist())


def train_spelling(words: DataFrame, used: np.ndarray):
    """(code, table, mixer) of the spelling of new words, learned from all words that training text has once."""
    spark = words.sparkSession
    code = spark.sparkContext.broadcast(spelling.prefix_code(used))
    words = words.where("c = 1 and n = 1").select("word", F.pmod(F.xxhash64("word"), F.lit(2)).alias("half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, spelling.OFFSETS[-1]), np.int64)
        for b in batches:
            spelling.count_decisions(_spelled(b.column("word")), np.ones(b.num_rows, np.int64), code.value, table)
        yield _sent(table.reshape(-1))

    table = _summed(words.mapInArrow(count, _SENT), np.int64, 2 * int(spelling.OFFSETS[-1])).reshape(2, -1)
    table = np.stack(scaled(table[0], table[1]))
    shared = spark.sparkContext.broadcast(table)

    def fit(sums, m: spelling.Mixer, dtype):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1, dtype)
            for b in batches:
                total = total + sums(_spelled(b.column("word")), code.value, shared.value, m)
            if total.ndim > 1:
                yield _sent(total.ravel(), 1)

        return run

    mixer, k = spelling.fresh_mixer(), len(spelling.BITS)
    # one half of the words fits the weights, the other what the refinement meets
    sums = _summed(words.where("half = 0").mapInArrow(fit(spelling.fit_sums, mixer, np.float64), _SENT), np.float64, spelling.GATES * k * (k + 1), 1)
    mixer = replace(mixer, weights=spelling.fitted(sums.reshape(-1, k, k + 1), mixer.weights))
    met = _summed(words.where("half = 1").mapInArrow(fit(spelling.refinement_sums, mixer, np.int64), _SENT), np.int64, mixer.refine.size, 1)
    return code, shared, replace(mixer, refine=mixer.refine + met.reshape(mixer.refine.shape))


def halves(trained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All training documents, whatever their number: one half by a hash fits the weights, the other meets the refinement."""
    pick = F.xxhash64("doc_id", "seq").bitwiseAND(F.lit(1 << 39)) == 0
    return trained.where(pick), trained.where(~pick)


def score_documents(docs: DataFrame, learn) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, bits_per_byte`` and ``train_tokens`` of all documents.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. ``learn`` is a condition that tells the training
    documents; all of them count. Scores are log10 probabilities; the base is a smoothed unigram score. A training document's ``score`` leaves out
    its own occurrence of each word, so that a text that occurs once scores as a new one; its base does not. A null
    or empty text is its end alone; a null condition means not learned from; repeated rows
    are each scored (and learned from). Everything but tables of a fixed size stays with the executors.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    packed = materialize(rows.mapInArrow(_pack, _PACKED), "packed")
    documents = packed.where("h is null")
    same = Window.partitionBy("h")  # a row for each batch that has the word
    words = packed.where("h is not null").select("batch", "h", "n", "word", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("batch")) == 1).alias("first"))
    words = materialize(words.select("batch", "h", "n", "c", "first", F.when(F.col("c") <= 1, F.col("word")).alias("word")), "words")
    used = np.zeros(256, np.int64)
    for r in documents.select(F.posexplode("bytes").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        used[r["byte"]] = r["n"]
    ends = documents.agg(F.sum(F.size(F.filter("learn", lambda x: x)))).first()[0] or 0
    classes = np.zeros(CLASSES + 3, np.int64)
    kinds = int(ends > 0)
    for r in words.where("first and c > 0").groupBy(F.shiftrightunsigned("h", 48).alias("cls")).agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect():  # a row for each class
        classes[r["cls"]] = r["c"]
        kinds += r["kinds"]
    classes[END] = ends
    tokens = int(classes.sum())
    used[spelling.END] += tokens
    letters, table, mixer = train_spelling(words, used)
    known_mixer = broadcast(mixer)
    code = class_code(classes)
    spelled_end = float(spelling.spell_scores(b" ", letters.value, _stretch(table.value), mixer)[0])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = _stretch(table.value)
        for b in batches:
            rare = np.flatnonzero(b.column("c").to_numpy() <= 1)
            score = np.zeros(b.num_rows)
            score[rare] = spelling.spell_scores(_spelled(b.column("word").take(pa.array(rare))), letters.value, stretch, known_mixer.value)
            yield pa.RecordBatch.from_arrays([b.column("pack"), b.column("h"), b.column("c"), pa.array(score)], names=["pack", "h", "c", "spell"])

    replies = words.select(F.col("batch").alias("pack"), "h", "c", "word").mapInArrow(spell, "pack long, h long, c long, spell double")
    packs = documents.select("batch", "doc_id", "learn", "ends", "ids", "sizes")
    n = packs.count()
    n = max(min(n, 4 * spark.sparkContext.defaultParallelism), -(-n // 16), 1)  # tasks; a batch is small, but much work
    packs, replies = packs.repartition(n, "batch"), replies.repartition(n, "pack")
    coded = packs.groupBy("batch").cogroup(replies.groupBy("pack")).applyInPandas(_code(code.group, tokens, kinds, ends, spelled_end), _CODED)
    coded = materialize(coded, "coded")
    for used_up in (letters, table, known_mixer):
        used_up.destroy()
    discard(packed, words)
    m = max(min(-(-tokens // 250_000), spark.sparkContext.defaultParallelism), -(-tokens // 6_000_000), 1)
    coded = with_continuations(coded, m)

    shared = broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = empty_counts(shared.value)
        for _, f in _tokens(batches, shared.value.often):
            count_tokens(f, shared.value, counts)
        yield _sent(counts)

    trained = coded.where("learn").select("doc_id", "n_tokens", "learn", "seq", "told")
    # each task sends whole tables, so there are no more of them than the words ask for
    model = model_of(_summed(trained.coalesce(m).mapInArrow(count, _SENT), np.int64, len(empty_counts(code))), code)
    counted = broadcast(model.counts)  # the large parts travel once, what is fitted with each pass

    def in_task(fitted: Model) -> Model:
        return replace(fitted, code=shared.value, counts=counted.value)

    def gradient(fitted: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = in_task(fitted), np.zeros((GATES, INPUTS, INPUTS + 1))
            for _, f in _tokens(batches, m.code.often):
                total += fit_sums(f, m)
            yield _sent(total.ravel(), 1)

        return run

    def met(fitted: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = in_task(fitted), np.zeros((GATES, STEPS, 2), np.int64)
            for _, f in _tokens(batches, m.code.often):
                score_tokens(f, m, total)
            yield _sent(total.ravel(), 1)

        return run

    def scored(fitted: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = in_task(fitted)
            for b, f in _tokens(batches, m.code.often):
                score = (score_tokens(f, m) + b.column("inside").to_numpy()) / math.log(10)
                bits = -score * math.log2(10) / np.maximum(b.column("size").to_numpy(), 1)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "n_tokens", "n_known", "base_score")], pa.array(score), pa.array(bits)], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

        return run

    model = replace(model, code=None, counts=None)
    fits, meets = halves(trained)
    sums = _summed(fits.mapInArrow(gradient(model), _SENT), np.float64, GATES * INPUTS * (INPUTS + 1), 1)
    model = replace(model, weights=spelling.fitted(sums.reshape(GATES, INPUTS, INPUTS + 1), model.weights))
    refine = _summed(meets.mapInArrow(met(model), _SENT), np.int64, GATES * STEPS * 2, 1)
    model = replace(model, refine=model.refine + refine.reshape(GATES, STEPS, 2))
    found = coded.mapInArrow(scored(model), "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return found.withColumn("train_tokens", F.lit(tokens).cast("long"))


def _stretch(table: np.ndarray) -> np.ndarray:
    return spelling.stretched(table[0], table[1])


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn from nine tenths of the documents, score all."""
    digit = F.crc32(F.col("doc_id").cast("string")) % 10
    found = score_documents(read_table(spark, sf_dir, "documents"), digit != 0)
    return found.select("doc_id", F.coalesce(digit == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
