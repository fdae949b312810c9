"""Spelling of words by bit predictors: what the language model says of words that are new to it.

A word is its bytes and a byte is the decisions of a prefix code. For every decision, predictors
of several orders look up counts in hashed tables by the bytes before it in the word; their
stretched predictions are combined by weights that a gate selects, fitted to words that are predicted
without themselves, and a table by gate and prediction refines the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import _powers, mix64

_U, _U32 = np.uint64, np.uint32
END = 32  # closes a word
BITS = (17, 19, 19, 19, 20)  # of the tables of orders 1 to 4 and of the whole prefix
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
GATES, STEPS = len(BITS) + 1, 33
PIECE = 1 << 15  # bytes of spelling that are handled at a time


@dataclass
class Code:
    """A prefix code of bytes: its length, and the tree node and decision at each depth."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def prefix_code(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    tree: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        tree[256 + len(tree)] = (x, y)
        heapq.heappush(heap, (a + b, 255 + len(tree), 255 + len(tree)))
    paths: dict[int, list[tuple[int, int]]] = {}
    todo: list[tuple[int, list]] = [(heap[0][2], [])]
    while todo:
        at, path = todo.pop()
        if at < 256:
            paths[at] = path
        else:
            for bit in (0, 1):
                todo.append((tree[at][bit], [*path, (at - 255, bit)]))
    depth = max(map(len, paths.values()))
    node, bit = np.zeros((depth, 256), np.uint32), np.zeros((depth, 256), np.uint8)
    for byte, path in paths.items():
        for i, (n, b) in enumerate(path):
            node[i, byte], bit[i, byte] = n, b
    return Code(np.array([len(paths[i]) for i in range(256)]), node, bit)


def contexts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes (orders x bytes) of what precedes each byte in its word; first: start of its word."""
    n, at = len(data), np.arange(len(data))
    out, acc = np.empty((len(BITS), n), np.uint32), np.full(n, 0x811C9DC5, np.uint32)
    for k in range(1, len(BITS)):
        before = np.full(n, 32, np.uint32)
        before[k:] = np.where(at[k:] - k >= first[k:], data[: n - k], 32)
        acc = (acc ^ before) * _U32(0x01000193)
        acc ^= acc >> _U32(13)
        out[k - 1] = acc * _U32(2 * k + 1)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])
    out[-1] = mix64((sums[:-1] - sums[first]) * inverse[first] + (at - first).astype(np.uint64)) >> _U(32)
    return out


def _decided(data: np.ndarray, first: np.ndarray, code: Code) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Depth by depth: the bytes that have a decision there, its table slot in each order, and the decision."""
    context, length, on = contexts(data, first), code.length[data], np.arange(len(data))
    for depth in range(len(code.node)):
        on = on[length[on] > depth]
        if not len(on):
            break
        byte, slots = data[on], []
        node = code.node[depth][byte] * _U32(0x9E3779B1)
        for order, bits, offset in zip(context, BITS, OFFSETS, strict=False):
            x = np.take(order, on, mode="clip")
            x += node
            x *= _U32(0x85EBCA6B)
            x ^= x >> _U32(15)
            x &= _U32((1 << bits) - 1)
            x += _U32(offset)
            slots.append(x.view(np.int32))
        yield on, slots, code.bit[depth][byte]


def spelled(words: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, word of each byte, start of its word) of pieces of words that END closes."""
    data = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero(data == END) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        size = ends[i:j] - starts[i:j]
        yield data[lo:hi], np.repeat(np.arange(i, j), size), np.repeat(starts[i:j] - lo, size)
        i = j


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)


@dataclass
class Mixer:
    weights: np.ndarray  # gates x orders
    refine: np.ndarray  # gates x steps x 2: decisions 0 and 1 seen at each step of the prediction


def fresh_mixer() -> Mixer:
    p = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    return Mixer(np.full((GATES, len(BITS)), 0.4), np.repeat(20 * np.stack([1 - p, p], 1)[None], GATES, 0))


def mix(x: np.ndarray, m: Mixer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gate, mixed prediction (stretched) and step of each decision; x: orders x decisions."""
    gate, dot = np.zeros(x.shape[1], np.int8), np.zeros(x.shape[1])
    for z in x:
        gate += (z != 0).view(np.int8)
    place = gate.astype(np.int64)
    for z, w in zip(x, np.ascontiguousarray(m.weights.T), strict=True):
        dot += z * np.take(w, place, mode="clip")
    np.clip(dot, -12, 12, out=dot)
    return place, dot, np.clip(np.rint(dot * 2 + 16), 0, STEPS - 1).astype(np.int64)


def count_decisions(words: bytes, counts: np.ndarray, code: Code, table: np.ndarray) -> None:
    """Add a word list's decisions, weighted by counts, to ``table`` (2 x slots)."""
    for data, word, first in spelled(words):
        seen = counts[word].astype(table.dtype)
        for on, slots, bit in _decided(data, first, code):
            more = seen[on]
            for b in (0, 1):
                own = np.flatnonzero(bit == b)
                n = more[own]
                for slot in slots:
                    np.add.at(table[b], slot[own], n)


def fit_sums(words: bytes, code: Code, table: np.ndarray, m: Mixer) -> np.ndarray:
    """For each gate, gradient and curvature of the log-likelihood (gates x orders x orders+1).

    Every word is predicted from all training words but itself.
    """
    out = np.zeros((GATES, len(BITS), len(BITS) + 1))
    for x, bit, gate, dot, _ in _left_out(words, code, table, m):
        order = np.argsort(gate.astype(np.int8), kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))])
        x, p = np.take(x, order, axis=1).astype(np.float64), 1 / (1 + np.exp(-dot[order]))
        error = bit[order] - p
        p *= 1 - p
        for g, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            z = x[:, lo:hi]
            out[g, :, 0] += z @ error[lo:hi]
            out[g, :, 1:] += (z * p[lo:hi]) @ z.T
    return out


def refinement_sums(words: bytes, code: Code, table: np.ndarray, m: Mixer) -> np.ndarray:
    """Decisions 0 and 1 met at each gate and step of the mixed prediction, each word predicted without itself."""
    out = np.zeros((GATES, STEPS, 2), np.int64)
    for _, bit, gate, _, step in _left_out(words, code, table, m):
        out += np.bincount((gate * STEPS + step) * 2 + bit, minlength=out.size).reshape(out.shape)
    return out


def _left_out(words: bytes, code: Code, table: np.ndarray, m: Mixer) -> Iterator[tuple[np.ndarray, ...]]:
    for data, _, first in spelled(words):
        for _, slots, bit in _decided(data, first, code):
            x, own = np.empty((len(BITS), len(bit)), np.float32), bit.astype(np.float32)
            for slot, up in zip(slots, x, strict=True):
                up[:] = np.take(table[1], slot, mode="clip")
                down = np.take(table[0], slot, mode="clip").astype(np.float32)
                up -= own
                down -= 1 - own
                np.maximum(up, 0, out=up)
                np.maximum(down, 0, out=down)
                up += np.float32(0.4)
                down += np.float32(0.4)
                up /= down
                np.log(up, out=up)
            yield x, bit.astype(np.int64), *mix(x, m)


def fitted(sums: np.ndarray, weights: np.ndarray, ridge: float = 20.0) -> np.ndarray:
    """One step to the best weights, held to the given ones where there is little text; rounded, so that the order of sums is no matter."""
    n = weights.shape[1]
    return np.round([w + np.linalg.solve(s[:, 1:] + ridge * np.eye(n), s[:, 0]) for s, w in zip(sums, weights, strict=True)], 6)


def spell_scores(words: bytes, code: Code, stretch: np.ndarray, m: Mixer) -> np.ndarray:
    """Natural-log probability of the spelling of each word."""
    out = np.zeros(words.count(bytes([END])))
    refined = (0.5 * m.refine[..., 1] / m.refine.sum(-1)).ravel()
    for data, word, first in spelled(words):
        total = np.zeros(len(data))
        for on, slots, bit in _decided(data, first, code):
            gate, dot, step = mix(np.stack([np.take(stretch, slot, mode="clip") for slot in slots]), m)
            gate *= STEPS
            gate += step
            p = 0.5 / (1 + np.exp(-dot))
            p += np.take(refined, gate, mode="clip")
            np.clip(p, 1e-6, 1 - 1e-6, out=p)
            p -= 1 - bit.astype(np.int8)  # of the bit that comes: p, or 1 - p
            total[on] += np.log(np.abs(p))
        out[word[0] : word[-1] + 1] += np.bincount(word - word[0], weights=total)
    return out
