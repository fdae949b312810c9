"""Token counts that follow edits: only what an edit can change is encoded again.

A document keeps its pre-tokens in leaves of a tree. Every leaf knows the characters and
tokens of its pre-tokens, every inner node the sums of its two children. An edit descends
to the leaf at its position, takes up the scan two characters before it (what a pre-token of
the pattern can look ahead), re-encodes until a new border falls on an old one behind the
edit, and updates the sums on the paths of the leaves it touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the tokenizer's own
LOOK = 2  # characters behind a pre-token that decide where it ends
LEAF = 64  # pre-tokens in a new leaf
REMEMBERED = 1 << 20  # pre-tokens whose counts a task keeps

_SPLIT = regex.compile(PATTERN)


class Counter:
    """Tokens of a pre-token, by a byte-level BPE vocabulary given as ranks."""

    def __init__(self, path: str = RANKS):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self._encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            n = len(self._encoding._encode_single_piece(piece)) if len(piece) < 1000 else len(self._encoding.encode_ordinary(piece))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[piece] = n
        return n

    def text(self, text: str) -> int:
        known = self._known
        total = 0
        for piece in _SPLIT.findall(text):
            n = known.get(piece)
            total += self(piece) if n is None else n
        return total


class Document:
    """Segment tree over leaves of pre-token lengths and counts."""

    def __init__(self, text: str, counter: Counter):
        self.count, self.text, self.encoded = counter, text, 0
        pieces = _SPLIT.findall(text)
        sizes = [(len(p), counter(p)) for p in pieces]
        self.leaves = [sizes[i : i + LEAF] for i in range(0, len(sizes), LEAF)] or [[]]
        self._build()

    def _build(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i in range(len(self.leaves)):
            self._sum_leaf(i)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _sum_leaf(self, i: int) -> None:
        self.chars[self.width + i] = sum(s for s, _ in self.leaves[i])
        self.tokens[self.width + i] = sum(t for _, t in self.leaves[i])

    def _refresh(self, lo: int, hi: int) -> None:
        """Sums of leaves lo..hi and of all nodes above them."""
        for i in range(lo, hi + 1):
            self._sum_leaf(i)
        lo, hi = (lo + self.width) // 2, (hi + self.width) // 2
        while lo:
            for i in range(lo, hi + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            lo, hi = lo // 2, hi // 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and where it starts."""
        at, node, start = min(at, max(0, self.chars[1] - 1)), 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace characters start..end (cut to the text) by ``put``."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        shift = len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        first, at = self._find(max(0, start - LOOK - 1))
        while first and at > start - LOOK:
            first -= 1
            at -= self.chars[self.width + first]
        head, pos = [], at
        for size in self.leaves[first]:  # pre-tokens that the edit can't reach stay
            if pos + size[0] + LOOK > start:
                break
            head.append(size)
            pos += size[0]
        borders, last, old = {}, first, at
        fresh, scan = [], pos
        edge = old  # old borders known so far, as positions in the new text
        tail: list[tuple[int, int]] | None = None
        match = _SPLIT.match
        while scan < len(self.text):
            m = match(self.text, scan)
            piece = m[0]
            fresh.append((len(piece), self.count(piece)))
            self.encoded += len(piece)
            scan = m.end()
            if scan < start + len(put):
                continue
            while last < len(self.leaves) and edge < scan - shift:  # read on in the old leaves
                for i, size in enumerate(self.leaves[last]):
                    edge += size[0]
                    borders[edge] = (last, i + 1)
                last += 1
            here = borders.get(scan - shift)
            if here and scan - shift >= end:
                leaf, i = here
                tail, last = self.leaves[leaf][i:], leaf
                break
        if tail is None:
            tail, last = [], len(self.leaves) - 1
        merged = head + fresh + tail
        if len(merged) <= 4 * LEAF and self.leaves[first : last + 1]:
            self.leaves[first] = merged
            for i in range(first + 1, last + 1):
                self.leaves[i] = []
            self._refresh(first, last)
        else:  # too large for one leaf: cut it and rebuild the sums, which encodes nothing
            self.leaves[first : last + 1] = [merged[i : i + LEAF] for i in range(0, len(merged), LEAF)] or [[]]
            self._build()


def count_edited(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Counts before and after the ``edits`` of each row of ``docs(doc_id, text, edits)``.

    ``edits`` is an array of (start, end, put) in characters, applied in order; a place beyond
    the text is cut to its end. Returns ``doc_id, n_tokens, n_edits, n_tokens_edited,
    n_chars_edited, n_chars_encoded``, the last being the characters that edits had encoded
    again. A null or empty text has no tokens; null edits are none, and a null ``put`` is
    empty. Repeated rows are each counted; other columns are ignored. ``ranks`` is the
    vocabulary file, at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for b in batches:
            out = []
            for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True):
                edits = [e for e in edits or [] if e]
                text = text or ""
                if not edits:
                    n = counter.text(text)
                    out.append((n, 0, n, len(text), 0))
                    continue
                d = Document(text, counter)
                before = d.total
                for e in edits:
                    d.edit(e["start"], e["end"], e["put"] or "")
                out.append((before, len(edits), d.total, len(d.text), d.encoded))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def cleaning_edits(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the edits of a small revision: a cut, a replacement and a new last line."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda start, end, put: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), put.alias("put"))
    edits = F.array(
        edit(F.floor(n / 4), F.floor(n / 4) + 20, F.lit("")),
        edit(F.floor(n / 2), F.floor(n / 2) + 7, F.lit("revised 2024")),
        edit(n + 20, n + 20, F.concat(F.lit("\nDocument "), F.col("doc_id").cast("string"), F.lit("."))),
    )
    return docs.select("doc_id", "text", F.when(n > 0, edits).alias("edits"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a revision of three edits."""
    return count_edited(cleaning_edits(read_table(spark, sf_dir, "documents")))
