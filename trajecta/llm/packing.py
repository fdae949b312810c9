"""Packing of token pieces into sequences by exact complements, then best fit.

Documents become pieces of at most ``capacity`` tokens. Which pieces share a sequence depends
on their lengths only, and there are at most ``capacity`` lengths, however many documents: so
a plan is made from the counts by length. From the longest length down, a sequence is opened
and its gap is looked up among the sums of one, two and three lengths that are still there;
where none fits exactly, the longest piece that fits goes in and the smaller gap is looked up.
A pattern so found is used as often as the counts allow, so a plan has a few patterns and not
a row for each sequence. Pieces of a length are numbered over all tasks (a task's own count and
what the tasks before it have), and the number says which pattern, sequence and offset is theirs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slices

CAPACITY = 2048
TEXT = 4 << 20  # bytes of text that a task encodes at once
REMEMBERED = 1 << 19  # words whose ids a task keeps
_WHITE = " \t\n\x0b\x0c\r"
_MARK = "\x00"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, word by word: the vocabulary's pattern never joins what white space parts.

    So that fewer words differ, A-Z become small and a sign that ends a word becomes a word, which
    the vocabulary does too; but not in texts with combining marks or special tokens, which
    it reads before that.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        mark = self._tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has: a hundred words at once, with a mark after each."""
        marked = [f" {_MARK} ".join([*words[i : i + 100], ""]) for i in range(0, len(words), 100)]
        if self._mark is not None and not any(_MARK in w for w in words):
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(marked, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self._mark)
            if len(ends) == len(words):
                return ids[ids != self._mark], np.diff(ends, prepend=-1) - 1
        each = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _places(self, words: list[str]) -> np.ndarray:
        """Numbers of the words among those whose ids are known; new ones become known."""
        get = self._known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(self._known) + len(new) > REMEMBERED and self._known:
            self._forget()
            return self._places(words)
        if len(new):
            fresh = [words[i] for i in new]
            ids, sizes = self._encode(fresh)
            at[new] = np.arange(len(self._known), len(self._known) + len(new))
            self._known.update(zip(fresh, at[new].tolist(), strict=True))
            self._ids, self._sizes = np.concatenate([self._ids, ids]), np.concatenate([self._sizes, sizes])
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) in a row, and how many each text has."""
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z0-9ß-öø-ÿ])([,.;:!?])", r"\1 \2")
        texts = pc.if_else(pc.match_substring_regex(texts, r"<\||\pM"), texts, plain)
        split = pc.ascii_split_whitespace(texts)
        rows = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._places(words)
        starts = np.cumsum(self._sizes) - self._sizes
        which = known[coded.indices.to_numpy(zero_copy_only=False)]
        taken = self._sizes[which]
        ends = np.cumsum(taken)
        at = np.repeat(starts[which] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(rows)])]
        return self._ids[at], np.diff(bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a worker, which its tasks share: loading one a task would leave memory behind."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_parts(text: str, most: int = TEXT) -> Iterator[str]:
    """A long text in parts of about ``most`` characters, cut at white space."""
    start = 0
    while len(text) - start > most:
        end = start + most
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, part, nth`` and with ``keep_ids`` their ``ids``.

    A document is the ids of its text and an id 0; only longer ones than ``capacity`` are cut.
    ``nth`` counts the pieces of one length in a part. Null and empty texts have the id 0 alone;
    repeated rows are documents of their own; further columns are ignored. A long text is
    encoded in parts of ``TEXT`` characters, which gives the same ids. The vocabulary file is
    the one at ``path`` on every machine.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches, TEXT):
            texts = pc.fill_null(b.column("text"), "")
            if b.num_rows == 1 and (text := texts[0].as_py()) and len(text) > TEXT:
                ids = np.concatenate([encode(pa.array([t]))[0] for t in text_parts(text)])
                counts = np.array([len(ids)])
            else:
                ids, counts = encode(texts)
            ids = np.insert(ids, np.cumsum(counts), 0).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(b.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length, strict=True)]
            order = np.argsort(length, kind="stable")  # numbers inside each length go on from the last slice
            same = length[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(same, same) + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, np.full(len(row), part), nth)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                offsets = np.append(0, np.cumsum(length))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{_PIECE}, part long, nth long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Lengths:
    """Pieces left by length, and as bits the lengths, and the sums of two of them, that are there."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.tolist()
        self.bits = sum(1 << n for n in range(1, self.capacity + 1) if self.left[n])
        self._mirror()

    def _mirror(self) -> None:
        self.turned = int(format(self.bits, f"0{self.capacity + 1}b")[::-1], 2)  # bit capacity - n
        self._pairs = None

    @property
    def pairs(self) -> int:
        if self._pairs is None:
            sums, rest = 0, self.bits
            while rest:
                n = rest.bit_length() - 1
                sums |= self.bits << n
                rest ^= 1 << n
            self._pairs = sums & ((2 << self.capacity) - 1)
        return self._pairs

    def take(self, n: int, times: int) -> None:
        self.left[n] -= times
        if not self.left[n]:
            self.bits ^= 1 << n
            self._mirror()

    def _free(self, n: int, used: dict[int, int], more: tuple[int, ...]) -> bool:
        return self.left[n] - used.get(n, 0) >= more.count(n)

    def exact(self, gap: int, used: dict[int, int], most: int = 3) -> tuple[int, ...] | None:
        """At most ``most`` (up to three) lengths that fill the gap, from those that ``used`` leaves."""
        if most and self.left[gap] - used.get(gap, 0) > 0:
            return (gap,)
        other = self.turned >> (self.capacity - gap)  # bit x: the length gap - x is there
        both = self.bits & other if most > 1 else 0
        while both:
            n = both.bit_length() - 1
            if 2 * n < gap:
                break
            both ^= 1 << n
            found = (n, gap - n)
            if 0 < n < gap and all(self._free(x, used, found) for x in found):
                return found
        three = self.pairs & other if most > 2 else 0
        while three:
            s = three.bit_length() - 1
            three ^= 1 << s
            if not 0 < s < gap:
                continue
            pair = self.bits & (self.turned >> (self.capacity - s))
            while pair:
                n = pair.bit_length() - 1
                if 2 * n < s:
                    break
                pair ^= 1 << n
                found = (gap - s, n, s - n)
                if 0 < n < s and all(self._free(x, used, found) for x in found):
                    return found
        return None

    def best(self, gap: int, used: dict[int, int]) -> int | None:
        """The longest length that fits."""
        some = self.bits & ((2 << gap) - 1)
        while some:
            n = some.bit_length() - 1
            if self._free(n, used, (n,)):
                return n
            some ^= 1 << n
        return None


def plan_with(counts: np.ndarray, most: int) -> list[tuple[int, dict[int, int]]]:
    """A plan with exact complements of at most ``most`` lengths; best fit decreasing for the rest (or, at 0, for all)."""
    lengths, out = Lengths(np.asarray(counts)), []
    for longest in range(lengths.capacity, 0, -1):
        while lengths.left[longest]:
            used, gap = {longest: 1}, lengths.capacity - longest
            while gap:
                found = lengths.exact(gap, used, most)
                if found is None:
                    n = lengths.best(gap, used)
                    if n is None:
                        break
                    found = (n,)
                for n in found:
                    used[n] = used.get(n, 0) + 1
                    gap -= n
            times = min(lengths.left[n] // k for n, k in used.items())
            for n, k in used.items():
                lengths.take(n, times * k)
            out.append((times, used))
    return out


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) of each pattern of sequences; ``counts[n]`` pieces have length n.

    Few pieces can be short of just those that larger complements use up early, so the plans
    with complements of three, two, one and no lengths are made and the one with the fewest
    sequences stays (the first of those).
    """
    return min((plan_with(counts, most) for most in (3, 2, 1, 0)), key=lambda p: sum(t for t, _ in p))


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> list[np.ndarray]:
    """length, first number, pieces a sequence, first sequence and offset of each run of equal pieces, by length and number."""
    rows, base, given = [], 0, {}
    for times, used in patterns:
        offset = 0
        for n, k in used.items():
            rows.append((n, given.get(n, 0), k, base, offset))
            given[n] = given.get(n, 0) + times * k
            offset += n * k
        base += times
    return [np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)] or [np.zeros(0, np.int64)] * 5


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``length, part, nth``) with ``sequence_id`` and ``offset`` in place of part and nth.

    Offsets have no gaps from 0 in a sequence of at most ``capacity`` tokens. Counts by length
    (``capacity`` numbers) reach the driver, pieces don't; a length that a third of all pieces
    have is spread over the parts it comes from. An empty table gives no rows.
    """
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("c"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialize(counts.select("part", "length", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")), "spans")
    total = np.zeros(capacity + 1, np.int64)
    for r in spans.groupBy("length").agg(F.sum("c").alias("c")).collect():  # at most a row for each length
        total[r["length"]] = r["c"]
    length, first, each, base, offset = _slots(plan(total))
    places, top = length * (1 << 48) + first, 1 << 48
    rest = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, number = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            slot = np.searchsorted(places, n * top + number, side="right") - 1
            k = number - first[slot]
            own = [b.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.array(base[slot] + k // each[slot], pa.int64()), pa.array(offset[slot] + k % each[slot] * n, pa.int64())], names=[*[f.name for f in rest], "sequence_id", "offset"])

    placed = pieces.join(spans.select("part", "length", "before"), ["part", "length"])  # both written, so of known sizes
    schema = placed.select(*[f.name for f in rest]).schema.add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, starts, doc_ids``: the tokens of each sequence, and where each document's piece starts."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity tokens
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"), F.col("p.doc_id").alias("doc_ids"))


def op13_pack_documents(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` in sequences of 2,048 tokens."""
    return pack(materialize(token_pieces(read_table(spark, sf_dir, "documents")), "pieces"))
