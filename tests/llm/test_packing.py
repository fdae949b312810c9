"""Packing: ids against the tokenizer on whole texts, places against their rules, plans against bounds."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trajecta.llm import packing as P
from trajecta.llm.common import materialize

SCHEMA = "doc_id long, text string, length int, part string, ids string, sequence_id int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.vocabulary())


def made(seed=4, n=300):
    rng = random.Random(seed)
    words = ["the", "of", "Straße", "été", "it's", "a,b", "12", "end.", "?!", "H̱", "中文", "İx", "…", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 300, 900])))) for i in range(n)]
    return rows + [(None, "no id"), (900, None), (901, ""), (902, " \n "), (903, "word " * 50_000), (904, "x" * 9000), rows[5], rows[5]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "i", 2) for r in rows], SCHEMA).repartition(5)


def wanted(rows, tokenizer, capacity):
    out = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out += [(d, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return out


def check_places(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_and_places(spark, tokenizer, capacity):
    rows = made()
    got = P.pack(materialize(P.token_pieces(frame(spark, rows), capacity), "pieces"), capacity).collect()
    assert ordered(tuple(r)[:5] for r in got) == ordered(wanted(rows, tokenizer, capacity))
    n = check_places(got, capacity)
    assert n <= 1.03 * -(-sum(r["length"] for r in got) // capacity)  # with these lengths next to nothing is left empty


def test_sequences_hold_the_tokens(spark, tokenizer):
    rows = made(n=40)
    pieces = materialize(P.token_pieces(frame(spark, rows), 128, keep_ids=True), "pieces")
    got = P.sequences(P.pack(pieces, 128)).collect()
    whole = sorted(x for r in got for x in r["ids"])
    assert whole == sorted(x for _, t in rows for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert len(r["ids"]) <= 128 and len(r["starts"]) == len(r["doc_ids"]) and r["starts"][0] == 0


def test_empty_table(spark):
    assert P.pack(materialize(P.token_pieces(frame(spark, []), 64), "pieces"), 64).collect() == []


def test_texts_in_parts_have_the_same_ids(tokenizer):
    rng = random.Random(2)
    encode = P.Encoder(P.vocabulary())
    alphabet = "aAéÉ \t\n\x0b\x0c\r.,'ßΣσς0１ 　̱́e<|>endoftext中👍🏽sİ\x1f\x85Ḣ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(4000)] + ["x<|endoftext|>y <|ENDOFTEXT|>", "Hello, it's We'LL; ok?!"]
    ids, n = encode(pa.array(texts))
    at = np.cumsum(n) - n
    for t, a, k in zip(texts, at, n, strict=True):
        assert list(ids[a : a + k]) == tokenizer.encode(t, add_special_tokens=False).ids
    long = " ".join(texts)
    parts = list(P.text_parts(long, 1000))
    assert "".join(parts) == long and len(parts) > 50
    assert np.array_equal(np.concatenate([encode(pa.array([p]))[0] for p in parts]), tokenizer.encode(long, add_special_tokens=False).ids)


def fewest(lengths, capacity):
    """Least number of sequences, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_plans_use_every_piece_once_and_few_sequences():
    rng = random.Random(7)
    worse = 0
    for _ in range(150):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        patterns = P.plan(np.bincount(lengths, minlength=21))
        used = np.zeros(21, int)
        for times, p in patterns:
            assert sum(n * k for n, k in p.items()) <= 20
            for n, k in p.items():
                used[n] += times * k
        assert np.array_equal(used, np.bincount(lengths, minlength=21))
        n = sum(t for t, _ in patterns)
        assert n <= fewest(lengths, 20) + 1
        worse += n > fewest(lengths, 20)
    assert worse <= 7


def test_exact_complements_of_up_to_three_pieces_come_first():
    assert sorted((t, sorted(p.items())) for t, p in P.plan(np.bincount([2048] * 3 + [2000] * 4 + [30] * 2 + [18] * 2 + [16] * 3 + [48], minlength=2049))) == [
        (1, [(16, 3), (2000, 1)]), (1, [(48, 1), (2000, 1)]), (2, [(18, 1), (30, 1), (2000, 1)]), (3, [(2048, 1)])
    ]


def test_registered_query(spark, tokenizer, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = P.op13_pack_documents(spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = got.collect()
    assert ordered(tuple(r)[:5] for r in got) == ordered(wanted(rows, tokenizer, 2048))
    check_places(got, 2048)
