"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter as Counts
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajecta.llm import decontaminate, htmltext, langid, lmscore, mixing, nearest, neardup, pii, spelling, tokencounts, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, edits int, key string"


def docs_of(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, "k") for r in rows], DOCS).repartition(3)


def words(t):
    return (t or "").encode().lower().split()


def some_rows(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["été", "Straße", "niño", "THE", "of"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 40, 120])))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])))
    for i in range(12):  # copies and near copies
        base = rows[i][1].split()
        rows.append((n + 2 * i, rows[i][1].upper(), "en", "a"))
        rows.append((n + 2 * i + 1, " ".join(base[: max(1, len(base) - 3)]), "en", "b"))
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, " \t\n ", "en", "b"), (903, "x" * 5000, "en", "a"), (904, "1 " * 3000, "de", "a"), (None, "lost its id", "en", "a"), (None, None, None, None)]
    return rows + [rows[3], rows[3]]


# ------------------------------------------------------------------ near-duplicates


def components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low[find(i)], d)
    return [(d, len(sets[i]), (low[find(i)] if sets[i] else d) if d is not None else None) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark):
    rows = some_rows()
    got = neardup.near_duplicates(docs_of(spark, rows), k=3, percent=85).collect()
    want = components([(r[0], r[1]) for r in rows], 3, 85)
    assert Counts((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counts(want)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_copies_of_one_text_match_brute_force(spark):
    rng, base = random.Random(5), [f"v{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, rows), k=3, percent=85).collect()}
    assert got == {d: c for d, _, c in components([(r[0], r[1]) for r in rows], 3, 85)}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:]
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (neardup.registers(pool) == neardup.merge_registers(ra, rb)).all()
    j = neardup.joint_estimate(ra[None], rb[None], np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(j - 0.5) < 0.15


def test_bands_keep_the_promised_bound_at_any_threshold():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "row": [1], "text": ["a b c d e f g h"]})
    for percent in (50, 70, 80, 85, 95, 100):
        out = next(neardup._sketch(5, neardup.bands_for(percent))(iter([batch])))
        assert (1 - (percent / 100) ** neardup.ROWS) ** len(out.column("bands")[0]) <= 1e-6
    assert neardup.bands_for(85) == 24 and neardup.bands_for(80) == 35


# ------------------------------------------------------------------ mixing


def test_targets_stop_and_share_again():
    t = mixing.targets([100, 10, 1000], [3, 1, 2], 1.5)
    assert t[0] == 200 and t[1] == 20 and abs(sum(t) - 1.5 * 1110) < 1e-6


def test_mix_meets_targets_and_reruns(spark):
    rows = some_rows()
    _, out = mixing.mix_sources(docs_of(spark, rows), block=16, shard=32)
    first = sorted(map(tuple, out.select("doc_id", "source", "size", "target", "taken").collect()), key=repr)
    _, again = mixing.mix_sources(docs_of(spark, rows).repartition(7), block=16, shard=32)
    assert first == sorted(map(tuple, again.select("doc_id", "source", "size", "target", "taken").collect()), key=repr)
    assert len(first) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for d, s, size, target, taken in first:
        assert 0 <= taken <= 2 * size
        by[s][0] += size
        by[s][1] += taken
        by[s][2] = target
    assert all(abs(taken - target) <= 1 for _, taken, target in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(v[0] for v in by.values())) < 1e-6


def test_pieces_cover_slots(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(30 + i)), "en", "s" if i % 3 else "r") for i in range(20)]
    pieces, out = mixing.mix_sources(docs_of(spark, rows), block=16, shard=8)
    got = pieces.collect()
    assert all(0 <= p["first"] < p["last"] for p in got)
    assert sum(p["last"] - p["first"] for p in got) == sum(r["taken"] for r in out.collect())
    per = Counts()
    for p in got:
        per[p["source"], p["k"]] += p["last"] - p["first"]
    assert max(per.values()) <= 16


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs_of(spark, []))[1].count() == 0
    assert mixing.mix_sources(docs_of(spark, [(1, None, None, None)]))[1].first()["taken"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one(n):
    p = mixing.Permutation(n, 12345)
    y = p(np.arange(n))
    assert sorted(y) == list(range(n)) and (p(y, back=True) == np.arange(n)).all()


# ------------------------------------------------------------------ urls


def test_url_rules_and_aliases(spark):
    link = '<html><LINK Rel=canonical href="{}"><p>x'
    rows = [
        (1, "https://a.Example.net/en/x?q#f", "<p>"), (2, "http://b.net/", None), (3, "http://net", None), (4, None, None), (5, "no scheme", ""),
        (6, "http://ok.org/1", link.format("http://spam.net/a")), (7, "http://ok.org/2", link.format("/1")), (8, "http://ok.org/fr/3", link.format("http://spam.net/a")),
        (9, "http://q.com/z", '<meta http-equiv="refresh" content="0; url=http://w.com/y">'), (10, "http://w.com/y", link.format("http://example.com/de/1")),
        (11, "http://mynet/", None), (12, "http://ok.org/1#top", None), (12, "http://ok.org/1#top", None), (13, "http://x.com/1", link.format("http://s.net/1")), (14, "http://x.com/2", link.format("http://x.com/1")), (15, "http://example.net/en/9", link.format("http://x.com/2")),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, node string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.net", "/", "net/", "block")
    assert got[3] == ("net", "", None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[8] == ("ok.org", "/fr/3", "org/fr/", "allow")
    # 6, 7, 12 and 8 are aliases; 8 is allowed by a rule, which takes precedence
    assert got[6][3] == got[7][3] == got[12][3] == "allow"
    assert got[9][2:] == (None, "block") and got[10][3] == "block" and got[11][3] == "allow"
    assert got[13][3] == got[14][3] == "allow"  # blocked by one alias, allowed by another
    assert urlfilter.filter_urls(pages).count() == len(rows)
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


# ------------------------------------------------------------------ personal data


def luhn_digit(s):
    t = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s)))
    return str(-t % 10)


CARD = "411111111111111" + luhn_digit("411111111111111")


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn_digit(digits(v)[:-1]) == digits(v)[-1]),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data_matches_plain_patterns(spark):
    rng, bits = random.Random(2), ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", CARD, CARD[:4] + " " + CARD[4:8] + "-" + CARD[8:], "+1 (234) 555-1234", "+49", " ", "é🎉", "-", "7", "\n", "é@b.c_d@e.fr", "..", "(", "+1 2"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "9" * 20000, "1 " * 20000, "a" * 20000, "a@" + "b." * 5000 + "c", "+" * 5000, "a@b.c " * 700]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found_ip int")
    found = pii.find_pii(docs).collect()
    for r in found:
        got = [f"{k}:{s['start']}:{s['end']}" for k in ("email", "ip", "card", "phone") for s in r[f"found_{k}"]]
        assert got == base_spans(r["text"] or ""), r["text"]
    clean = pii.redact(docs.drop("found_ip")).collect()
    assert all(not base_spans(r["text"] or "") or "@" in r["text"] or "+" in r["text"] for r in clean)


def test_checksums_and_context(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32 THE end"), (2, "GB82WEST12345698765433"), (3, "my SSN is 123-45-6789."), (4, "part 123-45-6789"), (5, f"card {CARD}"), (6, CARD)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["found_iban"]] == [(5, 32)] and not got[2]["found_iban"]
    assert len(got[3]["found_ssn"]) == 1 and not got[4]["found_ssn"]
    assert got[5]["found_card"][0]["score"] > got[6]["found_card"][0]["score"]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_query_digest(spark, sf_dir):
    from trajecta.llm.pii import op3_pii

    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    for r in op3_pii(spark, sf_dir).collect():
        want = ",".join(base_spans(texts[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)


# ------------------------------------------------------------------ nearest neighbours


def test_nearest_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:80] = x[50]  # more copies than a list is long
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] + [1.0] * 15), (1300, [1.0] * 3), (1400, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, cls int, score double")
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 10))
    z, hit = x.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((z - z[q]) ** 2).sum(1))
        d[q] = np.inf
        want = [int(i) for i in np.lexsort((np.arange(300), d))[:10]]
        assert all(abs(d[v] - s) < 1e-12 for v, s in found) and len(found) == 10
        assert found == sorted(found, key=lambda p: (p[1], p[0]))
        hit += len(set(want) & {v for v, _ in found})
        if 50 <= q < 80:
            assert [v for v, _ in found] == want
    assert hit >= 0.9 * 10 * len(got)


def test_nearest_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    rows = [(i, x[i]) for i in range(40)] + [(10, x[40]), (10, x[41]), (20, x[20]), (20, x[20]), (7, x[10]), (30, x[31])]
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in rows], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, k=5, radius=64).orderBy("rank").collect():
        got[r["query_id"], r["query_row"]].append((r["rank"], r["vec_id"], r["score"]))
    want = []
    for at, (i, e) in enumerate(rows):
        if i % 10 == 0:
            others = sorted((float(np.sqrt(((f - e) ** 2).sum())), j) for n, (j, f) in enumerate(rows) if n != at)[:5]
            want.append((i, [(n + 1, j, s) for n, (s, j) in enumerate(others)]))
    assert sorted((q, found) for (q, _), found in got.items()) == sorted(want, key=lambda w: (w[0], w[1]))


def test_nearest_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[:4] for r in nearest.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 2.0)]
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    for r in nearest.op4_nearest(spark, sf_dir).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect():
        d = ((x - x[r["query_id"]]) ** 2).sum(1)
        d[r["query_id"]] = np.inf
        hit, total = hit + len(set(np.argsort(d)[:10]) & set(r["v"])), total + 10
    assert hit >= 0.9 * total


# ------------------------------------------------------------------ token counts


def test_edits_equal_counting_again():
    counter, rng = tokencounts.Counter(), random.Random(1)
    letters = "ab é.'s ll12\n  \t🎉ñ,-"
    for _ in range(400):
        d = tokencounts.Document("".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 30, 400, 3000]))), counter)
        for _ in range(5):
            a = rng.randint(0, len(d.text) + 3)
            b, put = a + rng.choice([0, 0, 1, 5, 200]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 300])))
            want = d.text[:a] + put + d.text[b:]
            d.edit(a, b, put)
            assert d.text == want and d.total == counter.text(want) and d.chars[1] == len(want)


def test_edits_encode_little(spark):
    text = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, text, [(100, 105, "x"), (20_000, 20_000, "yy ")]), (2, None, [(0, 0, "new")]), (3, "", None), (4, "abc", [(50, 60, None), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,put:string>>")
    got = {r["doc_id"]: r for r in tokencounts.count_edited(df).collect()}
    assert got[1]["n_chars_encoded"] < 200 and got[1]["n_edits"] == 2
    assert got[2]["n_tokens"] == 0 and got[2]["n_tokens_edited"] == 1 and got[3]["n_tokens"] == 0 and got[4]["n_tokens"] == got[4]["n_tokens_edited"]
    assert tokencounts.count_edited(df.limit(0)).count() == 0


def test_token_query_matches_encoding_again(spark, sf_dir):
    counter = tokencounts.Counter()
    edits = {r["doc_id"]: r for r in tokencounts.cleaning_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in tokencounts.op5_token_counts(spark, sf_dir).collect():
        text = edits[r["doc_id"]]["text"]
        assert r["n_tokens"] == len(counter._encoding.encode_ordinary(text))
        for e in edits[r["doc_id"]]["edits"]:
            text = text[: e["start"]] + e["put"] + text[e["end"] :]
        assert r["n_tokens_edited"] == len(counter._encoding.encode_ordinary(text))


# ------------------------------------------------------------------ decontamination


def test_benchmark_passages_are_found(spark):
    rng = random.Random(7)
    vocab = [f"t{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n)) + ". " + " ".join(rng.choice(vocab) for _ in range(6)) + ".") for i, n in enumerate([12, 30, 55, 90, 400])]
    bench = spark.createDataFrame([(*i, "x") for i in items] + [(77, None, "x"), (78, "too short", "x"), (79, "", "x")], "item_id long, text string, doc_id string")
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, filler(rng.choice([0, 50, 700])) + " " + t.upper().replace(".", " !") + " " + filler(300), "en", "a") for i, t in items]
    rows += [(100 + i, filler(400), "en", "a") for i in range(20)] + [(200, None, None, None), (201, "", None, None), (202, items[2][1][: len(items[2][1]) // 2], None, None)]
    rows.append(rows[1])
    for limit in (1 << 20, 200):  # one pass, and several
        got = decontaminate.find_benchmark_text(docs_of(spark, rows), bench, limit)
        assert Counts((r["doc_id"], r["item_id"]) for r in got.collect()) == Counts([(i, i) for i, _ in items] + [(1, 1)])
    assert decontaminate.find_benchmark_text(docs_of(spark, []), bench).count() == 0
    assert decontaminate.find_benchmark_text(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_benchmark_hits_match_brute_force(spark, sf_dir):
    from pyarrow import array

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    grams = lambda t: set(decontaminate.shingles(decontaminate.terms(array([t or ""]))[0]).tolist())
    own = {i: grams(t) for i, t in items}
    want = {(d, i) for d, t in docs for g in [grams(t)] for i, s in own.items() if s and len(s & g) >= 0.8 * len(s)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.op6_decontaminate(spark, sf_dir).collect()} == want and want


# ------------------------------------------------------------------ language models


def test_scores_match_the_stated_base(spark):
    rows = [r for r in some_rows() if r[0] is not None]
    digit = F.crc32(F.col("doc_id").cast("string")) % 10
    got = lmscore.score_documents(docs_of(spark, rows), digit != 0).collect()
    seen, ends = Counts(), 0
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 10:
            seen.update(words(r[1]))
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    want = Counts()
    for r in rows:
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r[1])) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        want[r[0], len(words(r[1])) + 1, sum(seen[w] > 0 for w in words(r[1])) + 1, round(base, 4)] += 1
    assert Counts((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_spelling_is_a_distribution():
    code = spelling.prefix_code(np.bincount(np.frombuffer(b"the cat sat on the mat ", np.uint8), minlength=256))
    table = np.zeros((2, spelling.OFFSETS[-1]), np.int64)
    text = b"the cat sat on mat "
    spelling.count_decisions(text, np.array([2, 1, 1, 1, 1]), code, table)
    m = spelling.fresh_mixer()
    m.weights = spelling.fitted(spelling.fit_sums(text, code, table, m), m.weights)
    m.refine = m.refine + spelling.refinement_sums(text, code, table, m)
    stretch = spelling.stretched(table[0], table[1])
    # all continuations of a prefix: every byte closes the word or goes on
    first = b"".join(bytes([b]) + b" " for b in range(256) if b not in (32,)) + b" "
    total = np.exp(spelling.spell_scores(first, code, stretch, m)).sum()
    assert 0 < total <= 1.0 + 1e-6
    likely, unlikely = spelling.spell_scores(b"the xqz ", code, stretch, m)
    assert likely > unlikely


def class_paths(counts):
    """Node and bit of every step to each class, by walking the code tree from its leaves."""
    tree = [(int(counts[c]), i) for i, c in enumerate(np.flatnonzero(counts))]
    up, new = {}, len(tree)
    while len(tree) > 1:
        tree.sort()
        (a, x), (b, y) = tree[:2]
        up[x], up[y] = (new, 0), (new, 1)
        tree = [*tree[2:], (a + b, new)]
        new += 1
    n, out = int(np.count_nonzero(counts)), {}
    for i, c in enumerate(np.flatnonzero(counts)):
        path = []
        while i in up:
            i, bit = up[i]
            path.append((i - n + 2, bit))
        out[int(c)] = path[::-1]
    return out


def score_one(cls, known, own, told, m, paths):
    """The groups of the words of one text, one bit after the other, in plain Python."""
    code, weights, log = m.code, m.weights.astype(float).copy(), lambda n: math.log(n + 0.4)
    mixed = lambda x, k: int(lmscore.mix64(np.array([x + ((k + 1) << 50)], np.uint64))[0]) >> 32
    after, run, total, change = {}, 0, 0.0, np.zeros_like(m.weights)
    for t, c in enumerate(cls):
        if t % lmscore.BLOCK == 0:
            weights, change = weights + change, np.zeros_like(weights)
        often = [x for x in cls[:t] if code.often[x]]
        f1, f2 = (often[-1] if often else lmscore.NONE), (often[-2] if len(often) > 1 else lmscore.NONE)
        pair, w1 = tuple(cls[t - 2 : t]) if t > 1 else None, cls[t - 1] if t else lmscore.START
        guess = told[t] if told[t] >= 0 else after.get(pair, -1)
        hit, record = guess == c and known[t], run + lmscore.RUNS * (told[t] >= 0)
        usual = [mixed(f1, 0), mixed(f1 << 20 | f2, 1), mixed(w1, 2)]
        todo = [(1, int(hit), 2, [mixed(record, 4), mixed(record << 20 | w1, 5), usual[2]])] if guess >= 0 else []
        if not hit:
            todo.append((0, known[t], 1, usual))
            todo += [(node, bit, 0, usual) for node, bit in (paths[c][: lmscore.DEPTH] if known[t] else [])]
        for node, bit, kind, contexts in todo:
            x, gate = [], 6 * kind
            for k in range(len(code.bits)):
                slot = node
                if k:
                    h = (contexts[k - 1] + node * 0x9E3779B1) * 0x85EBCA6B % 2**32
                    h = (h ^ h >> 15) * 0xC2B2AE35 % 2**32
                    slot = (h >> 32 - code.bits[k]) + int(code.offsets[k])
                n = [int(m.counts[slot]) & 0xFFFF, int(m.counts[slot]) >> 16]
                n[bit] -= own
                x.append(log(n[1]) - log(n[0]))
                gate += 3 * (sum(n) > 7) if k == 2 else (sum(n) > 0) + (sum(n) > 7) if k == 3 else 0
            dot = min(12.0, max(-12.0, sum(w * v for w, v in zip(weights[gate], x, strict=True))))
            p = 1 / (1 + math.exp(-dot))
            change[gate] += lmscore.RATE * (bit - p) * np.array(x)
            seen = m.refine[gate, min(lmscore.STEPS - 1, max(0, round(dot * 2 + 16)))]
            p = min(1 - 1e-6, max(1e-6, (p + seen[1] / seen.sum()) / 2))
            total += math.log(p if bit else 1 - p)
        if hit:
            total += math.log((code.group[c] - own) / (code.count[c] - own))
        run = min(run + 1, lmscore.RUNS - 1) if hit else 0
        if pair:
            after[pair] = c
    return total


def test_scores_match_plain_online_mixing(monkeypatch):
    monkeypatch.setattr(lmscore, "DEPTH", 5)
    rng = np.random.default_rng(4)
    sizes = [70, 3, 1, 40, 25]
    at = np.concatenate([[0], np.cumsum(sizes)])
    cls, known = rng.zipf(1.5, at[-1]) % 40, (rng.random(at[-1]) < 0.9).astype(np.int64)
    cls[at[1:] - 1], known[at[1:] - 1] = lmscore.END, 1
    cls[73:95] = cls[8:30]  # repeats
    cls[:70] = np.where(np.arange(70) % 3 == 0, 500 + np.arange(70), cls[:70])  # rare classes, deep in the tree
    cls[20:30] = cls[4:14]
    learn, told = np.array([True, True, True, False, False]), np.where(rng.random(at[-1]) < 0.3, rng.permutation(cls), -1)
    told[told == lmscore.END] = -1
    used = np.bincount(cls[known > 0], minlength=lmscore.CLASSES + 3)
    cls[used[cls] == 0] = lmscore.END
    code, paths = lmscore.class_code(3 * used), class_paths(3 * used)
    told = np.where((told >= 0) & (used[np.maximum(told, 0)] > 0), told, -1)
    f = lmscore.tokens_of((cls | known << lmscore.KNOWN).astype(np.int32), at, learn, told, code.often)
    assert max(map(len, paths.values())) > lmscore.DEPTH and f.hit.any() and not f.hit.all()
    counts = lmscore.empty_counts(code)
    lmscore.count_tokens(f, code, counts)
    m = lmscore.model_of(counts, code)
    m.weights = spelling.fitted(lmscore.fit_sums(f, m), m.weights)
    refine = np.zeros(m.refine.shape, np.int64)
    lmscore.score_tokens(f, m, refine)
    m.refine = m.refine + refine
    got = lmscore.score_tokens(f, m)
    for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        want = score_one(cls[lo:hi].tolist(), known[lo:hi].tolist(), int(learn[i]), told[lo:hi].tolist(), m, paths)
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), (i, got[i], want)


def test_scores_do_not_depend_on_partitions(spark):
    rows = [r for r in some_rows() if r[0] is not None]
    digit = F.crc32(F.col("doc_id").cast("string")) % 10
    told = [sorted((r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in lmscore.score_documents(docs_of(spark, x).repartition(n), digit != 0).collect()) for x, n in ((rows, 2), (rows[::-1], 7))]
    assert len(told[0]) == len(rows) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(*told, strict=True))


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    rows = [(i, text(), None, None) for i in range(80)]
    rows += [(100 + i, rows[i][1], None, None) for i in range(8)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lmscore.score_documents(docs_of(spark, rows), F.lit(True)).collect()}
    twice, once = [got[i] for i in [*range(8), *range(100, 108)]], [got[i] for i in range(8, 80)]
    assert max(twice) < 0.7 * min(once), (max(twice), min(once))


def test_model_beats_the_base_on_held_out_text(spark, sf_dir):
    got = [r for r in lmscore.op7_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_scores_of_nothing(spark):
    assert lmscore.score_documents(docs_of(spark, []), F.lit(True)).count() == 0
    got = lmscore.score_documents(docs_of(spark, [(1, "a b", None, None), (2, None, None, None)]), F.lit(None).cast("boolean")).collect()
    assert len(got) == 2 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


# ------------------------------------------------------------------ html


def test_article_is_extracted(spark):
    page = """<!DOCTYPE html><title>T</title><script>var a="</p>";</script><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>two</b>
three&nbsp;four.<p>Five<br>six &lt;seven&gt;<script>x()</script></p><aside>Related things</aside><form>Name <input></form>
<p>Last one.</p><div class="comments"><p>Nice post!</p></div></article><footer>&copy; me</footer>"""
    want = "Head & tail\n\nOne two three four.\n\nFive six <seven>\n\nLast one."
    rows = [(1, "u", page, 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", "<nav><a>x</a></nav>", 0), (5, "u", page[: page.index("Last")], 0), (6, "u", "<" * 3000, 0), (1, "u", page, 0)]
    rows += [(10 + i, "u", f"<nav><a>m{i}</a></nav><article><h1>t</h1>" + "<p>some words of an article here.</p>" * 5 + "</article><footer>f</footer>", 0) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    model = htmltext.learn(pages)
    got = {r["page_id"]: r["text"] for r in htmltext.extract_pages(pages, model).collect()}
    assert got[1] == want and got[2] == got[3] == got[4] == "" and got[5] == want[: want.index("\n\nLast")]
    assert htmltext.extract_pages(pages, model).count() == len(rows)
    assert htmltext.learn(pages.limit(0)) == htmltext.DEFAULT
    assert htmltext.extract(page.replace("article", "div"), model) == want


def test_names_of_wrappers_and_open_boilerplate_keep_the_article():
    body = "<h1>Title</h1>" + "<p>" + "some words of an article here. " * 12 + "</p>"
    want = htmltext.extract(f"<article>{body}</article>", htmltext.DEFAULT)
    assert len(want) > 300
    for name in ("has-sidebar", "content with-sidebar", "no-comments", "article-header", "ad-free"):
        for page in (f'<div class="{name}"><article>{body}</article></div>', f'<nav><a>m</a></nav><div class="{name}">{body}</div><footer>f</footer>'):
            assert htmltext.extract(page, htmltext.DEFAULT) == want, (name, page[:60])
    assert htmltext.extract(f"<nav><a>menu</a><article>{body}</article>", htmltext.DEFAULT) == want
    assert htmltext.extract(f'<article>{body}<div class="comments"><p>Nice post!</p></div></article>', htmltext.DEFAULT) == want
    assert htmltext.extract(f'<div>{body}</div><div class="comments">{"<p>Nice post, I do think so!</p>" * 60}</div>', htmltext.DEFAULT) == want


def test_pages_match_their_marked_article(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in htmltext.op9_extract_html(spark, sf_dir).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# ------------------------------------------------------------------ languages


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = langid.op10_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_mixed_text_has_spans_and_odd_texts_a_result(spark):
    en, el = "this is a small house and the cat sat there", "αυτό είναι ένα μικρό σπίτι και η γάτα κάθεται εκεί"
    fr = "ceci est une petite maison et le chat est assis dans la cuisine"
    train = spark.createDataFrame([(i, t, x) for i in range(20) for t, x in ((en, "en"), (el, "el"), (fr, "fr"))] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = [(1, f"{en} {en} {fr} {fr} {fr}", "q"), (2, None, "q"), (3, "12 34 !!", "q"), (4, el, "q"), (5, "中文", "q"), (6, "ᚠᚢᚦ", "q"), (7, "", "q"), (1, en, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(df, model, spans=True).collect()}
    mixed = got[1, rows[0][1]]
    assert mixed["_lang_pred"] == "fr" and [s["lang"] for s in mixed["_spans"]] == ["en", "fr"] and abs(mixed["_spans"][0]["last"] - 20) <= 2
    assert all(got[i, t]["_lang_pred"] == "und" and got[i, t]["_score"] == 0 for i, t in ((2, None), (3, "12 34 !!"), (7, "")))
    assert got[4, el]["_lang_pred"] == "el" and got[4, el]["_score"] == 1.0
    assert got[5, "中文"]["_lang_pred"] != "und" and got[6, "ᚠᚢᚦ"]["_lang_pred"] != "und"
    nothing = langid.fit(train.limit(0))
    assert all(r["_lang_pred"] == "und" for r in langid.identify(df, nothing).collect())
    assert langid.identify(df.limit(0), model).count() == 0


def test_texts_without_letters_many_languages_and_clashing_names(spark):
    texts = ["🎉🎉 123", "。！", "！！", "× 3 ÷ 4", "12 – 5", "a", "中", "ﬁ", "Ω"]
    train = spark.createDataFrame([(i, f"w{i:03d}q" * 3 + f" x{i:03d}z", f"l{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = [(i, t, "x", 1.0, "y") for i, t in enumerate(texts)] + [(100 + i, f"w{i:03d}q" * 3 + f" x{i:03d}z", "x", 1.0, "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lang_pred string, _score double, _spans string")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[i]["_lang_pred"] == "und" for i in range(len(texts))] == [not any(c.isalpha() for c in t) for t in texts]
    assert all(got[100 + i]["_lang_pred"] == f"l{i:03d}" for i in range(300))
    assert "_spans" not in langid.identify(df, model).columns
    assert langid.identify(df, model, spans=True).where("size(_spans) = 1").count() == len(rows)


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(3)
    at = np.array([0, 7, 7, 12, 13])
    scores = rng.normal(size=(13, 3)).astype(np.float32) * 3
    label = langid.viterbi(scores, at, 2.0)
    from itertools import product

    for lo, hi in zip(at[:-1], at[1:], strict=True):
        value = lambda p, lo=lo: sum(scores[lo + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max((value(p) for p in product(range(3), repeat=hi - lo)), default=0)
        assert abs(value(label[lo:hi]) - best) < 1e-4


ARTICLE = "<h1>Title</h1>" + "<p>This is a sentence of the article, and it goes on for some words.</p>" * 8 + "<p>End.</p>"
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


@pytest.mark.parametrize("page", [
    '<html><body><form id="aspnetForm">{menu}<div>{body}</div><label>Name <input></label><select><option>a<option>b</select></form></body></html>',
    '{menu}<div class="post share">{body}</div><footer>Copyright 2024</footer>',
    '{menu}<div class="widget">{body}</div>',
    '{menu}<section class="related">{body}</section>',
    "{menu}<aside>Buy now<div>{body}</div>",
    "<html><body>{menu}<aside>Buy now<div>{body}</div></body></html>",
    "{menu}<select><option>Choose<div>{body}</div>",
    "{menu}<div>{body}</div>",
    '{menu}<div class="layout-sidebar-left">{body}</div><div class="share"><p>Send this to a friend.</p></div>',
    '{menu}<div>{body}</div><div class="comment-list">{comments}</div>',
    '{menu}<div>{body}</div><div id="comments">{comments}{comments}{comments}</div>',
    '{menu}<div class="cookie-banner"><p>We use cookies to make your visit better. Accept all?</p></div><div>{body}</div>',
])
def test_articles_stay_whatever_their_wrapper_is_called(spark, page):
    want = "\n\n".join(["Title", *["This is a sentence of the article, and it goes on for some words."] * 8, "End."])
    page = page.format(menu=MENU, body=ARTICLE, comments="<p>Nice post!</p>" * 9)
    learned = htmltext.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert htmltext.extract(page, htmltext.DEFAULT) == want and htmltext.extract(page, learned) == want


def test_both_of_two_equal_texts_stay():
    assert htmltext.extract(f'{MENU}<div class="layout-sidebar-left">{ARTICLE}</div><div>{ARTICLE}</div>', htmltext.DEFAULT).count("End.") == 2


@pytest.mark.parametrize("page", ["<b>{0}</i>", "<aside>{0}x</i>{0}<div>{0}", "<aside><div>{0}x</body>{0}", "<p><i>{0}<p>"])
def test_deep_and_long_pages_take_linear_time(page):
    import time

    def seconds(n):
        text = "".join(part * n for part in re.split(r"(?<=>)(?=[^>]*<)|\{0\}", page))
        began = time.process_time()
        htmltext.extract(text, htmltext.DEFAULT)
        return time.process_time() - began

    seconds(1000)
    assert seconds(64_000) < 40 * seconds(8_000) and seconds(64_000) < 20


def test_every_training_document_fits_weights_or_meets_the_refinement(spark):
    many = spark.range(60_000).selectExpr("id as doc_id", "cast(cast(id as string) as binary) as seq")  # over what was the bound of a sample
    fits, meets = lmscore.halves(many)
    assert fits.unionByName(meets).distinct().count() == 60_000 and fits.intersect(meets).count() == 0
    assert 0.45 < fits.count() / 60_000 < 0.55


def test_passes_over_text_stay_cheap(monkeypatch):
    """Counting takes a piece's places as they are: no table-sized array is made for each piece, and gates are told apart once."""
    rng = np.random.default_rng(5)
    cls = np.append(rng.integers(0, 300, 999), lmscore.END)
    code = lmscore.class_code(np.bincount(cls, minlength=lmscore.CLASSES + 3))
    f = lmscore.tokens_of((cls | 1 << lmscore.KNOWN).astype(np.int32), np.array([0, 400, 1000]), np.array([True, False]), np.full(1000, -1), code.often)
    want, sums = lmscore.empty_counts(code), np.zeros((lmscore.GATES, lmscore.INPUTS, lmscore.INPUTS + 1))
    d = lmscore.decisions(f, slice(0, 1000), code)
    for slot in d.slot:
        want += np.bincount(2 * slot.astype(np.int64) + d.bit, minlength=len(want))
    m = lmscore.model_of(want, code)
    x, gate = lmscore.inputs(f, slice(0, 1000), d, m)
    for g, z, bit in zip(gate, x.T.astype(float), d.bit, strict=True):
        p = 1 / (1 + math.exp(-min(12, max(-12, m.weights[g] @ z))))
        sums[g] += np.column_stack([z * (bit - p), p * (1 - p) * np.outer(z, z)])
    made, bincount, scan = [], np.bincount, np.flatnonzero
    monkeypatch.setattr(np, "bincount", lambda *a, **k: made.append(k.get("minlength", 0)) or bincount(*a, **k))
    monkeypatch.setattr(np, "flatnonzero", lambda a: made.append("scan") or scan(a))
    got = lmscore.empty_counts(code)
    lmscore.count_tokens(f, code, got)
    assert (got == want).all() and np.allclose(lmscore.fit_sums(f, m), sums, rtol=1e-9, atol=1e-6)
    assert "scan" not in made and all(n <= 4 * lmscore.GATES for n in made)


def test_matches_and_spelling_take_no_slow_way(monkeypatch):
    """Continuations are placed for all texts at once, earlier pairs found by one plain sort, gates of spelling told apart once."""
    rng = np.random.default_rng(8)
    told = [None, [{"pos": 9, "next": [7, 8, 9]}, {"pos": 3, "next": [1, 2, 3, 4, 5, 6, 7]}], [], [{"pos": 3, "next": list(range(24))}], None]
    size = [4, 30, 1, 12, 8]
    value = [np.append(rng.integers(0, 6, n - 1), lmscore.END).astype(np.int32) | 1 << lmscore.KNOWN for n in size]
    rows = [{"n_tokens": n, "learn": True, "seq": lmscore._squeeze(v), "told": t and [{"pos": x["pos"], "next": np.array(x["next"], np.uint16).tobytes()} for x in t]} for n, v, t in zip(size, value, told, strict=True)]
    kind = pa.schema([("n_tokens", pa.int64()), ("learn", pa.bool_()), ("seq", pa.binary()), ("told", pa.list_(pa.struct([("pos", pa.int32()), ("next", pa.binary())])))])
    batch = pa.RecordBatch.from_pylist([rows[-1], *rows], schema=kind).slice(1)
    want = []
    for v, t in zip(value, told, strict=True):
        cls, said, after = (v & (1 << lmscore.KNOWN) - 1).tolist(), {}, {}
        for x in sorted(t or [], key=lambda x: x["pos"]):
            said |= dict(enumerate(x["next"], x["pos"] + 1))
        for i, c in enumerate(cls):
            pair = tuple(cls[i - 2 : i]) if i > 1 else None
            want.append(said[i] if i in said and i < len(cls) - 1 else after.get(pair, -1))
            if pair:
                after[pair] = c
    own = [g.guess for _, g in lmscore._tokens(iter([batch]), np.zeros(lmscore.CLASSES + 3, bool), 20)]
    assert len(own) > 1 and np.concatenate(own).tolist() == want
    text = b"".join(bytes(rng.integers(97, 101, n).tolist()) + b" " for n in rng.integers(1, 8, 200))
    code, table, m = spelling.prefix_code(np.bincount(np.frombuffer(text, np.uint8), minlength=256)), np.zeros((2, spelling.OFFSETS[-1]), np.int64), spelling.fresh_mixer()
    spelling.count_decisions(text, np.ones(200, np.int64), code, table)
    sums = np.zeros((spelling.GATES, len(spelling.BITS), len(spelling.BITS) + 1))
    for x, bits, gate, dot, _ in spelling._left_out(text, code, table, m):
        assert (gate == np.count_nonzero(x, axis=0)).all() and np.allclose(dot, np.clip((x.T * m.weights[gate]).sum(1), -12, 12))
        for g, z, bit, d in zip(gate, x.T.astype(float), bits, dot, strict=True):
            p = 1 / (1 + math.exp(-d))
            sums[g] += np.column_stack([z * (bit - p), p * (1 - p) * np.outer(z, z)])
    made, scan, sort = [], np.flatnonzero, np.argsort
    monkeypatch.setattr(np, "flatnonzero", lambda a: made.append("scan") or scan(a))
    assert np.allclose(spelling.fit_sums(text, code, table, m), sums, rtol=1e-9, atol=1e-6)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: made.append("argsort") or sort(*a, **k))
    lmscore.tokens_of(value[1], np.array([0, 30]), np.array([True]), np.full(30, -1), np.zeros(lmscore.CLASSES + 3, bool))
    assert "argsort" not in made and made.count("scan") < 5
