"""Corpus queries as registered: against their SQL, or against plain versions of what is fixed."""

import math
import re
from fractions import Fraction

import duckdb
import pytest

import corpus_pipeline
from trajecta.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.test_operators import words
from tests.test_oracles import TABLES, canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_mix_of_all_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {i: len(words(r["text"])) for i, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[i] for i, r in docs.items() if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, {s for s in sources if own[s]}, Fraction(3, 2) * sum(own.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * own[s]}
        for s in over or free:
            target[s] = 2 * own[s] if over else rate * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    got = QUERIES["op1_mix_sources"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    taken = dict.fromkeys(sources, 0)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], own[s]) and math.isclose(r["target"], target.get(s, 0)) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target.get(s, 0)) <= 1 for s in sources)


def test_rules_of_all_pages(spark, sf_dir):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op2_url_filter"](spark, sf_dir).collect():
        _, there, rest = (pages[r["page_id"]] or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if there else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if there else ""
        host = host.encode().lower().decode()
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule = max(fits, key=len) if fits else None
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == rules[rule] if rule else r["verdict"] in ("allow", "block")


def test_stages_over_an_empty_table(spark, tmp_path):
    d, columns = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], columns)
    spark.createDataFrame([(0, "an item of a test")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_the_copy_that_stays_is_the_same_in_every_run(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, lang, source, n) for lang, source, n in (("en", "b", 5), ("en", "a", 7), (None, "a", 9), ("de", "a", 2))] + [(2, None, "en", "a", 77)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    for parts in (1, 4):
        got = stages["MinHash near-dedup"](spark, spark.createDataFrame(rows, columns).repartition(parts), str(tmp_path)).where("doc_id = 1").collect()
        assert [(r["lang"], r["source"], r["n_chars"]) for r in got] == [(None, "a", 9)]
    hidden = stages["PII"](spark, spark.createDataFrame(rows, columns), str(tmp_path)).where("doc_id = 2").first()
    assert hidden["text"] is None and hidden["n_chars"] == 77
