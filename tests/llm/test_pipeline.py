"""The corpus pipeline: stages, their columns, and what each must keep."""

import random

import corpus_pipeline
from tests.llm.test_operators import base_spans, words
from trajecta.llm import common


def corpus(tmp_path, spark):
    rng = random.Random(11)
    vocab = {"en": [f"en{i}" for i in range(400)], "de": [f"ßde{i}" for i in range(400)]}
    text = lambda x, n: " ".join(rng.choice(vocab[x]) for _ in range(n))
    item = text("en", 30) + ". " + text("en", 6) + "."
    rows = [(i, text(x, 60), x, "ab"[i % 2]) for i in range(60) for x in [("en", "de")[i % 3 == 0]]]
    rows += [(100, "12 34 55", "en", "a"), (101, rows[5][1], "en", "b"), (102, text("en", 40) + " " + item + " " + text("en", 40), "en", "a")]
    rows += [(103, text("en", 30) + " write to a.b@c.de or 10.0.0.1 " + text("en", 30), "en", "a"), (104, None, "en", "a"), rows[7]]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_does_its_work(spark, tmp_path):
    d = corpus(tmp_path, spark)
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        ids.append(sorted(r["doc_id"] for r in docs.collect()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    clean = list(range(60))
    assert ids[0] == sorted([*clean, 7, 101, 102, 103]) and ids[1] == [*clean, 102, 103]
    assert ids[2] == ids[3] == ids[4] == [*clean, 103]
    out = {r["doc_id"]: r for r in docs.collect()}
    assert "<EMAIL>" in out[103]["text"] and "<IP>" in out[103]["text"] and not base_spans(out[103]["text"])
    assert all(r["n_chars"] == len(r["text"]) and r["size"] == len(words(r["text"])) and r["taken"] <= 2 * r["size"] for r in out.values())
    assert abs(sum(r["taken"] for r in out.values()) - 1.5 * sum(r["size"] for r in out.values())) <= 2


def test_run_gives_the_last_stage(spark, tmp_path):
    d = corpus(tmp_path, spark)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()) == [*range(60), 103]


def test_missing_and_repeated_ids_at_every_stage(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"en{rng.randrange(400)}" for _ in range(n))
    item, copy, lone, twice = text(30) + ". " + text(6) + ".", text(60), text(60), text(60)
    leak = text(40) + " " + item + " " + text(40)
    rows = [(i, text(60), "en", "ab"[i % 2]) for i in range(20)]
    rows += [(None, copy, "en", "a"), (None, copy, "en", "b"), (None, copy + " tail", "en", "a"), (None, rows[3][1], "en", "a")]
    rows += [(None, leak, "en", "a"), (7, leak.upper(), "en", "b"), (None, lone, "en", "a"), (8, twice, "en", "a"), (8, twice, "en", "a")]
    d, columns = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(*r, len(r[1])) for r in rows], columns)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in df.collect())
    key = lambda r: ((r[0] is None, r[0] or 0), r[1])

    for name in ("language ID", "PII"):
        assert len(stages[name](spark, frame(rows), d).collect()) == len(rows)
    once = [r for r in rows if r[1] not in (copy, copy + " tail", twice, leak, leak.upper()) and (r[0] is not None or r[1] == lone)]
    left = pairs(stages["MinHash near-dedup"](spark, frame(rows), d))
    assert [p for p in left if p[1] in (copy, copy + " tail")] in ([((True, 0), copy)], [((True, 0), copy + " tail")])
    assert [p for p in left if p[1] not in (copy, copy + " tail")] == sorted([*map(key, once), key((7, leak.upper())), key((8, twice))])
    clean = pairs(stages["benchmark decontamination"](spark, frame(rows), d))
    assert clean == sorted(key(r) for r in rows if r[1].lower() != leak.lower())

    many = [*rows, *[(None, twice, x, "a") for x in ("en", "de")], *[(None, copy, "en", "a")] * 40]
    got = stages["mixing sources to target weights"](spark, frame(many), d).collect()
    assert sorted((*key((r["doc_id"], r["text"])), r["lang"], r["source"]) for r in got) == sorted((*key(r), r[2], r[3]) for r in many)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


def test_used_up_tables_go(spark, tmp_path, monkeypatch):
    d, scratch = corpus(tmp_path / "in", spark), tmp_path / "scratch"
    monkeypatch.setattr(common, "scratch_root", lambda spark: f"file://{scratch}")
    corpus_pipeline.run(spark, d).count()
    left = {p.name.rsplit("-", 1)[0] for p in scratch.iterdir()}
    assert "mixing" in left and not left & {"language", "minhash", "benchmark", "pii", "sketch", "classes", "bands", "buckets", "inside", "sets", "comps", "now", "open", "unsettled", "prefixes"}


def test_plans_of_component_rounds_stay_small(spark, monkeypatch):
    """No plan of a round reads its table dozens of times: the driver holds each of its versions."""
    reads, write = [], common.materialize

    def watched(df, name, *rest):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df, name, *rest)

    monkeypatch.setattr(common, "materialize", watched)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert 0 < max(reads) <= 16
