"""The Merkle manifest against a plain version that holds whole trees, and its log positions."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from trajecta.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, leaf string, path string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def whole_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 3 * 3
            p.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + 3])))
            at[i] //= 3
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    by, out = {}, []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [whole_tree([leaf_of(r) for r in by[s]]) for s in names]
    if not names:
        return []
    root, tops = whole_tree([t[0] for t in trees])
    for s, (sub, paths), top in zip(names, trees, tops, strict=True):
        for r, p in zip(by[s], paths, strict=True):
            t = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = (*r[:4], r[4].replace("\n", ""))
            back = leaf_of(t)
            for a, b in p + top:
                back = h(a + back + b)
            out.append((r[0], leaf_of(r), sub, root, h("".join(a + b for a, b in p + top)), back, back == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def made(n, seed=1):
    rng = random.Random(seed)
    texts = ["x\ny", "", None, "plain", "ü\n", "long\n" * 30_000]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(["a", "a", "a", "b", "é", "zz", "", None]), rng.choice(["en", None]), rng.choice([5, None]), rng.choice(texts)) for i in range(n)]
    return rows + rows[:3]  # repeated rows; the further columns clash with names inside


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "l", "p") for r in rows], SCHEMA).repartition(3)


def test_manifest_equals_whole_trees_over_several_rounds(spark):
    for n in (0, 1, 28, 200):
        df = frame(spark, made(n))
        got = manifest.verified_manifest(df, manifest.without_line_ends(df), levels=2)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert ordered(got.collect()) == ordered(plain(made(n)))


def test_untampered_rows_are_verified_and_partitions_change_nothing(spark):
    df = frame(spark, made(60))
    once = manifest.verified_manifest(df, F.col("text")).collect()
    again = manifest.verified_manifest(df.repartition(7), F.col("text"), levels=1).collect()
    assert all(r.verified for r in once) and ordered(once) == ordered(again)


def test_positions_are_those_of_an_append_log():
    for n in (1, 2, 3, 8, 9, 10, 26, 27):
        leaves = [h(str(i)) for i in range(n)]
        for above in (False, True):
            log = manifest.append_log(leaves, above, 3)
            levels = manifest.log_levels(log, n, above, 3)
            assert levels[0] == leaves and sum(map(len, levels)) == len(log) and levels[-1][0] == log[-1]
            for low, high in zip(levels, levels[1:], strict=False):
                assert high == [h("".join(low[k : k + 3])) for k in range(0, len(low), 3)]
    assert list(manifest.position(np.array([0, 1, 2, 3, 8, 9]))) == [0, 1, 2, 4, 10, 13]


def test_registered_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(manifest.ORACLE_SQL).fetchall()
    assert ordered(manifest.op12_merkle_manifest(spark, sf_dir).collect()) == ordered(want)
