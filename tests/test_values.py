"""Operators that SQL can't state, by value against plain versions in NumPy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import grouped_kmeans as K
from trajecta.operators import trajectory as T
from trajecta.operators import trees as B
from trajecta.plans import inference as I


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(3)
    return {s: np.cumsum(rng.normal(size=(40, 15)), axis=0) for s in range(3)}


@pytest.fixture(scope="module")
def walk_frame(spark, walks):
    return spark.createDataFrame([(s, i, [float(x) for x in v]) for s, h in walks.items() for i, v in enumerate(h)], "s int, pos int, vec array<double>").repartition(4)


def axes_of(w, d):
    return np.linalg.svd(w - w.mean(0), full_matrices=False)[2][:d].T


def test_local_dynamics(walks, walk_frame):
    got = {(r["s"], r["pos"]): r["dynamics_error"] for r in T.local_dynamics_error(walk_frame, ["s"], "pos", "vec", 10, 6, block=16).collect()}
    for s, h in walks.items():
        for t in range(len(h)):
            if t < 10:
                assert got[s, t] is None
                continue
            w = h[t - 10 : t]
            v = axes_of(w, 6)
            y = (w - w.mean(0)) @ v
            step = np.linalg.solve(y[:-1].T @ y[:-1] + 1e-2 * np.eye(6), y[:-1].T @ y[1:])
            assert got[s, t] == pytest.approx(np.linalg.norm(h[t] - (w.mean(0) + v @ (y[-1] @ step))), rel=1e-8)


def test_subspace_split(walks, walk_frame):
    got = {(r["s"], r["pos"]): (r["inside"], r["outside"]) for r in T.subspace_split(walk_frame, ["s"], "pos", "vec", 3, 20, 10, block=16).collect()}
    for s, h in walks.items():
        for t in range(20, len(h)):
            line = np.linalg.lstsq(np.column_stack([np.ones(3), np.arange(3.0)]), h[t - 3 : t], rcond=None)[0]
            r, v = h[t] - (line[0] + 3 * line[1]), axes_of(h[t - 20 : t], 10)
            inner = v @ (v.T @ r)
            assert got[s, t] == pytest.approx((np.linalg.norm(inner), np.linalg.norm(r - inner)), rel=1e-8)


def test_held_out_ridge_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(2, 1, size=(2, 300, 3))
    y = x @ [0.5, -0.2, 0.1] + rng.normal(0, 1, size=(2, 300))
    rows = [(c, i * 5 // 300, *map(float, x[c, i]), float(y[c, i])) for c in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "ch int, fold int, a double, b double, d double, y double").repartition(3)
    got = {r["ch"]: (r["r_full"], r["r_rest"], r["unique"]) for r in I.unique_contribution(df, "ch", "fold", ["a", "b", "d"], "y", ["a"], 20.0).collect()}
    for c in range(2):
        def score(use, c=c):
            pred, fold = np.zeros(300), np.arange(300) * 5 // 300
            for f in range(5):
                tr = fold != f
                z, my = x[c][:, use], y[c][tr].mean()
                m = z[tr].mean(0)
                w = np.linalg.solve((z[tr] - m).T @ (z[tr] - m) + 20 * np.eye(len(use)), (z[tr] - m).T @ (y[c][tr] - my))
                pred[~tr] = my + (z[~tr] - m) @ w
            return np.corrcoef(pred, y[c])[0, 1]

        full, rest = score([0, 1, 2]), score([1, 2])
        assert got[c] == pytest.approx((full, rest, full - rest), abs=1e-9)


def test_held_out_neighbourhoods_equal_plain_rounds(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 5 if i % 5 else None, [float(v) for v in rng.normal(size=4) + 4 * (i % 3)]) for i in range(150)] + [(900, 1, None)]
    df = spark.createDataFrame(rows, "id int, fold int, v array<double>").repartition(4)
    got = {r["id"]: r for r in K.held_out(df, "fold", "v", 3, restarts=2, iterations=5, tol=0.0, seed=1).collect()}
    numbered, folds = K.numbered(df, "fold")
    assert folds == [None, 1, 2, 3, 4] and got[900]["distances"] is None
    marked = numbered.select(F.col("v").cast("array<double>").alias("v"), F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda m: m != F.col("_model")).alias("m")).where("v is not null")
    starts = [K.start_vectors(marked, 5, 3, seed, 20_000) for seed in (1, 2)]
    for m, fold in enumerate(folds):
        x = np.array([v for _, f, v in rows if f != fold and v is not None])
        best = None
        for start in starts:
            c = start[m].copy()
            for _ in range(5):
                at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(3)])
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            if best is None or d.sum() < best[1].sum():
                best = c, d
        c, d = best
        for i, f, v in rows:
            if f == fold and v is not None:
                own = ((c - v) ** 2).sum(1)
                r = got[i]  # two starts may lead to the same centroids in another order
                assert sorted(r["distances"]) == pytest.approx(sorted(own)) and r["distances"][r["cluster"]] == min(r["distances"]) and r["sigma"] == pytest.approx(np.median(np.sqrt(d)))


def test_layers_a_twelfth_apart():
    assert K.sample_layers(24) == list(range(0, 25, 2)) and K.sample_layers(12) == list(range(13)) and K.sample_layers(25)[-2:] == [24, 25] and K.sample_layers(5) == list(range(6))


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return "(-NONE- *)" if rng.random() < 0.2 else f"({rng.choice('NVD')} w{rng.randrange(99)}/1.{rng.randrange(9)})"
    return f"({rng.choice(['S', 'NP', 'VP'])} " + " ".join(nested(rng, depth - 1) for _ in range(rng.randrange(1, 4))) + ")"


def read(text):
    """(label, children or token) by recursion."""
    parts = re.findall(r"[()]|[^\s()]+", text)

    def node(i):
        label, i, inside = parts[i + 1], i + 2, []
        while parts[i] != ")":
            if parts[i] == "(":
                child, i = node(i)
                inside.append(child)
            else:
                inside.append(parts[i])
                i += 1
        return (label, inside), i + 1

    return node(0)[0]


def pruned(node):
    label, inside = node
    if label == "-NONE-":
        return None
    kept = [x if isinstance(x, str) else pruned(x) for x in inside]
    kept = [x for x in kept if x is not None]
    return (label, kept) if kept else None


def ends(node, out):
    label, inside = node
    first = len(out)
    for x in inside:
        if isinstance(x, str):
            out.append([x.split("/")[0], 0, 0])
        else:
            ends(x, out)
    if any(not isinstance(x, str) for x in inside):
        out[-1][1] += 1
        out[first][2] += 1
    return out


def test_closures_of_nested_trees(spark):
    rng = random.Random(9)
    trees = [f"(ROOT {nested(rng, 5)} {nested(rng, 4)})" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(trees)), "id int, tree string").repartition(3)
    got = {}
    for r in B.closures(df, ["id"]).orderBy("id", "leaf").collect():
        got.setdefault(r["id"], []).append([r["token"], r["closings"], r["openings"]])
    deepest = 0
    for i, text in enumerate(trees):
        tree = pruned(read(text))
        want = ends(tree, []) if tree else []
        assert got.get(i, []) == want
        deepest = max([deepest, *[w[1] for w in want]])
    assert deepest >= 4


def test_words_are_cleaned_without_a_pattern_for_each(spark):
    from trajecta.functions import text as X

    odd = ["KKelvin", "İx", "a\0b", "\U0001f600ab'9", "Über,", "''", "9", "", None, "éa", "don’t.", "A-b-C", "a$b\\c", "plain"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(odd)], "i int, word string").repartition(2)
    for rule, (pattern, lower) in X.CLEANING.items():
        want = F.regexp_replace(F.lower("word") if lower else F.col("word"), pattern, "")
        clean = df.select("i", X.clean_word(F.col("word"), rule).alias("got"), want.alias("want"))
        assert all(r["got"] == r["want"] for r in clean.collect())
        assert "regexp_replace" not in clean.select("got")._jdf.queryExecution().executedPlan().toString()
