"""Models by subject against least squares one subject at a time; signed-rank p against all sign patterns."""

import itertools
import math
import random

import numpy as np
import pytest

from trajecta.functions import tails
from trajecta.plans import subjects as S


def made(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(12):
        n = 30 + 10 * s
        a, b = rng.normal(100, 3, n), rng.normal(0, 1, n)
        c = np.full(n, 7.0) if s % 3 == 0 else rng.integers(0, 4, n).astype(float)
        y = (s - 6) * 0.2 * a + b + rng.normal(0, 2, n)
        if s == 5:
            a = np.full(n, 1.0)  # the column in question is constant
        rows += [(f"s{s}" if s else None, i % 2 == 0, float(p), float(q), float(r), float(t) if i != 3 else None) for i, (p, q, r, t) in enumerate(zip(a, b, c, y, strict=True))]
    return rows


def least_squares(rows, least):
    y = np.array([r[5] for r in rows if r[5] is not None])
    x = np.array([r[2:5] for r in rows if r[5] is not None])
    if len(y) < least or x[:, 0].std() == 0:
        return None
    there = x.std(0) > 1e-9
    z = lambda v: (v - v.mean(0)) / v.std(0)
    m = np.column_stack([np.ones(len(y)), z(x[:, there])])
    beta, rest, *_ = np.linalg.lstsq(m, z(y), rcond=None)
    df = len(y) - m.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rest[0] / df)
    return len(y), int(there.sum()), 1 - rest[0] / len(y), dict(zip(np.flatnonzero(there), zip(beta[1:], se[1:], strict=True), strict=True))


def test_betas_equal_least_squares_for_each_subject(spark):
    rows = made()
    df = spark.createDataFrame(rows, "who string, hard boolean, a double, b double, c double, y double").repartition(5)
    got = {r["who"]: r for r in S.subject_betas(df, ["who"], "y", ["a", "b", "c"], 50).collect()}
    for who in {r[0] for r in rows}:
        want = least_squares([r for r in rows if r[0] == who], 50)
        assert (who in got) == (want is not None)
        if want:
            r = got[who]
            assert (r["n"], r["used"]) == want[:2] and r["r2"] == pytest.approx(want[2], abs=1e-9)
            for i, x in enumerate("abc"):
                assert (r[f"beta_{x}"] is not None) == (i in want[3])
                if i in want[3]:
                    assert (r[f"beta_{x}"], r[f"se_{x}"]) == pytest.approx(want[3][i], abs=1e-8)
    empty = S.subject_betas(df.where("false"), ["who"], "y", ["a", "b"], 5)
    assert empty.count() == 0 and empty.columns == ["who", "n", "used", "r2", "beta_a", "se_a", "slope_a", "beta_b", "se_b", "slope_b"]


def test_strata_pair_up(spark):
    rows = made()
    df = spark.createDataFrame(rows, "who string, hard boolean, a double, b double, c double, y double")
    got = {r["who"]: (r["easy"], r["hard"]) for r in S.paired_strata(df, ["who"], "hard", "y", ["a", "b", "c"], 40).collect()}
    for who, pair in got.items():
        for flag, value in zip((False, True), pair, strict=True):
            want = least_squares([r for r in rows if r[0] == who and r[1] == flag], 40)
            assert value == (pytest.approx(want[3][0][0], abs=1e-8) if want else None)
    assert sum(None not in p for p in got.values()) >= 5


def all_patterns(values, alternative):
    v = [x for x in values if x]
    order = sorted(abs(x) for x in v)
    rank = {a: sum(i + 1 for i, o in enumerate(order) if o == a) / order.count(a) for a in order}
    w = sum(rank[abs(x)] for x in v if x > 0)
    sums = [sum(rank[abs(x)] for x, s in zip(v, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(v))]
    low, high = (sum(s <= w for s in sums) / len(sums), sum(s >= w for s in sums) / len(sums))
    return w, min(1.0, {"two-sided": 2 * min(low, high), "greater": high, "less": low}[alternative])


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_signed_rank_equals_all_sign_patterns(spark, alternative):
    rng = random.Random(3)
    groups = {g: [rng.choice([-1, 1]) * rng.choice([0, 1, 2, 2.5, 3, rng.random()]) for _ in range(rng.randrange(1, 12))] for g in ("a", "b", "c", None)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("zero", 0.0)], "g string, v double").repartition(3)
    got = {r["g"]: r for r in S.signed_rank_test(df, "v", ["g"], alternative).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        w, p = all_patterns(v, alternative)
        assert (got[g]["n"], got[g]["w_plus"]) == (sum(x != 0 for x in v), w) and got[g]["p"] == pytest.approx(p, abs=1e-12)


def test_known_tail_probabilities():
    # fixed values: two-sided p of the smaller rank sum, from published tables of the exact distribution
    for n, w, p in ((5, 0, 0.0625), (6, 0, 0.03125), (8, 3, 0.0390625), (10, 8, 0.048828125)):
        assert tails.signed_rank_tail(tails.signed_rank_ways(list(range(1, n + 1))), w) == pytest.approx(p)
    for n in (3, 9, 16, 25):  # whole numbers of patterns, counted exactly
        ways = {0: 1}
        for r in range(1, n + 1):
            ways = {s: ways.get(s, 0) + ways.get(s - r, 0) for s in range(n * (n + 1) // 2 + 1)}
        for w in (0, n, n * (n + 1) // 6):
            assert tails.signed_rank_tail(tails.signed_rank_ways(list(range(1, n + 1))), w) == pytest.approx(min(1.0, 2 * sum(k for s, k in ways.items() if s <= w) / 2**n), rel=1e-12)


def test_many_differences_use_the_normal_tail_with_ties(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0.15, 1, 400), 1)
    r = S.signed_rank_test(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()
    v = v[v != 0]
    size = np.abs(v)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    n, w = len(v), rank[v > 0].sum()
    ties = sum(t**3 - t for t in np.unique(size, return_counts=True)[1])
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (r["n"], r["w_plus"]) == (n, w) and r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


def test_t_test_and_paired_test(spark):
    rows = [(1.0, 2.0), (2.0, 2.5), (None, 1.0), (3.0, 5.0), (1.5, 1.0), (2.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    d = [b - a for a, b in rows if a is not None]
    r = S.paired_test(df, "a", "b").first()
    w, p = all_patterns(d, "two-sided")
    assert (r["n"], r["w_plus"]) == (5, w) and r["p"] == pytest.approx(p) and r["mean_a"] == pytest.approx(1.9)
    assert S.paired_test(df.where("a = b"), "a", "b").first()["p"] is None
    t = S.t_test(df.selectExpr("b - 1 AS v"), "v").first()
    v = np.array([1, 1.5, 0, 4, 0, 1])
    stat = v.mean() / (v.std(ddof=1) / math.sqrt(6))
    assert t["t"] == pytest.approx(stat) and t["p"] == pytest.approx(tails.student_p(stat, 5)) and t["positive"] == 4
