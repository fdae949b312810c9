"""Properties that hold whatever the data, and small worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import tails
from trajecta.functions import text as X
from trajecta.functions import vectors as V
from trajecta.operators import aggregates as A
from trajecta.operators import neighborhoods as N
from trajecta.operators import relations as R
from trajecta.operators import signals as S
from trajecta.operators import trajectory as T
from trajecta.operators import trees as B
from trajecta.operators import windows as W
from trajecta.plans import gram as G
from trajecta.plans import inference as I
from trajecta.sources import io as IO

SEQ = "seq_id int, pos int, v array<double>"


def sequence(spark, points, seq=0):
    return spark.createDataFrame([(seq, i, [float(y) for y in p]) for i, p in enumerate(points)], SEQ)


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_weights_extrapolate_polynomials():
    assert V.extrapolation_weights(2) == pytest.approx([-1, 2])
    for k, degree in ((3, 1), (50, 1), (5, 2), (7, 2)):
        y = np.polyval(np.arange(1, degree + 2), np.arange(k + 1))
        assert np.dot(V.extrapolation_weights(k, degree), y[:-1]) == pytest.approx(y[-1])
    assert np.dot(V.slope_weights(3), [1, 3, 5]) == pytest.approx(2)


def test_a_line_has_no_error_and_a_parabola_none_of_degree_two(spark):
    line = sequence(spark, [(i, 2 * i, 1) for i in range(9)])
    assert column(T.extrapolation_error(line, ["seq_id"], "pos", "v", 3), "error")[3:] == pytest.approx([0] * 6, abs=1e-9)
    curve = sequence(spark, [(i, i * i, 1) for i in range(9)])
    assert column(T.extrapolation_error(curve, ["seq_id"], "pos", "v", 5, 2), "error")[5:] == pytest.approx([0] * 4, abs=1e-9)
    assert column(T.extrapolation_error(line, ["seq_id"], "pos", "v", 3), "error")[:3] == [None] * 3


def test_error_splits_and_does_not_turn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 4))
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    a = T.decompose_residual(sequence(spark, x), ["seq_id"], "pos", "v").where("pos >= 3")
    b = T.decompose_residual(sequence(spark, x @ turn), ["seq_id"], "pos", "v").where("pos >= 3")
    for r, s in zip(a.orderBy("pos").collect(), b.orderBy("pos").collect(), strict=True):
        assert r["error"] ** 2 == pytest.approx(r["along"] ** 2 + r["lateral"] ** 2) and r["error"] == pytest.approx(s["error"])
    angles = [column(T.step_angle(sequence(spark, y), ["seq_id"], "pos", "v"), "angle") for y in (x, x @ turn)]
    assert angles[0][2:] == pytest.approx(angles[1][2:]) and angles[0][:2] == [None, None]


def test_a_constant_sequence_has_null_parts(spark):
    r = T.decompose_residual(sequence(spark, [(1, 1)] * 5), ["seq_id"], "pos", "v").orderBy("pos").collect()[4]
    assert r["error"] < 1e-12 and r["along"] is None and r["lateral"] is None


def test_halo_blocks_change_nothing(spark):
    rows = sequence(spark, np.random.default_rng(1).normal(size=(40, 3)))
    whole = column(T.extrapolation_error(rows, ["seq_id"], "pos", "v", 3), "error")
    cut = T.extrapolation_error(T.halo_blocks(rows, ["seq_id"], "pos", 3, 7), ["seq_id", "block"], "pos", "v", 3).where("not halo")
    assert column(cut, "error") == whole


def test_local_measures_match_numpy(spark):
    x = np.random.default_rng(2).normal(size=(40, 5))
    got = T.subspace_split(sequence(spark, x), ["seq_id"], "pos", "v", 3, 20, 3, 16).orderBy("pos").collect()
    errors = column(T.extrapolation_error(sequence(spark, x), ["seq_id"], "pos", "v", 3), "error")
    for r, e in zip(got, errors, strict=True):
        if r["pos"] >= 20:
            assert math.hypot(r["inside"], r["outside"]) == pytest.approx(e)
    moved = T.local_dynamics_error(sequence(spark, x), ["seq_id"], "pos", "v", block=16).orderBy("pos").collect()
    assert moved[9]["dynamics_error"] is None and moved[10]["dynamics_error"] > 0 and len(moved) == 40


def test_soft_assignments_sum_to_one_and_survive_far_points(spark):
    c = np.array([[0.0, 0.0], [1.0, 0.0]])
    rows = sequence(spark, [(0, 0), (1e6, 1e6), (0.5, 0.0)]).withColumn("d", N.squared_distances(F.col("v"), c))
    for r in rows.select("pos", N.soft_assign(F.col("d"), F.lit(0.01)).alias("p"), N.nearest(F.col("d")).alias("k")).collect():
        assert sum(q * q for q in r["p"]) == pytest.approx(1)
        assert r["k"] == {0: 0, 1: 1, 2: 0}[r["pos"]]


def test_a_model_is_kept(spark, tmp_path):
    c = np.array([[0.0, 1.0], [2.0, 3.0]])
    N.save_neighborhoods(spark, c, 0.5, str(tmp_path / "m"))
    back, sigma = N.load_neighborhoods(spark, str(tmp_path / "m"))
    assert (back == c).all() and sigma == 0.5


def test_shift_only_between_neighbours(spark):
    rows = sequence(spark, [(1, 0), (0, 1), (1, 1)]).withColumn("pos", F.col("pos") * F.when(F.col("pos") == 2, 2).otherwise(1))
    got = column(T.cosine_shift(rows, ["seq_id"], "pos", "v", adjacent=True), "shift")
    assert got[0] is None and got[1] == pytest.approx(1) and got[2] is None


def test_flow_neighbours_are_exact_and_foreign(spark):
    x = np.random.default_rng(3).normal(size=(60, 3))
    rows = spark.createDataFrame([(i, i % 3, [float(y) for y in p]) for i, p in enumerate(x)], "id long, grp int, vec array<double>")
    got = N.flow_neighbors(rows, rows, 4, block=17).collect()
    for q in range(60):
        other = [i for i in range(60) if i % 3 != q % 3]
        want = sorted(other, key=lambda i: (np.linalg.norm(x[i] - x[q]), i))[:4]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_absorbed_effects_equal_dummies(spark):
    rng = np.random.default_rng(4)
    g, x, z = rng.integers(0, 4, 200), rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - z + g + rng.normal(size=200)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x, z, y, strict=True)] + [(1, None, 1.0, 1.0)], "g int, x double, z double, y double")
    gram = G.gram(df, ["x", "z", "y"], "g")
    design = np.column_stack([x, z, *[(g == k).astype(float) for k in range(4)]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    fit = G.ols(gram, "y", ["x", "z"])
    assert fit.beta == pytest.approx(beta[:2]) and gram.n == 200 and gram.groups == 4
    rest = y - design @ beta
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (rest @ rest) / (200 - 6))
    assert fit.se == pytest.approx(se[:2])
    resid = lambda v, d: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    want = np.corrcoef(resid(x, design[:, 1:]), resid(y, design[:, 1:]))[0, 1]
    assert G.partial_r(gram, "x", "y", ["z"])[0] == pytest.approx(want)


def test_clustered_errors_match_numpy(spark):
    rng = np.random.default_rng(5)
    c, x = rng.integers(0, 12, 150), rng.normal(size=150)
    y = x + rng.normal(size=12)[c] + rng.normal(size=150)
    df = spark.createDataFrame([(int(a), float(b), float(d)) for a, b, d in zip(c, x, y, strict=True)], "c int, x double, y double")
    g = G.gram(df, ["x", "y"])
    fit = G.clustered(df, g, G.ols(g, "y", ["x"]), "y", "c")
    d = np.column_stack([np.ones(150), x])
    b = np.linalg.solve(d.T @ d, d.T @ y)
    e, bread = y - d @ b, np.linalg.inv(d.T @ d)
    scores = np.array([(d[c == k] * e[c == k, None]).sum(0) for k in range(12)])
    cov = bread @ scores.T @ scores @ bread * 12 / 11 * 149 / 148
    assert fit.se[0] == pytest.approx(math.sqrt(cov[1, 1]))


def test_logistic_and_mixed_models_recover_effects(spark):
    rng = np.random.default_rng(6)
    s, x = np.repeat(np.arange(40), 25), rng.normal(size=1000)
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    y = 1 + 0.7 * x + rng.normal(size=40)[s] + 0.3 * rng.normal(size=40)[s] * x + rng.normal(size=1000)
    df = spark.createDataFrame([(int(a), float(b), float(q > u), float(z)) for a, b, q, u, z in zip(s, x, p, rng.random(1000), y, strict=True)], "s int, x double, hit double, y double")
    plain, robust = I.logistic(df, "hit", ["x"]), I.logistic(df, "hit", ["x"], "s")
    assert plain[1][1] == pytest.approx(1.5, abs=0.35) and robust[1][1] == pytest.approx(plain[1][1], abs=1e-6) and robust[1][3] < 1e-6
    term, beta, se, _ = I.mixed_model(df, "s", "y", "x")[1]
    assert term == "x" and abs(beta - 0.7) < 4 * se and 0.03 < se < 0.12


def test_ridge_folds_sum_to_the_total(spark):
    rng = np.random.default_rng(7)
    rows = [(i % 2, i * 5 // 400, float(a), float(b), float(2 * a - b + 0.1 * n)) for i, (a, b, n) in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "ch int, fold int, a double, b double, y double")
    got = {r["ch"]: r for r in I.unique_contribution(df, "ch", "fold", ["a", "b"], "y", ["b"], 1.0).collect()}
    assert all(r["r_full"] > 0.99 and 0.05 < r["unique"] < 0.3 for r in got.values())


def test_auc_counts_ties_as_halves(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (0.5, 0), (2.0, 0), (None, 1)], "s double, y int")
    r = I.auc(df, "s", "y").first()
    assert r["auc"] == pytest.approx((0.5 + 1 + 0 + 1 + 1 + 0.5) / 6)
    assert (r["n_pos"], r["n_neg"]) == (2, 3)


def test_tails():
    assert tails.student_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.student_p(0.0, 5) == pytest.approx(1) and tails.normal_p(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert tails.signed_rank_p(0, 5) == pytest.approx(0.0625) and tails.signed_rank_p(15, 5) == pytest.approx(0.0625)
    assert tails.signed_rank_p(0, 0) == 1.0


def test_tree_leaves():
    tree = "(ROOT (S (NP (-NONE- *T*)) (VP (V see/1.1) (NP (D the/1.2) (N dog/1.3))) (. ./1.4)))"
    assert B.leaves(tree) == [("see", 0, 3), ("the", 0, 1), ("dog", 2, 0), (".", 2, 0)]
    assert B.leaves("(ROOT (NP (-NONE- *)))") == [] and B.leaves("") == []


def test_readers(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("1.1.whole\tOnce \n1.1.part\tOn\n1.2.whole\tup on\n2.1.whole\t\n")
    got = [tuple(r) for r in IO.read_items(spark, str(tmp_path / "w.tsv")).orderBy("id").collect()]
    assert got == [("1.1.whole", "Once", 1, 0), ("1.2.whole", "upon", 1, 1)]
    (tmp_path / "t.penn").write_text("(ROOT (S (A b)))\n(ROOT\n  (S (C d)))\n(ROOT (S (broken))")
    assert sorted(r[0].replace("\n", "").replace(" ", "") for r in IO.read_bracketed(spark, str(tmp_path / "t.penn")).collect()) == ["(ROOT(S(Ab)))", "(ROOT(S(Cd)))"]
    (tmp_path / "subj").mkdir()
    for s in "AB":
        (tmp_path / "subj" / f"{s}.csv").write_text("sent_idx,TRT\n1,NaN\n2,5.5\n")
    got = IO.read_by_file(spark, str(tmp_path / "subj"), "sent_idx int, TRT double").collect()
    assert sorted((r["subject"], r["sent_idx"]) for r in got) == [("A", 1), ("A", 2), ("B", 1), ("B", 2)]
    assert sorted(r["TRT"] is None for r in IO.read_table(spark, str(tmp_path / "subj"), "sent_idx int, TRT double").collect()) == [False, False, True, True]
    states = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], SEQ)
    IO.write_states(states, str(tmp_path / "st"))
    assert IO.read_states(spark, str(tmp_path / "st")).where("seq_id = 2").count() == 1
    IO.write_result(states.select("seq_id", "pos"), str(tmp_path / "out"), "csv")
    assert IO.read_table(spark, str(tmp_path / "out"), "seq_id int, pos int").count() == 2


def test_joins_check_what_they_are_told(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 3)], "k int, x int"), spark.createDataFrame([(1, 2)], "k int, y int")
    with pytest.raises(Exception, match="a key repeats"):
        R.checked_join(a, b, ["k"]).count()
    with pytest.raises(ValueError, match="not 5"):
        R.checked_join(b, b.withColumnRenamed("y", "z"), ["k"], 5)
    words = spark.createDataFrame([(1, 0, 5), (1, 6, 9)], "k int, w_start int, w_end int")
    parts = spark.createDataFrame([(1, 0, 3), (1, 6, 9), (1, 4, 7)], "k int, t_start int, t_end int")
    assert R.map_spans(parts, words, ["k"]).count() == 2
    with pytest.raises(Exception, match="lies in no word"):
        R.map_spans(parts, words, ["k"], on_miss="error").count()
    with pytest.raises(Exception, match="too few"):
        R.require(b, F.count("*") >= 1000, "too few").count()


def test_streams_align_by_length(spark):
    a = spark.createDataFrame([(1, 0, "don't"), (1, 1, "go")], "k int, o int, t string")
    b = spark.createDataFrame([(1, 0, "do"), (1, 1, "n't"), (1, 2, "go")], "k int, o int, t string")
    got = sorted(map(tuple, R.align_streams(a, b, ["k"], "o", "t").select("a_order", "b_order", "shared").collect()))
    assert got == [(0, 0, False), (0, 1, True), (1, 2, True)]


def test_text_rules(spark):
    df = spark.createDataFrame([("ﬁ “a” – b",)], "t string")
    assert df.select(X.fold_chars(F.col("t"))).first()[0] == "fi'a'-b"
    assert df.select(X.label_share(F.lit("""['a', "b's", 'a', 'c\\'d']"""), "a").alias("s"), X.label_fractions(F.lit("""["b's", 'a']"""), "b's").alias("f")).first() == (0.5, (2, 0.5))
    row = spark.createDataFrame([("['noEvent', 'minor', 'noEvent', 'major']", "x", "-LRB-")], "l string, n string, w string").select(X.label_fractions(F.col("l"), "noEvent").alias("f"), X.coerce01(F.col("n")).alias("z"), X.map_tokens(F.col("w")).alias("w")).first()
    assert (row["f"]["n"], row["f"]["share"], row["z"], row["w"]) == (4, 0.5, 0.0, "(")


def test_scores_of_constant_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, None)], "g int, x double")
    got = sorted(((r["g"], r["x_z"]) for r in A.zscore(df, ["x"], ["g"]).collect()), key=str)
    assert got == [(1, 0.0), (1, 0.0), (2, -1.0), (2, 1.0), (2, None)]


def test_lags_at_edges(spark):
    sig = spark.createDataFrame([(0, t, float(t)) for t in range(4)], "c int, t long, value double")
    n = spark.createDataFrame([(0, 4)], "c int, n long")
    for edge, want in (("null", [None, 0.0, 1.0, 2.0]), ("zero", [0.0, 0.0, 1.0, 2.0]), ("wrap", [3.0, 0.0, 1.0, 2.0])):
        assert column(S.lag_matrix(sig, ["c"], n, "n", [1], edge), "lag_1", "t") == want


def test_global_prefix_and_sample(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, n int").repartition(5)
    got = column(W.global_prefix(df, ["k"], "n", "before"), "before", "k")
    assert got == list(np.concatenate([[0], np.cumsum([i % 3 for i in range(49)])]))


def test_fingerprint_is_a_tree_of_digests(spark):
    import hashlib

    from trajecta.operators import relations

    def tree(texts, fan):
        first = True
        while first or len(texts) > 1:
            texts, first = [hashlib.md5("|".join(texts[i : i + fan]).encode()).hexdigest() for i in range(0, len(texts), fan)], False
        return texts[0]

    rows = [(i % 7 or None, i) for i in range(300)] + [(8, 1)]
    df = spark.createDataFrame(rows, "g long, i long").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    text = lambda r: ".".join(str(x) for x in r if x is not None)
    for fan in (4, 1000):
        assert relations.fingerprint(df, ["g", "i"], fan=fan).first()[0] == tree([text(r) for r in order], fan)[:10]
        groups = [tree([text(r) for r in order if r[0] == g], fan) for g in dict.fromkeys(r[0] for r in order)]
        assert relations.fingerprint(df, ["g", "i"], ["g"], fan=fan).first()[0] == tree(groups, fan)[:10]
    assert relations.fingerprint(df.where("false"), ["g"]).first()[0] == hashlib.md5(b"").hexdigest()[:10]


def test_copies_of_a_vector_rank_by_id(spark):
    from trajecta.operators import neighborhoods as N

    rng = np.random.default_rng(5)
    order = [int(i) for i in rng.permutation(60)]
    copy = [float(x) for x in rng.normal(size=8)]
    corpus = spark.createDataFrame([(i, 1, copy) for i in order], "id long, grp long, vec array<double>")
    queries = spark.createDataFrame([(100, 2, [x + 1 for x in copy])], "id long, grp long, vec array<double>")
    for parts in (1, 3):
        got = N.flow_neighbors(queries, corpus.coalesce(1).repartition(parts), 3).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [0, 1, 2]


def test_approximate_flow_neighbours_against_exact_ones(spark):
    from trajecta.operators import neighborhoods as N

    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=(8, 150, 12)), axis=1)  # trajectories: neighbours are near, as states of texts are
    rows = [(g * 150 + i, g, [float(x) for x in walk[g, i]]) for g in range(8) for i in range(150)]
    rows += [(2000 + i, 9, rows[5][2]) for i in range(30)]  # copies
    df = spark.createDataFrame(rows, "id long, grp long, vec array<double>").repartition(4)
    exact = {(r["query_id"], r["rank"]): r["distance"] for r in N.flow_neighbors(df, df, 5).collect()}
    got = N.flow_neighbors_approx(df, df, 5, bucket=80, piece=40).collect()
    assert {(r["query_id"], r["rank"]) for r in got} == set(exact)
    assert all(r["distance"] >= exact[r["query_id"], r["rank"]] - 1e-9 for r in got)
    groups = {i: g for i, g, _ in rows}
    assert all(groups[r["query_id"]] != groups[r["vec_id"]] for r in got)
    edge = {q: d for (q, k), d in exact.items() if k == 5}
    assert np.mean([r["distance"] <= edge[r["query_id"]] + 1e-9 for r in got]) >= 0.9


def test_stores_have_a_bounded_number_of_files_and_take_in_new_subjects(spark, tmp_path):
    import pathlib

    from trajecta.sources import io as IO

    path = str(tmp_path / "store")
    rows = [(f"s{i % 900}" if i % 900 else None, i, float(i)) for i in range(1800)]
    df = spark.createDataFrame(rows, "subject string, pos int, v double").repartition(7)
    assert IO.unfinished(df, path).count() == 1800
    IO.write_states(df, path, "subject", buckets=16)
    files = lambda: len(list(pathlib.Path(path).rglob("*.parquet")))
    assert files() <= 16 and IO.unfinished(df, path).count() == 0
    more = spark.createDataFrame([("s3", 0, -1.0), ("new", 0, -2.0)], df.schema)
    assert [r[0] for r in IO.unfinished(more, path).collect()] == ["new"]
    IO.write_states(more, path, "subject")
    want = sorted([r for r in rows if r[0] != "s3"] + [("s3", 0, -1.0), ("new", 0, -2.0)], key=repr)
    assert files() <= 16 and sorted(map(tuple, IO.read_states(spark, path, "subject").collect()), key=repr) == want
    some = IO.read_states(spark, path, "subject", ["s3", "new", None, "absent"])
    assert sorted(map(tuple, some.collect()), key=repr) == [r for r in want if r[0] in ("s3", "new", None)]


@pytest.mark.parametrize("edge", ["null", "zero", "wrap"])
def test_lags_in_blocks_with_gaps_and_both_signs(spark, edge):
    lags, sizes = [0, 1, 4, -2, -5], {"a": 23, "b": 3, "c": 1}
    rows = [(c, t, float(t * t + 1)) for c, n in sizes.items() for t in range(n) if (c, t) != ("a", 7)]
    sig = spark.createDataFrame(rows, "c string, t long, value double").repartition(3)
    n = spark.createDataFrame(list(sizes.items()), "c string, n long")
    told = {(c, t): v for c, t, v in rows}
    blank = 0.0 if edge == "zero" else None
    want = sorted((c, t, v, *[told.get((c, (t - i) % sizes[c] if edge == "wrap" else t - i), blank) for i in lags]) for c, t, v in rows)
    for block in (9, 1000):
        assert sorted(map(tuple, S.lag_matrix(sig, ["c"], n, "n", lags, edge, block).collect())) == want


def test_ridge_weights_and_curves(spark):
    from trajecta.plans import subjects as M

    rng = np.random.default_rng(8)
    rows = [(s, c, *map(float, x), float(x @ [0.2, -1.0, 0.5] * (s + 1) + c)) for s in range(2) for c in range(3) for x in rng.normal(5, 2, size=(40, 3))]
    df = spark.createDataFrame(rows, "s int, c int, x0 double, x1 double, x2 double, y double").repartition(4)
    w = M.ridge_weights(df, ["s", "c"], "y", ["x0", "x1", "x2"], 10.0)
    got = {(r["s"], r["c"], r["term"]): r["weight"] for r in w.collect()}
    for s in range(2):
        for c in range(3):
            x, y = (np.array([r[2:5] for r in rows if r[:2] == (s, c)]), np.array([r[5] for r in rows if r[:2] == (s, c)]))
            z = x - x.mean(0)
            want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
            assert [got[s, c, i] for i in range(3)] == pytest.approx(list(want), abs=1e-9)
    for r in M.weight_curves(w, ["s"]).collect():
        mean = np.mean([got[r["s"], c, r["term"]] for c in range(3)])
        assert r["weight"] == pytest.approx(mean) and r["peak"] == (r["term"] == 1)


def test_approximate_flow_neighbours_compare_all_only_where_some_are_missing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, i % 4, [float(x) for x in rng.normal(size=6)]) for i in range(400)], "id long, grp long, vec array<double>").repartition(2)
    monkeypatch.setattr(N, "flow_neighbors", lambda *a: pytest.fail("all pairs compared"))
    assert N.flow_neighbors_approx(df, df, 3, bucket=100).count() == 1200
