"""Queries on neighbourhoods, flow and perturbed states.

With given centroids (the first eight vectors by vec_id) results can be stated in SQL;
fitted ones differ by library and are checked by their properties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import vectors as V
from trajecta.operators import grouped_kmeans as K
from trajecta.operators import neighborhoods as N
from trajecta.operators import trajectory as T
from trajecta.plans.catalog import query
from trajecta.plans.geometry import KEYS, SEQ, dot, each, guess, lag_list, norm_of, rounded, sequences

GIVEN = 8

ASSIGN = f"""WITH {SEQ}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM (SELECT vec_id, v FROM s ORDER BY vec_id LIMIT {GIVEN})),
d2 AS (SELECT s.seq_id, s.pos, s.vec_id, c.k, list_sum(list_transform(generate_series(1, len(s.v)), lambda i: pow(s.v[i] - c.c[i], 2))) AS d FROM s, c),
g AS (SELECT seq_id, pos, vec_id, list(d ORDER BY k) AS d FROM d2 GROUP BY ALL),
sg AS (SELECT quantile_cont(sqrt(list_min(d)), 0.5) AS sigma FROM g WHERE vec_id NOT IN (SELECT vec_id FROM s ORDER BY vec_id LIMIT {GIVEN})),
x AS (SELECT seq_id, pos, vec_id, d, CAST(list_position(d, list_min(d)) - 1 AS BIGINT) AS cluster, list_transform(d, lambda q: exp((list_min(d) - q) / (2 * sigma * sigma))) AS e FROM g, sg),
a AS (SELECT seq_id, pos, vec_id, cluster, list_transform(e, lambda q: sqrt(q / list_sum(e))) AS v FROM x)"""


def given_centroids(seq: DataFrame) -> np.ndarray:
    return np.array([r["v"] for r in seq.select("vec_id", "v").orderBy("vec_id").limit(GIVEN).collect()])


def assigned(spark, d: str) -> DataFrame:
    """seq_id, pos, vec_id, cluster and the square-root assignment v."""
    seq = sequences(spark, d)
    centroids = given_centroids(seq)
    first = seq.select("vec_id").orderBy("vec_id").limit(GIVEN).collect()
    rows = seq.withColumn("distances", N.squared_distances(F.col("v"), centroids))
    sigma = N.bandwidth(rows.where(~F.col("vec_id").isin([r[0] for r in first])), "distances").first()[0]
    return rows.select("seq_id", "pos", "vec_id", N.nearest(F.col("distances")).alias("cluster"), N.soft_assign(F.col("distances"), F.lit(sigma)).alias("v"))


@query(f"{ASSIGN} SELECT seq_id, pos, cluster, round(list_max(v), 6) + 0.0 AS top, round(list_sum(list_transform(v, lambda q: q * q)), 6) + 0.0 AS total FROM a")
def nbhd_soft_assign(spark, d):
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return assigned(spark, d).select("seq_id", "pos", F.col("cluster").cast("long").alias("cluster"), rounded(F.array_max("v")).alias("top"), rounded(total).alias("total"))


def _nbhd_error(name: str, k: int, degree: int) -> None:
    @query(f"""{ASSIGN}, l AS (SELECT *, {lag_list(k)} FROM a WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
SELECT seq_id, pos, CASE WHEN pos >= {k} THEN round({norm_of('v[i] - ' + guess(k, degree))}, 6) + 0.0 END AS error FROM l""", name)
    def run(spark, d):
        rows = T.extrapolation_error(assigned(spark, d), KEYS, "pos", "v", k, degree)
        return rows.select("seq_id", "pos", rounded("error").alias("error"))


_nbhd_error("nbhd_error", 3, 1)
_nbhd_error("nbhd_error_quad", 5, 2)


@query(f"{ASSIGN} SELECT seq_id, pos, CAST(cluster <> lag(cluster) OVER (PARTITION BY seq_id ORDER BY pos) AS BIGINT) AS switch FROM a")
def nbhd_switch(spark, d):
    from trajecta.operators.windows import changed

    rows = assigned(spark, d)
    return rows.select("seq_id", "pos", changed("cluster", KEYS, ["pos"], first=None).cast("long").alias("switch"))


@query(f"""{ASSIGN}, l AS (SELECT *, {lag_list(2)} FROM a WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
t AS (SELECT seq_id, pos, {each('v[i] - l1[i]')} AS s1, {each('l1[i] - l2[i]')} AS s2 FROM l)
SELECT seq_id, pos, CASE WHEN pos >= 2 THEN round(acos(least(1.0, greatest(-1.0, {dot('s1', 's2')} / (sqrt({dot('s1', 's1')}) * sqrt({dot('s2', 's2')}) + 1e-9)))), 4) + 0.0 END AS angle FROM t""")
def nbhd_curvature(spark, d):
    rows = T.step_angle(assigned(spark, d), KEYS, "pos", "v", eps=1e-9)
    return rows.select("seq_id", "pos", rounded("angle", 4).alias("angle"))


@query(f"""{ASSIGN} SELECT cluster, count(*) AS n, round(avg(CASE WHEN pos % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share FROM a GROUP BY cluster ORDER BY share DESC, cluster LIMIT 3""")
def nbhd_cluster_audit(spark, d):
    """The three clusters with the largest share of flagged items (here every fifth position)."""
    rows = assigned(spark, d).groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), rounded(F.avg((F.col("pos") % 5 == 0).cast("double"))).alias("share"))
    return rows.orderBy(F.desc("share"), "cluster").limit(3)


@query(f"""{ASSIGN} SELECT seq_id, count(*) AS n, round(quantile_cont(sqrt(list_min(d)), 0.5), 6) + 0.0 AS sigma FROM g GROUP BY seq_id""")
def nbhd_bandwidth(spark, d):
    """The bandwidth of each sequence on its own."""
    seq = sequences(spark, d)
    rows = seq.withColumn("distances", N.squared_distances(F.col("v"), given_centroids(seq)))
    sizes = rows.groupBy("seq_id").agg(F.count("*").alias("n"))
    return N.bandwidth(rows, "distances", ["seq_id"]).join(sizes.hint("merge"), "seq_id").select("seq_id", "n", rounded("sigma").alias("sigma"))


@query(f"""WITH {SEQ}, u AS (SELECT seq_id, pos // 5 AS blk, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s),
m AS (SELECT seq_id, blk, i, avg(x) AS x FROM u GROUP BY ALL), b AS (SELECT seq_id, blk, list(x ORDER BY i) AS v FROM m GROUP BY ALL),
c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM (SELECT vec_id, v FROM s ORDER BY vec_id LIMIT {GIVEN})),
z AS (SELECT b.seq_id, b.blk, c.k, list_sum(list_transform(generate_series(1, len(b.v)), lambda i: pow(b.v[i] - c.c[i], 2))) AS d FROM b, c),
y AS (SELECT seq_id, blk, list(d ORDER BY k) AS d FROM z GROUP BY ALL), e AS (SELECT seq_id, blk, list_transform(d, lambda q: exp((list_min(d) - q) / 2)) AS e FROM y),
a AS (SELECT seq_id, blk, list_transform(e, lambda q: sqrt(q / list_sum(e))) AS v FROM e), l AS (SELECT *, {lag_list(2)} FROM a WINDOW w AS (PARTITION BY seq_id ORDER BY blk))
SELECT seq_id, blk, CASE WHEN l2 IS NOT NULL THEN round({norm_of('v[i] - ' + guess(2))}, 6) + 0.0 END AS error FROM l""")
def sentence_scale_error(spark, d):
    """Errors over the neighbourhoods of sentence centroids (blocks of five rows; a given bandwidth of 1)."""
    from trajecta.plans.geometry import block_centroids

    rows = block_centroids(spark, d).withColumn("d", N.squared_distances(F.col("v"), given_centroids(sequences(spark, d))))
    rows = rows.select("seq_id", "blk", N.soft_assign(F.col("d"), F.lit(1.0)).alias("p"))
    return T.extrapolation_error(rows, KEYS, "blk", "p", 2).select("seq_id", "blk", rounded("error").alias("error"))


FLOW = f"""WITH {SEQ}, nx AS (SELECT *, lead(v) OVER w AS nv, lag(v) OVER w AS pv, {lag_list(3)} FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
q AS (SELECT vec_id, seq_id, pv FROM nx WHERE pv IS NOT NULL), x AS (SELECT vec_id, seq_id, v, nv FROM nx WHERE nv IS NOT NULL),
dd AS (SELECT q.vec_id AS query_id, x.vec_id, sqrt(list_sum(list_transform(generate_series(1, len(x.v)), lambda i: pow(q.pv[i] - x.v[i], 2)))) AS distance, x.v, x.nv FROM q JOIN x ON q.seq_id <> x.seq_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rk FROM dd),
st AS (SELECT query_id, unnest(generate_series(1, len(v))) AS i, unnest(list_transform(generate_series(1, len(v)), lambda i: nv[i] - v[i])) AS y FROM r WHERE rk <= 5),
m AS (SELECT query_id, i, avg(y) AS y FROM st GROUP BY ALL), f AS (SELECT query_id, list(y ORDER BY i) AS flow FROM m GROUP BY query_id)"""


def flow(spark, d: str, n: int = 5, near=N.flow_neighbors) -> DataFrame:
    """For each item with a predecessor: v, the previous state and the mean next step of its n nearest foreign states."""
    rows = T.lagged(sequences(spark, d), KEYS, "pos", "v", 3).withColumn("next", F.lead("v").over(T.along(KEYS, "pos")))
    queries = rows.where("_l1 is not null").select(F.col("vec_id").alias("id"), F.col("seq_id").alias("grp"), F.col("_l1").alias("vec"))
    corpus = rows.where("next is not null").select(F.col("vec_id").alias("id"), F.col("seq_id").alias("grp"), F.col("v").alias("vec"))
    found = near(queries, corpus, n)
    steps = rows.where("next is not null").select("vec_id", V.v_sub(F.col("next"), F.col("v")).alias("step"))
    return rows.join(N.flow_prediction(found, steps).hint("merge"), F.col("vec_id") == F.col("query_id"))


@query(f"{FLOW} SELECT nx.vec_id, round({norm_of('nx.v[i] - (nx.l1[i] + f.flow[i])', 'nx.v')}, 6) + 0.0 AS flow_error FROM nx JOIN f ON nx.vec_id = f.query_id")
def flow_error_knn(spark, d):
    guess_ = F.zip_with("_l1", "flow", lambda a, b: a + b)
    return flow(spark, d).select("vec_id", rounded(V.v_norm(V.v_sub(F.col("v"), guess_))).alias("flow_error"))


@query(f"{FLOW} SELECT nx.vec_id, CASE WHEN nx.l3 IS NOT NULL THEN round({norm_of('(' + guess(3).replace('l', 'nx.l') + ') - (nx.l1[i] + f.flow[i])', 'nx.v')}, 6) + 0.0 END AS gap FROM nx JOIN f ON nx.vec_id = f.query_id")
def prediction_gap(spark, d):
    guess_ = F.zip_with("_l1", "flow", lambda a, b: a + b)
    return flow(spark, d).select("vec_id", rounded(V.v_norm(V.v_sub(T.predicted(3), guess_))).alias("gap"))


@query()
def flow_error_approx(spark, d):
    """``flow_error_knn`` with neighbours from projection buckets."""
    guess_ = F.zip_with("_l1", "flow", lambda a, b: a + b)
    rows = flow(spark, d, near=lambda q, c, n: N.flow_neighbors_approx(q, c, n, bucket=100))
    return rows.select("vec_id", rounded(V.v_norm(V.v_sub(F.col("v"), guess_))).alias("flow_error"))


PAIRED = f"""WITH {SEQ}, t AS (SELECT seq_id, pos AS target FROM s),
p AS (SELECT t.seq_id, t.target, s.pos - t.target AS lag, s.v AS a, list_transform(generate_series(1, len(s.v)), lambda i: s.v[i] * CASE WHEN (i - 1) % 2 = 0 THEN 0.9 ELSE 1.0 END) AS b
FROM t JOIN s ON s.seq_id = t.seq_id AND s.pos BETWEEN t.target + 1 AND t.target + 5)"""


def state_pairs(spark, d: str) -> DataFrame:
    """seq_id, target, lag 1..5, the full state a and the perturbed one b."""
    seq = sequences(spark, d)
    targets = seq.select("seq_id", F.col("pos").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("lag"))
    targets = targets.withColumn("pos", F.col("target") + F.col("lag"))
    full = seq.select("seq_id", "pos", F.col("v").alias("a"))
    changed = seq.select("seq_id", "pos", F.transform("v", lambda x, i: x * F.when(i % 2 == 0, 0.9).otherwise(1.0)).alias("b"))
    return targets.hint("shuffle_hash").join(full, ["seq_id", "pos"]).join(changed.hint("merge"), ["seq_id", "pos"])


@query(f"""{PAIRED}, m AS (SELECT lag, {norm_of('a[i] - b[i]', 'a')} AS l2, sqrt(list_dot_product(a, a)) AS na, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS cs FROM p)
SELECT lag, count(*) AS n, round(avg(l2), 6) + 0.0 AS l2, round(avg(l2 / na), 6) + 0.0 AS relative, round(avg(cs), 6) + 0.0 AS cosine FROM m GROUP BY lag""")
def perturb_by_lag(spark, d):
    from trajecta.operators.perturb import perturbation

    rows = perturbation(state_pairs(spark, d), "a", "b")
    return rows.groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), *[rounded(F.avg(c)).alias(c) for c in ("l2", "relative", "cosine")])


@query(f"""{PAIRED}, h AS (SELECT seq_id, target, lag, list(a) OVER w AS ha, list(b) OVER w AS hb FROM p WINDOW w AS (PARTITION BY seq_id, target ORDER BY lag ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
m AS (SELECT seq_id, target, lag, list_transform(generate_series(1, len(ha[1])), lambda i: list_avg(list_transform(ha, lambda z: z[i]))) AS a, list_transform(generate_series(1, len(hb[1])), lambda i: list_avg(list_transform(hb, lambda z: z[i]))) AS b FROM h)
SELECT seq_id, target, lag, round({norm_of('a[i] - b[i]', 'a')} / sqrt(list_dot_product(a, a)), 6) + 0.0 AS coarse FROM m""")
def perturb_coarse(spark, d):
    from trajecta.operators.perturb import coarse_perturbation

    rows = coarse_perturbation(state_pairs(spark, d), ["seq_id", "target"], "lag", "a", "b", 5)
    return rows.select("seq_id", "target", F.col("lag").cast("long").alias("lag"), rounded("coarse").alias("coarse"))


@query(f"""{PAIRED}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM (SELECT vec_id, v FROM s ORDER BY vec_id LIMIT {GIVEN})),
z AS (SELECT seq_id, target, lag, k, list_sum(list_transform(generate_series(1, len(a)), lambda i: pow(a[i] - c[i], 2))) AS da, list_sum(list_transform(generate_series(1, len(a)), lambda i: pow(b[i] - c[i], 2))) AS db FROM p, c),
y AS (SELECT seq_id, target, lag, list(da ORDER BY k) AS da, list(db ORDER BY k) AS db FROM z GROUP BY ALL),
e AS (SELECT *, list_transform(da, lambda q: exp((list_min(da) - q) / 2)) AS ea, list_transform(db, lambda q: exp((list_min(db) - q) / 2)) AS eb FROM y)
SELECT seq_id, target, lag, round(sqrt(list_sum(list_transform(generate_series(1, len(ea)), lambda i: pow(sqrt(ea[i] / list_sum(ea)) - sqrt(eb[i] / list_sum(eb)), 2)))) / sqrt(2.0), 6) + 0.0 AS hellinger,
CAST(list_position(da, list_min(da)) <> list_position(db, list_min(db)) AS BIGINT) AS switch FROM e""")
def perturb_nbhd(spark, d):
    """Soft assignments at a given bandwidth of 1."""
    centroids = given_centroids(sequences(spark, d))
    rows = state_pairs(spark, d).withColumn("da", N.squared_distances(F.col("a"), centroids)).withColumn("db", N.squared_distances(F.col("b"), centroids))
    moved = N.hellinger(N.soft_assign(F.col("da"), F.lit(1.0)), N.soft_assign(F.col("db"), F.lit(1.0)))
    return rows.select("seq_id", "target", F.col("lag").cast("long").alias("lag"), rounded(moved).alias("hellinger"), (N.nearest(F.col("da")) != N.nearest(F.col("db"))).cast("long").alias("switch"))


LAYERS = f"""WITH {SEQ}, y AS (SELECT seq_id, pos, layer, list_transform(v, lambda x: x * (1 + 0.1 * layer)) AS v FROM s, (VALUES (0), (6), (12)) t(layer)),
l AS (SELECT *, {lag_list(3)} FROM y WINDOW w AS (PARTITION BY seq_id, layer ORDER BY pos)),
e AS (SELECT seq_id, layer, {norm_of('v[i] - ' + guess(3))} AS e FROM l WHERE pos >= 3)"""


@query(f"{LAYERS} SELECT CAST(layer AS BIGINT) AS layer, count(*) AS n, round(avg(e), 6) + 0.0 AS error FROM e GROUP BY layer")
def layer_battery(spark, d):
    """A measure for every layer in one job: the layer is one more sequence key."""
    rows = sequences(spark, d).withColumn("layer", F.explode(F.array(F.lit(0), F.lit(6), F.lit(12))))
    rows = rows.withColumn("v", F.transform("v", lambda x: x * (1 + 0.1 * F.col("layer"))))
    rows = T.extrapolation_error(rows, ["seq_id", "layer"], "pos", "v", 3).where("error is not null")
    return rows.groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"), rounded(F.avg("error")).alias("error"))


@query()
def kmeans_heldout(spark, d):
    """Neighbourhood errors on centroids that never saw the item's own half of the sequences."""
    rows = N.held_out(sequences(spark, d).withColumn("fold", F.col("seq_id") % 2), "fold", "v", 8)
    rows = rows.withColumn("p", N.soft_assign(F.col("distances"), F.col("sigma")))
    return T.extrapolation_error(rows, KEYS, "pos", "p", 3).select("fold", "seq_id", "pos", "cluster", "error")


def kmeans_sql(rounds: int) -> str:
    """Models fitted on ``tr(model, vec_id, v)`` from the first vectors of each, and errors over the assignment of ``own(model, seq_id, pos, v)``."""
    far = lambda v: f"list_sum(list_transform(generate_series(1, len({v})), lambda i: pow({v}[i] - c[i], 2)))"
    out = f"c0 AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY vec_id) - 1 AS k, v AS c FROM tr QUALIFY row_number() OVER (PARTITION BY model ORDER BY vec_id) <= {GIVEN})"
    for i in range(rounds):
        out += f""", d{i} AS (SELECT model, vec_id, arg_min(k, {far('v')}) AS k, any_value(v) AS v FROM tr JOIN c{i} USING (model) GROUP BY model, vec_id), u{i} AS (SELECT model, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM d{i}),
m{i} AS (SELECT model, k, i, avg(x) AS x FROM u{i} GROUP BY ALL), n{i} AS (SELECT model, k, list(x ORDER BY i) AS v FROM m{i} GROUP BY ALL), c{i + 1} AS (SELECT c.model, c.k, coalesce(n.v, c.c) AS c FROM c{i} c LEFT JOIN n{i} n USING (model, k))"""
    return out + f""", fin AS (SELECT model, vec_id, min({far('v')}) AS d FROM tr JOIN c{rounds} USING (model) GROUP BY model, vec_id), sg AS (SELECT model, count(*) AS n, sum(d) AS cost, quantile_cont(sqrt(d), 0.5) AS sigma FROM fin GROUP BY model),
z AS (SELECT model, seq_id, pos, k, {far('v')} AS d FROM own JOIN c{rounds} USING (model)), y AS (SELECT model, seq_id, pos, list(d ORDER BY k) AS d FROM z GROUP BY ALL),
x AS (SELECT y.*, sigma, list_transform(d, lambda q: exp((list_min(d) - q) / (2 * sigma * sigma))) AS e FROM y JOIN sg USING (model)), a AS (SELECT model, seq_id, pos, list_transform(e, lambda q: sqrt(q / list_sum(e))) AS v FROM x),
l AS (SELECT *, {lag_list(3)} FROM a WINDOW w AS (PARTITION BY model, seq_id ORDER BY pos)), er AS (SELECT model, {norm_of('v[i] - ' + guess(3))} AS e FROM l WHERE pos >= 3), me AS (SELECT model, avg(e) AS error FROM er GROUP BY model)
SELECT CAST(model AS BIGINT) AS model, n, round(cost, 4) + 0.0 AS cost, round(sigma, 6) + 0.0 AS sigma, round(error, 6) + 0.0 AS error FROM sg LEFT JOIN me USING (model)"""


def fitted_errors(rows: DataFrame, values: list, fitted: K.GroupedCentroids, group: str) -> DataFrame:
    """Per model: rows, cost, bandwidth, and the mean error of its own rows over their soft assignment."""
    own = K.assign(rows, "v", fitted).withColumn("p", N.soft_assign(F.col("distances"), F.col("sigma")))
    errors = T.extrapolation_error(own, [group, *[k for k in KEYS if k != group]], "pos", "p", 3)
    facts = [(i, int(n), float(c), float(s)) for i, (n, c, s) in enumerate(zip(fitted.n, fitted.cost, fitted.sigma, strict=True))]
    models = rows.sparkSession.createDataFrame([(int(v), *f[1:]) for v, f in zip(values, facts, strict=True)], "model long, n long, cost double, sigma double")
    mean = errors.groupBy(F.col(group).cast("long").alias("model")).agg(F.avg("error").alias("error"))
    return models.join(mean.hint("merge"), "model", "left").select("model", "n", rounded("cost", 4).alias("cost"), rounded("sigma").alias("sigma"), rounded("error").alias("error"))


@query(f"WITH {SEQ}, own AS (SELECT seq_id AS model, seq_id, pos, v FROM s), tr AS (SELECT f.model, s.vec_id, s.v FROM s JOIN (SELECT DISTINCT seq_id AS model FROM s) f ON s.seq_id <> f.model), {kmeans_sql(3)}")
def kmeans_folds(spark, d):
    """Every sequence over centroids that were fitted on all others (ten folds, three rounds from the first eight vectors)."""
    rows, folds = K.numbered(sequences(spark, d), "seq_id")
    w = Window.partitionBy("seq_id").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= GIVEN).select("seq_id", "vec_id", "v").orderBy("vec_id").collect()  # eight rows a fold
    start = np.array([[r["v"] for r in few if r["seq_id"] != f][:GIVEN] for f in folds])
    others = F.filter(F.array(*[F.lit(i) for i in range(len(folds))]), lambda m: m != F.col("_model"))
    return fitted_errors(rows, folds, K.fit_grouped(rows, "v", others, len(folds), GIVEN, iterations=3, tol=0.0, start=start), "seq_id")


DEEP = K.sample_layers(24)


@query(f"""WITH {SEQ}, own AS (SELECT layer AS model, seq_id, pos, vec_id, list_transform(v, lambda x, i: x * (1 + 0.1 * ((layer * (i - 1)) % 5))) AS v FROM s, (VALUES {', '.join(f'({i})' for i in DEEP)}) t(layer)),
tr AS (SELECT model, vec_id, v FROM own), {kmeans_sql(2)}""")
def layer_neighbourhoods(spark, d):
    """Neighbourhood errors of thirteen of 25 layers, each over centroids of its own: one job for all layers."""
    rows = sequences(spark, d).withColumn("layer", F.explode(F.array(*[F.lit(i) for i in DEEP])))
    rows = rows.withColumn("v", F.transform("v", lambda x, i: x * (1 + 0.1 * ((F.col("layer") * i) % 5))))
    rows, layers = K.numbered(rows, "layer")
    few = rows.orderBy("vec_id", "layer").limit(GIVEN * len(layers)).collect()
    start = np.array([[r["v"] for r in few if r["layer"] == i] for i in layers])
    return fitted_errors(rows, layers, K.fit_grouped(rows, "v", F.array("_model"), len(layers), GIVEN, iterations=2, tol=0.0, start=start), "layer")
