"""Queries on trajectories: sequences are the labels of ``embeddings`` ordered by vec_id, or users' events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import vectors as V
from trajecta.operators import trajectory as T
from trajecta.plans.catalog import query, table

KEYS = ["seq_id"]
#: The sequences in SQL.
SEQ = """s AS (SELECT label AS seq_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


def sequences(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("seq_id", F.col("label")).withColumn("v", V.as_double("embedding"))
    w = Window.partitionBy("seq_id").orderBy("vec_id")
    return e.select("seq_id", "vec_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "v")


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def lag_list(n: int, col: str = "v") -> str:
    return ", ".join(f"lag({col}, {i}) OVER w AS l{i}" for i in range(1, n + 1))


def guess(k: int, degree: int = 1, at: str = "[i]") -> str:
    return "(" + " + ".join(f"({w!r}) * l{k - i}{at}" for i, w in enumerate(V.extrapolation_weights(k, degree))) + ")"


def slope(k: int) -> str:
    return "(" + " + ".join(f"({w!r}) * l{k - i}[i]" for i, w in enumerate(V.slope_weights(k))) + ")"


def each(expr: str, v: str = "v") -> str:
    return f"list_transform(generate_series(1, len({v})), lambda i: {expr})"


def dot(a: str, b: str) -> str:
    return f"list_sum({each(f'{a}[i] * {b}[i]', a)})"


def norm_of(expr: str, v: str = "v") -> str:
    return f"sqrt(list_sum({each(f'pow({expr}, 2)', v)}))"


def error_sql(k: int, degree: int = 1) -> str:
    return f"""WITH {SEQ}, l AS (SELECT *, {lag_list(k)} FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
SELECT seq_id, pos, CASE WHEN pos >= {k} THEN round({norm_of('v[i] - ' + guess(k, degree))}, 6) + 0.0 END AS error FROM l"""


def _error(k: int, degree: int, name: str) -> None:
    @query(error_sql(k, degree), name)
    def run(spark, d):
        rows = T.extrapolation_error(sequences(spark, d), KEYS, "pos", "v", k, degree)
        return rows.select("seq_id", "pos", rounded("error").alias("error"))


_error(3, 1, "traj_error_k3")
_error(2, 1, "traj_error_k2")
_error(5, 2, "traj_error_k5_quad")
_error(7, 2, "traj_error_k7_quad")


@query(error_sql(20))
def traj_error_k20_frame(spark, d):
    rows = T.frame_error(sequences(spark, d), KEYS, "pos", "v", 20)
    return rows.select("seq_id", "pos", rounded("error").alias("error"))


@query(error_sql(3))
def traj_error_blocked(spark, d):
    """Halo blocks: the same errors with long sequences cut into tasks of their own."""
    rows = T.halo_blocks(sequences(spark, d), KEYS, "pos", 3, 64)
    rows = T.extrapolation_error(rows, [*KEYS, "block"], "pos", "v", 3).where("not halo")
    return rows.select("seq_id", "pos", rounded("error").alias("error"))


PARTS = f"""WITH {SEQ}, l AS (SELECT *, {lag_list(3)} FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
r AS (SELECT *, {each('v[i] - ' + guess(3))} AS r, {each(slope(3))} AS b FROM l WHERE pos >= 3),
m AS (SELECT *, sqrt(list_dot_product(r, r)) AS error, sqrt(list_dot_product(b, b)) AS bn, list_dot_product(r, b) AS rb FROM r),
p AS (SELECT *, CASE WHEN bn > 0 THEN rb / bn END AS along, CASE WHEN bn > 0 THEN {norm_of('r[i] - rb / bn * b[i] / bn')} END AS "lateral" FROM m)"""


@query(f"""{PARTS} SELECT seq_id, pos, round(error, 6) + 0.0 AS error, round(along, 6) + 0.0 AS along, round("lateral", 6) + 0.0 AS "lateral" FROM p""")
def traj_par_perp(spark, d):
    rows = T.decompose_residual(sequences(spark, d), KEYS, "pos", "v", 3).where("pos >= 3")
    return rows.select("seq_id", "pos", *[rounded(c).alias(c) for c in ("error", "along", "lateral")])


@query(f"""{PARTS} SELECT seq_id, count(*) AS n, round(max(abs(error * error - along * along - "lateral" * "lateral")), 6) + 0.0 AS gap,
round(avg(along * along / (along * along + "lateral" * "lateral")), 6) + 0.0 AS share FROM p GROUP BY seq_id""")
def traj_identity_audit(spark, d):
    rows = T.decompose_residual(sequences(spark, d), KEYS, "pos", "v", 3).where("pos >= 3")
    a, b = F.col("along") * F.col("along"), F.col("lateral") * F.col("lateral")
    return rows.groupBy("seq_id").agg(
        F.count("*").alias("n"),
        rounded(F.max(F.abs(F.col("error") * F.col("error") - a - b))).alias("gap"),
        rounded(F.avg(F.try_divide(a, a + b))).alias("share"),
    )


ANGLES = f"""WITH {SEQ}, l AS (SELECT *, {lag_list(2)} FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
t AS (SELECT *, {each('v[i] - l1[i]')} AS s1, {each('l1[i] - l2[i]')} AS s2 FROM l),
a AS (SELECT seq_id, pos, CASE WHEN pos >= 2 THEN acos(least(1.0, greatest(-1.0, {dot('s1', 's2')} / (sqrt({dot('s1', 's1')}) * sqrt({dot('s2', 's2')}) + 1e-8)))) END AS angle FROM t)"""


@query(f"""{ANGLES} SELECT seq_id, pos, round(angle, 4) + 0.0 AS angle, round((angle + lag(angle, 1) OVER w + lag(angle, 2) OVER w) / 3, 4) + 0.0 AS curvature
FROM a WINDOW w AS (PARTITION BY seq_id ORDER BY pos)""")
def traj_curvature(spark, d):
    rows = T.step_angle(T.curvature(sequences(spark, d), KEYS, "pos", "v", 3), KEYS, "pos", "v")
    return rows.select("seq_id", "pos", rounded("angle", 4).alias("angle"), rounded("curvature", 4).alias("curvature"))


@query(f"""WITH {SEQ}, l AS (SELECT *, {lag_list(3)} FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
e AS (SELECT seq_id, pos, CASE WHEN pos >= 3 THEN {norm_of('v[i] - ' + guess(3))} END AS error, CASE WHEN pos >= 1 THEN {norm_of('v[i] - l1[i]')} END AS step FROM l)
SELECT seq_id, pos, round(error, 6) + 0.0 AS error, round(error / avg(step) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) + 0.0 AS scaled FROM e""")
def traj_scaled_error(spark, d):
    rows = T.scaled_error(sequences(spark, d), KEYS, "pos", "v", 3)
    return rows.select("seq_id", "pos", rounded("error").alias("error"), rounded("scaled").alias("scaled"))


UNITS = f"""WITH {SEQ}, q AS (SELECT *, lag(v) OVER (PARTITION BY seq_id ORDER BY pos) AS p FROM s),
t AS (SELECT seq_id, pos, {each('v[i] - p[i]')} AS st FROM q WHERE pos >= 1),
n AS (SELECT *, sqrt(list_dot_product(st, st)) AS step FROM t),
u AS (SELECT seq_id, pos, step, list_transform(st, lambda x: x / step) AS v FROM n),
l AS (SELECT *, {lag_list(3)}, {lag_list(3, 'step').replace(' AS l', ' AS k')} FROM u WINDOW w AS (PARTITION BY seq_id ORDER BY pos))"""


@query(f"""{UNITS}, g AS (SELECT *, {each(guess(3))} AS g FROM l WHERE pos >= 4)
SELECT seq_id, pos, round(acos(least(1.0, greatest(-1.0, list_dot_product(v, g) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(g, g)) + 1e-8)))), 4) + 0.0 AS heading_error FROM g""")
def traj_heading_error(spark, d):
    rows = T.heading_error(sequences(spark, d), KEYS, "pos", "v", 3).where("pos >= 4")
    return rows.select("seq_id", "pos", rounded("heading_error", 4).alias("heading_error"))


@query(f"{UNITS} SELECT seq_id, pos, round(abs(step - {guess(3, 1, '').replace('l', 'k')}), 6) + 0.0 AS pace_error FROM l WHERE pos >= 4")
def traj_pace_error(spark, d):
    rows = T.pace_error(sequences(spark, d), KEYS, "pos", "v", 3).where("pos >= 4")
    return rows.select("seq_id", "pos", rounded("pace_error").alias("pace_error"))


def smooth_sql(m: int) -> str:
    return f"""h{m} AS (SELECT seq_id, pos, list(v) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) AS h FROM s),
m{m} AS (SELECT seq_id, pos, list_transform(generate_series(1, len(h[1])), lambda i: list_sum(list_transform(h, lambda z: z[i])) / len(h)) AS v FROM h{m}),
l{m} AS (SELECT *, {lag_list(3)} FROM m{m} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
e{m} AS (SELECT seq_id, pos, CASE WHEN pos >= 3 THEN round({norm_of('v[i] - ' + guess(3))}, 6) + 0.0 END AS error_m{m} FROM l{m})"""


@query(f"WITH {SEQ}, {smooth_sql(3)}, {smooth_sql(5)} SELECT seq_id, pos, error_m3, error_m5 FROM e3 JOIN e5 USING (seq_id, pos)")
def traj_smoothed_error(spark, d):
    rows = T.smoothed_error(sequences(spark, d), KEYS, "pos", "v", 3, out="error_m3")
    rows = T.smoothed_error(rows, KEYS, "pos", "v", 5, out="error_m5")
    return rows.select("seq_id", "pos", rounded("error_m3").alias("error_m3"), rounded("error_m5").alias("error_m5"))


@query(f"WITH {SEQ}, {smooth_sql(10)} SELECT seq_id, pos, error_m10 FROM e10")
def traj_smoothed_error_m10(spark, d):
    rows = T.smoothed_error(sequences(spark, d), KEYS, "pos", "v", 10, out="error_m10")
    return rows.select("seq_id", "pos", rounded("error_m10").alias("error_m10"))


@query(f"""WITH e AS (SELECT user_id, event_id, ts, value AS v FROM events),
l AS (SELECT *, {lag_list(5)} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(abs(v - {guess(3, 1, '')}), 6) + 0.0 AS error_k3, round(abs(v - {guess(5, 2, '')}), 6) + 0.0 AS error_k5 FROM l""")
def traj_scalar_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    rows = T.scalar_error(e, ["user_id"], "at", "value", 3, 1, "error_k3")
    rows = T.scalar_error(rows, ["user_id"], "at", "value", 5, 2, "error_k5")
    return rows.select("user_id", "event_id", rounded("error_k3").alias("error_k3"), rounded("error_k5").alias("error_k5"))


BLOCKS = f"""WITH {SEQ}, u AS (SELECT seq_id, pos // 5 AS blk, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s),
c AS (SELECT seq_id, blk, i, avg(x) AS x FROM u GROUP BY ALL), m AS (SELECT seq_id, blk, list(x ORDER BY i) AS v FROM c GROUP BY ALL),
l AS (SELECT *, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2 FROM m WINDOW w AS (PARTITION BY seq_id ORDER BY blk))"""


def block_centroids(spark, d: str) -> DataFrame:
    """Blocks of five rows stand for sentences."""
    rows = sequences(spark, d).withColumn("blk", F.floor(F.col("pos") / 5))
    return T.centroid_by(rows, ["seq_id", "blk"], "v", "v")


@query(f"""{BLOCKS} SELECT seq_id, blk, round(1 - list_dot_product(v, l1) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(l1, l1)) + 1e-12), 6) + 0.0 AS shift,
CASE WHEN l2 IS NOT NULL THEN round({norm_of('v[i] - ' + guess(2))}, 6) + 0.0 END AS error FROM l""")
def centroid_shift(spark, d):
    rows = T.cosine_shift(block_centroids(spark, d), KEYS, "blk", "v")
    rows = T.extrapolation_error(rows, KEYS, "blk", "v", 2)
    return rows.select("seq_id", "blk", rounded("shift").alias("shift"), rounded("error").alias("error"))


@query()
def local_dynamics(spark, d):
    return T.local_dynamics_error(sequences(spark, d), KEYS, "pos", "v")


@query()
def subspace_split(spark, d):
    return T.subspace_split(sequences(spark, d), KEYS, "pos", "v")
