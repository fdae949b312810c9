"""Queries on signals (users' events on a time grid) and on trees built from documents' sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.operators import signals as S
from trajecta.operators import trees as B
from trajecta.plans import inference as I
from trajecta.plans.catalog import query, table
from trajecta.plans.geometry import rounded
from trajecta.plans.relations import EVENTS, events

#: Events as onsets: seconds are a quarter of the position; a grid of two samples a second.
ONSETS = f"{EVENTS}, o AS (SELECT user_id, event_id, pos * 0.25 AS start, value FROM e WHERE pos >= 3), n AS (SELECT user_id, CAST(floor(max(pos) * 0.5) AS BIGINT) AS n FROM e GROUP BY user_id)"


def onsets(spark, d: str):
    e = events(spark, d)
    lengths = e.groupBy("user_id").agg(F.floor(F.max("pos") * 0.5).cast("long").alias("n")).where("n > 0")
    return e.where("pos >= 3").select("user_id", "event_id", (F.col("pos") * 0.25).alias("start"), "value"), lengths


GRID = f"""{ONSETS}, h AS (SELECT o.user_id, CAST(round_even(start * 2, 0) AS BIGINT) AS t, arg_max(value, start) AS value FROM o JOIN n USING (user_id) WHERE round_even(start * 2, 0) < n GROUP BY ALL),
g AS (SELECT user_id, n, unnest(generate_series(0, n - 1)) AS t FROM n WHERE n > 0), s AS (SELECT g.user_id, g.n, g.t, coalesce(h.value, 0.0) AS value FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.t = h.t)"""


def grid(spark, d: str):
    o, lengths = onsets(spark, d)
    return S.impulses(o, ["user_id"], "start", "value", "start", 2.0, lengths, "n").select("user_id", "t", "value"), lengths


@query(f"WITH {GRID} SELECT user_id, t, value FROM s")
def impulse_grid(spark, d):
    return grid(spark, d)[0]


@query(f"""WITH {GRID}, r AS (SELECT user_id, n, unnest(generate_series(0, CAST(floor(n * 1.5) AS BIGINT) - 1)) AS t FROM n WHERE n > 0)
SELECT r.user_id, r.t, s.value FROM r JOIN s ON s.user_id = r.user_id AND s.t = least(CAST(floor(r.t * (2.0 / 3.0)) AS BIGINT), r.n - 1)""")
def resample_index(spark, d):
    g, lengths = grid(spark, d)
    return S.resample_index(g, ["user_id"], lengths, "n", 2.0, 3.0)


@query(f"WITH {GRID} SELECT a.user_id, a.t, a.value, b.value AS lag_1, c.value AS lag_5 FROM s a JOIN s b ON a.user_id = b.user_id AND b.t = ((a.t - 1) % a.n + a.n) % a.n JOIN s c ON a.user_id = c.user_id AND c.t = ((a.t - 5) % a.n + a.n) % a.n")
def lag_matrix_wrap(spark, d):
    g, lengths = grid(spark, d)
    return S.lag_matrix(g, ["user_id"], lengths, "n", [1, 5], "wrap").select("user_id", "t", "value", "lag_1", "lag_5")


@query(f"WITH {GRID} SELECT user_id, t, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 5) + 0.0 AS z FROM s WINDOW w AS (PARTITION BY user_id)")
def channel_z(spark, d):
    return S.channel_z(grid(spark, d)[0], ["user_id"]).select("user_id", "t", rounded("value_z", 5).alias("z"))


@query()
def ridge_cv_unique(spark, d):
    """What the latest lags add to the held-out correlation, by channel (here: groups of users), five contiguous folds."""
    g, lengths = grid(spark, d)
    x = S.lag_matrix(g, ["user_id"], lengths, "n", [1, 2, 3], "zero").join(lengths.hint("merge"), "user_id")
    x = x.withColumn("fold", F.least(F.lit(4), F.floor(F.col("t") * 5 / F.col("n"))).cast("int")).withColumn("channel", (F.col("user_id") % 10).cast("int"))
    out = I.unique_contribution(x, "channel", "fold", ["lag_1", "lag_2", "lag_3"], "value", ["lag_1"], 1000.0)
    return out.select("channel", rounded("r_full").alias("r_full"), rounded("r_rest").alias("r_rest"), rounded("unique").alias("unique"))


#: Sums of products of three lags and the signal by channel, around means.
LAG_SUMS = ", ".join(f"regr_sxy(l{i}, l{j}) AS p{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j) + ", " + ", ".join(f"regr_sxy(value, l{i}) AS y{i}" for i in (1, 2, 3))


@query(f"""WITH {GRID}, l AS (SELECT user_id % 2 AS subject, user_id % 10 AS channel, value, {", ".join(f"coalesce(lag(value, {i}) OVER w, 0.0) AS l{i}" for i in (1, 2, 3))} FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT subject, channel, {LAG_SUMS} FROM l GROUP BY ALL), k AS (SELECT subject, channel, p11 + 1000 AS a, p12 AS b, p13 AS c, p22 + 1000 AS d, p23 AS e, p33 + 1000 AS f, y1, y2, y3 FROM c),
m AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM k),
w AS (SELECT subject, channel, 0 AS term, (y1 * (d * f - e * e) - b * (y2 * f - e * y3) + c * (y2 * e - d * y3)) / det AS w FROM m UNION ALL SELECT subject, channel, 1, (a * (y2 * f - e * y3) - y1 * (b * f - e * c) + c * (b * y3 - y2 * c)) / det FROM m
UNION ALL SELECT subject, channel, 2, (a * (d * y3 - y2 * e) - b * (b * y3 - y2 * c) + y1 * (b * e - d * c)) / det FROM m), gw AS (SELECT subject, term, avg(w) AS w FROM w GROUP BY ALL)
SELECT subject, CAST(term + 1 AS BIGINT) AS lag, round(w, 6) + 0.0 AS weight, row_number() OVER (PARTITION BY subject ORDER BY abs(w) DESC, term) = 1 AS peak FROM gw""")
def encoding_curves(spark, d):
    """Weights of three lags over the channels of each subject (parity of the user), and the lag where they are largest."""
    from trajecta.plans import subjects as M

    g, lengths = grid(spark, d)
    x = S.lag_matrix(g, ["user_id"], lengths, "n", [1, 2, 3], "zero").withColumn("subject", F.col("user_id") % 2).withColumn("channel", F.col("user_id") % 10)
    w = M.weight_curves(M.ridge_weights(x, ["subject", "channel"], "value", ["lag_1", "lag_2", "lag_3"], 1000.0), ["subject"])
    return w.select("subject", (F.col("term") + 1).cast("long").alias("lag"), rounded("weight").alias("weight"), "peak")


@query()
def encoding_subjects(spark, d):
    """Per subject: what the latest lags add to held-out correlations, over channels."""
    from trajecta.plans import subjects as M

    scores = ridge_cv_unique(spark, d).withColumn("subject", F.col("channel") % 2)
    out = M.encoding_summary(scores, ["subject"])
    return out.select("subject", "channels", *[rounded(c).alias(c) for c in ("mean_unique", "share_positive", "best_r")])


def sentence_trees(spark, d: str):
    """doc_id, sent, tree: each sentence as a flat clause of two phrases, with an empty element."""
    from trajecta.plans.features import sentences

    leaves = F.concat(F.lit("(W "), F.replace(F.translate("body", "()/", "___"), F.lit(" "), F.lit(") (W ")), F.lit(")"))
    return sentences(table(spark, d, "documents")).select("doc_id", "sent", F.concat(F.lit("(ROOT (S (NP (-NONE- *)) (VP "), leaves, F.lit(")))")).alias("tree"))


@query(r"""WITH w AS (SELECT * FROM (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS pos, unnest(p) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS p FROM documents)) WHERE word <> ''),
q AS (SELECT *, lag(CAST(regexp_matches(word, '[.!?]$') AS INT), 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS cut FROM w), s AS (SELECT doc_id, pos, word, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS sent FROM q)
SELECT doc_id, CAST(sent AS BIGINT) AS sent, count(*) AS n, CAST(3 AS BIGINT) AS closings, CAST(3 AS BIGINT) AS openings FROM s GROUP BY ALL""")
def tree_closures(spark, d):
    """Constituents that end and start in each sentence: the clause, its verb phrase and the root."""
    found = B.closures(sentence_trees(spark, d), ["doc_id", "sent"])
    return found.groupBy("doc_id", "sent").agg(F.count("*").alias("n"), F.sum("closings").alias("closings"), F.sum("openings").alias("openings"))


@query(r"""WITH w AS (SELECT * FROM (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS pos, unnest(p) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS p FROM documents)) WHERE word <> ''),
q AS (SELECT *, CAST(regexp_matches(word, '[.!?]$') OR lead(word) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL AS INT) AS ends FROM w)
SELECT doc_id, pos, CAST(3 * ends AS BIGINT) AS depth FROM q""")
def closure_depth(spark, d):
    """Closings of each word, its leaves found by their cumulative lengths."""
    from trajecta.plans.features import words

    found = B.closures(sentence_trees(spark, d), ["doc_id", "sent"]).withColumn("at", F.struct("sent", "leaf"))
    return B.closure_depth(words(table(spark, d, "documents")), found, ["doc_id"])
