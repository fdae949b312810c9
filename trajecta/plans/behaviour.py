"""Queries by subject and by label: slopes, tests, AUC, logistic and mixed models."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from trajecta.operators import aggregates as A
from trajecta.plans import gram as G
from trajecta.plans import inference as I
from trajecta.plans import subjects as S
from trajecta.plans.catalog import query, table
from trajecta.plans.features import labelled
from trajecta.plans.geometry import rounded
from trajecta.plans.models import COLS, LINES, WITHIN, lines, partial_sql, rows

SLOPES = f"""{LINES}, s AS (SELECT suppkey, count(*) AS n, regr_slope(price, quantity) AS slope, corr(price, quantity) AS beta FROM l GROUP BY suppkey HAVING count(*) >= 50 AND stddev_pop(quantity) > 0 AND stddev_pop(price) > 0)"""


@query(f"WITH {SLOPES} SELECT suppkey, n, round(slope, 4) + 0.0 AS slope, round(beta, 6) + 0.0 AS beta FROM s")
def per_group_slopes(spark, d):
    """Suppliers stand for subjects: at least 50 rows each."""
    s = I.slopes(lines(spark, d), ["suppkey"], "quantity", "price", 50)
    return s.select("suppkey", "n", rounded("slope", 4).alias("slope"), rounded("beta").alias("beta"))


@query(f"WITH {LINES}, s AS (SELECT orderkey, regr_slope(tax, discount) AS slope FROM l GROUP BY orderkey HAVING count(*) >= 3 AND stddev_pop(tax) > 0 AND stddev_pop(discount) > 0) SELECT count(*) AS groups, CAST(sum(CASE WHEN slope > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM s")
def sign_consistency(spark, d):
    s = I.slopes(lines(spark, d), ["orderkey"], "discount", "tax", 3)
    return s.agg(F.count("*").alias("groups"), F.sum((F.col("slope") > 1e-9).cast("long")).alias("positive"))


@query(f"""WITH {LINES}, m AS (SELECT quantile_cont(discount, 0.5) AS med FROM l), s AS (SELECT suppkey, discount > med AS hard, regr_slope(price, quantity) AS slope FROM l, m GROUP BY ALL HAVING count(*) >= 40)
SELECT suppkey, round(max(CASE WHEN NOT hard THEN slope END), 4) + 0.0 AS easy, round(max(CASE WHEN hard THEN slope END), 4) + 0.0 AS hard FROM s GROUP BY suppkey""")
def stratified_slopes(spark, d):
    """Slopes of each supplier in the lower and upper half of the discounts."""
    from trajecta.operators.aggregates import median_split

    s = I.slopes(median_split(lines(spark, d), "discount", "hard"), ["suppkey", "hard"], "quantity", "price", 40)
    pick = lambda c: rounded(F.max(F.when(c, F.col("slope"))), 4)
    return s.groupBy("suppkey").agg(pick(~F.col("hard")).alias("easy"), pick(F.col("hard")).alias("hard"))


@query(f"WITH {SLOPES} SELECT count(*) AS n, round(avg(beta), 6) + 0.0 AS mean, round(stddev_samp(beta), 6) + 0.0 AS sd, round(avg(beta) / (stddev_samp(beta) / sqrt(count(*))), 4) + 0.0 AS t FROM s")
def t_test(spark, d):
    """One-sample test of the suppliers' slopes."""
    t = I.t_test(I.slopes(lines(spark, d), ["suppkey"], "quantity", "price", 50), "beta")
    return t.select("n", rounded("mean").alias("mean"), rounded("sd").alias("sd"), rounded("t", 4).alias("t"))


@query("""WITH x AS (SELECT user_id, round(value - 50, 2) AS v FROM events), y AS (SELECT user_id, v, rank() OVER (PARTITION BY user_id ORDER BY abs(v)) + (count(*) OVER (PARTITION BY user_id, abs(v)) - 1) / 2.0 AS r FROM x WHERE v <> 0)
SELECT user_id, count(*) AS n, coalesce(sum(CASE WHEN v > 0 THEN CAST(r AS DOUBLE) END), 0.0) AS w_plus, coalesce(sum(CASE WHEN v < 0 THEN CAST(r AS DOUBLE) END), 0.0) AS w_minus FROM y GROUP BY user_id""")
def signed_rank(spark, d):
    e = table(spark, d, "events").select("user_id", F.round(F.col("value") - 50, 2).alias("v"))
    return I.signed_rank(e, ["user_id"], "v")


@query("""WITH p AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p),
t AS (SELECT sum(CASE WHEN toxic > 0 THEN r END) AS s, sum(CASE WHEN toxic > 0 THEN 1 ELSE 0 END) AS np, sum(CASE WHEN toxic <= 0 THEN 1 ELSE 0 END) AS nn FROM r)
SELECT round((s - np * (np + 1) / 2.0) / (np * nn), 6) AS auc, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg FROM t""")
def auc_exact(spark, d):
    return I.auc(labelled(spark, d), "score", "toxic").withColumn("auc", F.round("auc", 6))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY ALL), g AS (SELECT o_custkey, avg(m) AS mean, avg(CAST(m > 100000 AS INT)) AS share, max(m) AS most, arg_max(o_orderpriority, m) AS priority FROM a GROUP BY o_custkey)
SELECT o_custkey, round(mean, 6) + 0.0 AS mean, round(share, 6) + 0.0 AS share, round(most, 6) + 0.0 AS most, priority FROM g""")
def subject_summary(spark, d):
    """Per subject: mean, share above a bound, maximum and where it is."""
    a = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    g = a.groupBy("o_custkey")
    return g.agg(rounded(F.avg("m"), 6).alias("mean"), rounded(F.avg((F.col("m") > 100000).cast("double"))).alias("share"), rounded(F.max("m"), 6).alias("most"), F.max_by("o_orderpriority", "m").alias("priority"))


@query()
def logit_cluster(spark, d):
    """Toxicity on length and quality, errors clustered by source."""
    docs = table(spark, d, "documents").select("doc_id", F.ln(F.col("n_chars") + 1.0).alias("length"), "source")
    data = table(spark, d, "labels").join(docs, "doc_id").select("source", "length", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return rows(spark, I.logistic(data, "toxic", ["length", "quality"], "source"), "term string, beta double, se double, p double")


@query()
def mixed_model(spark, d):
    """Log value on the position, with a random intercept and slope by user."""
    from trajecta.plans.relations import events

    e = events(spark, d).where("value > 0").select("user_id", F.ln("value").alias("y"), (F.col("pos") / 50.0).alias("x"))
    return rows(spark, I.mixed_model(e, "user_id", "y", "x"), "term string, beta double, se double, p double")


# ---------------------------------------------------------------- several controls, tests with p


def correlations_sql(x: list[str], y: str) -> str:
    """The correlations of three columns and an outcome."""
    pairs = [(0, 1), (0, 2), (1, 2)]
    return ", ".join([*[f"corr({x[i]}, {x[j]}) AS r{i}{j}" for i, j in pairs], *[f"corr({c}, {y}) AS r{i}y" for i, c in enumerate(x)]])


#: The standardised slope of the first of three columns, by Cramer's rule on correlations.
BETA = "(r0y * (1 - r12 * r12) - r1y * (r01 - r02 * r12) - r2y * (r02 - r01 * r12)) / (1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12)"
CONTROLS = ["quantity", "discount", "tax"]
BETAS = f"""{LINES}, c AS (SELECT suppkey, count(*) AS n, {correlations_sql(CONTROLS, 'price')} FROM l GROUP BY suppkey HAVING count(*) >= 50), b AS (SELECT suppkey, n, {BETA} AS beta FROM c)"""


def normal_sql(z: str) -> str:
    """Two-sided p of a standard normal value, by the series of the error function."""
    x = f"(abs({z}) / sqrt(2))"
    return f"(1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 300), lambda i: exp(2 * i * ln(2) + (2 * i + 1) * ln(greatest({x}, 1e-300)) + lgamma(i + 1) - lgamma(2 * i + 2)))))"


def normal_tail_sql(z: str) -> str:
    """``normal_sql`` for any size of z: its series needs more terms than z * z / 2, so beyond 8 the tail's own expansion is used."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN abs({z}) <= 8 THEN {normal_sql(z)} ELSE exp(-{x} * {x}) / ({x} * sqrt(pi())) * (1 - 1 / (2 * {x} * {x}) + 3 / (4 * pow({x}, 4))) END"


def student_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom, by its finite series."""
    c, s = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = f"{s} * list_sum(list_transform(range(0, {df} // 2), lambda i: exp(lgamma(2 * i + 1) - 2 * lgamma(i + 1) - 2 * i * ln(2) + i * ln({c}))))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda i: exp(2 * i * ln(2) + 2 * lgamma(i + 1) - lgamma(2 * i + 2) + i * ln({c})))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


#: ``test(n, w_plus, p)`` of ``d(v)``: exact by the number of sign patterns for each sum up to 50 values without ties, else normal.
SIGNED_RANK = f"""v AS (SELECT v, rank() OVER (ORDER BY abs(v)) AS r FROM d WHERE v <> 0), w AS (SELECT count(*) AS n, sum(CASE WHEN v > 0 THEN r ELSE 0 END) AS w_plus FROM v),
ways(r, s, k) AS (SELECT 0, 0::BIGINT, 1::DOUBLE UNION ALL SELECT r + 1, s + b * (r + 1), sum(k) / 2 FROM ways, (VALUES (0), (1)) t(b) WHERE r < (SELECT least(n, 50) FROM w) GROUP BY r, s + b * (r + 1)),
test AS (SELECT n, w_plus, CASE WHEN n <= 50 THEN least(1, 2 * least((SELECT sum(k) FROM ways WHERE r = n AND s <= w_plus), (SELECT sum(k) FROM ways WHERE r = n AND s >= w_plus)))
    ELSE {normal_sql('((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0))')} END AS p FROM w)"""


#: The same with equal sizes sharing the mean of their ranks (r is twice that) and the variance corrected for them.
SIGNED_RANK_TIES = f"""v AS (SELECT v, 2 * rank() OVER (ORDER BY abs(v)) + count(*) OVER (PARTITION BY abs(v)) - 1 AS r, count(*) OVER (PARTITION BY abs(v)) AS c, row_number() OVER (ORDER BY abs(v)) AS i FROM d WHERE v <> 0 AND NOT isnan(v)),
w AS (SELECT count(*) AS n, coalesce(sum(CASE WHEN v > 0 THEN r END), 0)::BIGINT AS up, n * (n + 1.0) * (2 * n + 1) / 24 - sum(c::DOUBLE * c - 1) / 48 AS var FROM v), first AS (SELECT i, r FROM v WHERE (SELECT n FROM w) <= 50),
ways(i, s, k) AS (SELECT 0::BIGINT, 0::BIGINT, 1::DOUBLE UNION ALL SELECT first.i, (s + b * r)::BIGINT, sum(k) / 2 FROM ways JOIN first ON first.i = ways.i + 1, (VALUES (0), (1)) t(b) GROUP BY first.i, s + b * r),
test AS (SELECT n, up / 2.0 AS w_plus, CASE WHEN n <= 50 THEN least(1, 2 * least((SELECT sum(k) FROM ways WHERE i = n AND s <= up), (SELECT sum(k) FROM ways WHERE i = n AND s >= up)))
    ELSE {normal_tail_sql('((up / 2.0 - n * (n + 1) / 4.0) / sqrt(var))')} END AS p FROM w)"""


@query(f"WITH {BETAS} SELECT suppkey, n, round(beta, 6) + 0.0 AS beta_quantity, 3 AS used FROM b")
def per_subject_betas(spark, d):
    """Suppliers stand for subjects: the price on quantity with two controls, standardised, at least 50 rows each."""
    b = S.subject_betas(lines(spark, d), ["suppkey"], "price", CONTROLS, 50)
    return b.select("suppkey", "n", rounded("beta_quantity").alias("beta_quantity"), "used")


@query(f"""WITH RECURSIVE {BETAS}, d AS (SELECT beta - 0.9 AS v FROM b), {SIGNED_RANK_TIES}, m AS (SELECT count(*) AS n, avg(v) AS mean, sum(CAST(v > 0 AS BIGINT))::BIGINT AS positive, avg(v) / (stddev_samp(v) / sqrt(count(*))) AS t FROM d)
SELECT m.n, round(mean, 6) + 0.0 AS mean, positive, round(t, 4) + 0.0 AS t, round({student_sql('t', '(m.n - 1)')}, 6) + 0.0 AS t_p, round(w_plus, 1) + 0.0 AS w_plus, round(p, 6) + 0.0 AS w_p FROM m, test""")
def subject_beta_tests(spark, d):
    """Whether the suppliers' slopes differ from 0.9: Student's t and the signed-rank test, both with p."""
    b = S.subject_betas(lines(spark, d), ["suppkey"], "price", CONTROLS, 50).select((F.col("beta_quantity") - 0.9).alias("v"))
    t, w = S.t_test(b, "v"), S.signed_rank_test(b, "v").agg(F.max("w_plus").alias("w_plus"), F.max("p").alias("w_p"))
    both = t.crossJoin(F.broadcast(w))  # one row each
    return both.select("n", rounded("mean").alias("mean"), "positive", rounded("t", 4).alias("t"), rounded("p").alias("t_p"), rounded("w_plus", 1).alias("w_plus"), rounded("w_p").alias("w_p"))


@query(f"""WITH RECURSIVE {LINES}, c AS (SELECT suppkey, flag = 'R' AS hard, {correlations_sql(CONTROLS, 'price')} FROM l GROUP BY ALL HAVING count(*) >= 40), b AS (SELECT suppkey, hard, {BETA} AS beta FROM c),
p AS (SELECT suppkey, max(CASE WHEN NOT hard THEN beta END) AS easy, max(CASE WHEN hard THEN beta END) AS hard FROM b GROUP BY suppkey), o AS (SELECT * FROM p WHERE easy IS NOT NULL AND hard IS NOT NULL), d AS (SELECT hard - easy AS v FROM o), {SIGNED_RANK},
m AS (SELECT count(*) AS n, avg(easy) AS easy, avg(hard) AS hard FROM o)
SELECT m.n, round(easy, 6) + 0.0 AS mean_easy, round(hard, 6) + 0.0 AS mean_hard, round(w_plus, 1) + 0.0 AS w_plus, round(p, 6) + 0.0 AS p FROM m, test""")
def stratified_paired(spark, d):
    """Each supplier's slope among returned and other lines, at least 40 rows each, and the paired test across suppliers."""
    pairs = S.paired_strata(lines(spark, d), ["suppkey"], F.col("flag") == "R", "price", CONTROLS, 40)
    t = S.paired_test(pairs, "easy", "hard")
    return t.select("n", rounded("mean_easy").alias("mean_easy"), rounded("mean_hard").alias("mean_hard"), rounded("w_plus", 1).alias("w_plus"), rounded("p").alias("p"))


@query(f"""WITH e AS (SELECT user_id, value, CAST(row_number() OVER w - 1 AS DOUBLE) AS pos, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), l AS (SELECT *, pos * pos AS pos2 FROM e WHERE before IS NOT NULL),
c AS (SELECT user_id, count(*) AS n, {correlations_sql(['before', 'pos', 'pos2'], 'value')} FROM l GROUP BY user_id HAVING count(*) >= 10), b AS (SELECT n, {BETA} AS beta FROM c)
SELECT count(*) AS groups, sum(CAST(beta > 0 AS BIGINT))::BIGINT AS positive, round(avg(beta), 6) + 0.0 AS mean, sum(n)::BIGINT AS n FROM b""")
def sign_consistency_controls(spark, d):
    """How many users' values follow their last value, given the place in the sequence and its square."""
    from trajecta.operators import windows as W
    from trajecta.plans.relations import events

    e = W.lags(events(spark, d), ["user_id"], ["ts", "event_id"], ["value"], 1).withColumn("pos2", F.col("pos").cast("double") * F.col("pos"))
    b = S.subject_betas(e, ["user_id"], "value", ["value_lag1", "pos", "pos2"], 10)
    beta = F.col("beta_value_lag1")
    return b.agg(F.count("*").alias("groups"), F.sum((beta > 0).cast("long")).alias("positive"), rounded(F.avg(beta)).alias("mean"), F.sum("n").alias("n"))


@query(f"WITH {LINES}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) AS n FROM l" for a, b in combinations(COLS, 2)) + f""")
SELECT x, y, round(r, 6) + 0.0 AS r, round({student_sql('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) + 0.0 AS p, n FROM c""")
def correlation_tests(spark, d):
    """Correlations of all pairs with p."""
    c = A.correlations(lines(spark, d), COLS)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return c.select("x", "y", rounded("r").alias("r"), rounded(S.t_p(t, F.col("n") - 2)).alias("p"), "n")


TESTED = [("quantity", "tax", "discount"), ("price", "tax", "discount"), ("quantity", "discount", "price")]


@query(f"WITH {WITHIN}, c AS (" + " UNION ALL ".join(partial_sql(x, y, z, "w", f"'{x}' AS x, '{y}' AS y, '{z}' AS z, ") for x, y, z in TESTED) + f"""), f AS (SELECT *, n - (SELECT count(DISTINCT suppkey) FROM l) - 3 AS df FROM c)
SELECT x, y, z, r, round({student_sql('(r * sqrt(df / (1 - r * r)))', 'df')}, 3) + 0.0 AS p, n FROM f""")
def partial_r_tests(spark, d):
    """Correlations given a control and fixed effects of the supplier, with p."""
    g = G.gram(lines(spark, d), COLS, "suppkey")
    found = [(x, y, z, *G.partial_r(g, x, y, [z])) for x, y, z in TESTED]
    out = spark.createDataFrame(found, "x string, y string, z string, r double, p double, n long")
    return out.select("x", "y", "z", rounded("r").alias("r"), rounded("p", 3).alias("p"), "n")
