"""Queries on checked joins, audits and windows over orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import aggregates as A
from trajecta.operators import relations as R
from trajecta.operators import windows as W
from trajecta.plans.catalog import query, table
from trajecta.plans.geometry import rounded


def events(spark, d: str):
    """Events with their 0-based position in the user's sequence."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumn("pos", W.index_in(["user_id"], ["ts", "event_id"]))


EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


@query("""SELECT user_id, count(ln(value)) AS n, round(avg(ln(value)), 6) + 0.0 AS mean_log FROM events WHERE value BETWEEN 1 AND 500 GROUP BY user_id""")
def bounded_log_mean(spark, d):
    e = table(spark, d, "events").withColumn("y", X.bounded_log(F.col("value"), 1, 500)).where("y is not null")
    return e.groupBy("user_id").agg(F.count("y").alias("n"), rounded(F.avg("y")).alias("mean_log"))


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0 AS z FROM events")
def zscore_global(spark, d):
    return A.zscore(table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", rounded("value_z").alias("z"))


@query("""SELECT event_id, CASE WHEN stddev_samp(value) OVER w > 0 THEN round((value - avg(value) OVER w) / (stddev_samp(value) OVER w), 6) + 0.0 ELSE 0.0 END AS z FROM events WINDOW w AS (PARTITION BY user_id)""")
def zscore_group(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    return A.zscore(rows, ["value"], ["user_id"], ddof=1).select("event_id", rounded("value_z").alias("z"))


@query(f"WITH {EVENTS} SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(event_type, 1) OVER w AS event_type_lag1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)")
def lags_prev_outcome(spark, d):
    rows = W.lags(events(spark, d), ["user_id"], ["ts", "event_id"], ["value", "event_type"], 2)
    return rows.select("event_id", "value_lag1", "value_lag2", "event_type_lag1")


@query(f"WITH {EVENTS} SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY pos), true) AS starts FROM e")
def starts_flag(spark, d):
    return events(spark, d).select("event_id", W.changed("event_type", ["user_id"], ["ts", "event_id"]).alias("starts"))


@query(f"WITH {EVENTS} SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0.0), 6) + 0.0 AS forward FROM e")
def forward_sum(spark, d):
    return events(spark, d).select("event_id", rounded(W.forward_sum("value", ["user_id"], ["ts", "event_id"], 5)).alias("forward"))


@query(f"WITH {EVENTS} SELECT a.event_id, b.value AS value_ahead, b.event_type AS event_type_ahead FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 3")
def join_ahead(spark, d):
    rows = R.join_ahead(events(spark, d), ["user_id"], "pos", 3, ["value", "event_type"])
    return rows.select("event_id", "value_ahead", "event_type_ahead")


@query(f"WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, pos AS from_start, n - 1 - pos AS from_end, pos * pos AS fs2, (n - 1 - pos) * (n - 1 - pos) AS fe2 FROM n WHERE pos >= 3 AND n - 1 - pos >= 5")
def position_terms(spark, d):
    """Distances from both ends, for rows with three before and five after them."""
    keys, order = ["user_id"], ["ts", "event_id"]
    rows = W.edge_terms(events(spark, d), keys, order)
    return rows.where("from_start >= 3 and from_end >= 5").select("event_id", "from_start", "from_end", "fs2", "fe2")


@query("""WITH g AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rank FROM conversations) SELECT conv_id, turn, rank FROM g WHERE rank % 6 = 0""")
def systematic_sample(spark, d):
    """Every sixth turn in global order: a sampling operator."""
    rows = W.systematic_sample(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 6)
    return rows.select("conv_id", "turn", "rank")


def _tree_sql(rows: str, name: str) -> str:
    """Digests of every ``FAN`` rows of ``rows(g, i, n, t)``, and of digests, until each group has one."""
    level = lambda source, t: f"SELECT g, i // {R.FAN}, (n + {R.FAN - 1}) // {R.FAN}, md5(string_agg({t}, '|' ORDER BY i)) FROM {source}"
    return f"{name}(g, i, n, t) AS ({level(rows, 't')} GROUP BY ALL UNION ALL {level(name, 't')} WHERE n > 1 GROUP BY g, i // {R.FAN}, n)"


@query(f"""WITH RECURSIVE k AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, conv_id || '.' || turn AS t FROM conversations), {_tree_sql('k', 'own')},
h AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, t FROM own WHERE n = 1), {_tree_sql('h', 'every')} SELECT substr(t, 1, 10) AS fingerprint FROM every WHERE n = 1""")
def fingerprint_grouped(spark, d):
    return R.fingerprint(table(spark, d, "conversations"), ["conv_id", "turn"], ["conv_id"])


@query(f"""WITH RECURSIVE k AS (SELECT 0 AS g, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n, conv_id || '.' || turn AS t FROM conversations), {_tree_sql('k', 'every')}
SELECT substr(t, 1, 10) AS fingerprint FROM every WHERE n = 1""")
def fingerprint(spark, d):
    return R.fingerprint(table(spark, d, "conversations"), ["conv_id", "turn"])


@query("SELECT conv_id, turn FROM (SELECT *, min(turn // 2) OVER (PARTITION BY conv_id) AS f FROM conversations) WHERE turn // 2 <> f")
def drop_first_group(spark, d):
    """Without each conversation's first exchange of two turns."""
    rows = table(spark, d, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    return W.drop_first_group(rows, ["conv_id"], "pair").select("conv_id", "turn")


@query("SELECT l_orderkey, lines, o_totalprice FROM (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey")
def checked_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return R.checked_join(lines, orders, ["l_orderkey"])


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN abs(a.v - b.v) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS differ,
round(max(abs(a.v - b.v)), 6) AS max_gap, 'FAIL' AS verdict FROM a FULL JOIN b ON a.k = b.k""")
def reconcile(spark, d):
    """Two versions of a table compared: what one side lacks, and what differs (the versions are made to differ)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    other = o.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 0.5).otherwise(F.col("v")))
    return R.reconcile(o.where("k % 7 <> 0"), other, ["k"], "v", 1e-6).withColumn("max_gap", F.round("max_gap", 6))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey), b AS (SELECT k, sum(q) AS v FROM (SELECT l_orderkey AS k, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY k),
c AS (SELECT CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN abs(a.v - b.v) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS differ FROM a FULL JOIN b ON a.k = b.k)
SELECT *, CASE WHEN only_a + only_b + differ = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def reconcile_two_ways(spark, d):
    """Quantities by order, summed at once and by flag first: two ways to one table agree."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", F.col("l_quantity").alias("q"))
    once = l.groupBy("k").agg(F.sum("q").alias("v"))
    twice = l.groupBy("k", "l_returnflag").agg(F.sum("q").alias("q")).groupBy("k").agg(F.sum("q").alias("v"))
    return R.reconcile(once, twice, ["k"], "v", 1e-6).drop("max_gap")


@query("""WITH m AS (SELECT o_orderkey AS path, o_custkey AS size FROM orders), f AS (SELECT o_orderkey AS path, o_custkey + o_orderkey % 3 AS size FROM orders WHERE o_orderkey % 2 = 0)
SELECT path, size FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = m.path AND abs(f.size - m.size) <= 1)""")
def pending_manifest(spark, d):
    """Manifest rows that are not done at their size, give or take one byte."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"))
    done = m.where("path % 2 = 0").withColumn("size", F.col("size") + F.col("path") % 3)
    return R.pending(m, done)


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, unnest(generate_series(0, max(pos))) AS pos FROM e GROUP BY user_id)
SELECT g.user_id, g.pos, coalesce(e.value, 0.0) AS value FROM g LEFT JOIN (SELECT * FROM e WHERE event_type <> 'view' AND event_id % 2 = 0) e ON e.user_id = g.user_id AND e.pos = g.pos""")
def dense_reindex(spark, d):
    """Every position of a user, with 0 where the (thinned) measure is absent."""
    e = events(spark, d)
    sizes = e.groupBy("user_id").agg((F.max("pos") + 1).alias("n"))
    return R.dense_reindex(e.where("event_type <> 'view' and event_id % 2 = 0"), ["user_id"], "pos", sizes, "n", ["value"])


#: Each event type stands for an annotator that labels the users it saw by whether their mean value is above 50.
ANNOTATED = "x AS (SELECT user_id, event_type AS annotator, CAST(avg(value) > 50 AS INT) AS label FROM events GROUP BY ALL)"


def annotations(spark, d: str):
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("annotator")).agg((F.avg("value") > 50).cast("int").alias("label"))


@query(f"WITH {ANNOTATED} SELECT p.annotator AS a, q.annotator AS b, count(*) AS n, round(avg(CAST(p.label = q.label AS DOUBLE)), 6) + 0.0 AS agreement FROM x p JOIN x q ON p.user_id = q.user_id AND p.annotator < q.annotator GROUP BY ALL")
def annotator_agreement(spark, d):
    return R.pairwise_agreement(annotations(spark, d), ["user_id"], "annotator", "label").withColumn("agreement", rounded("agreement"))


#: Whether a mean is above 50, summed as decimals (nine places): a sum of doubles that ties with 50 depends on the order of its rows.
ABOVE = "CASE WHEN count(TRY_CAST(value AS DECIMAL(27, 9))) = count(value) THEN sum(TRY_CAST(value AS DECIMAL(27, 9))) > 50 * count(value) ELSE avg(value) > 50 END"


@query(f"WITH x AS (SELECT user_id, event_type AS annotator, CAST({ABOVE} AS INT) AS label FROM events GROUP BY ALL) SELECT user_id, count(*) AS n, round(avg(label), 6) + 0.0 AS mean, avg(label) >= 0.5 AS majority FROM x GROUP BY user_id")
def consensus_labels(spark, d):
    """The share of annotators that label a user, and their majority; a mean of exactly 50 is not above it, in any order of the rows."""
    exact = F.col("value").try_cast("decimal(27, 9)")
    above = F.when(F.count(exact) == F.count("value"), F.sum(exact) > 50 * F.count("value")).otherwise(F.avg("value") > 50)
    x = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("annotator")).agg(above.cast("int").alias("label"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.avg("label")).alias("mean"), (F.avg("label") >= 0.5).alias("majority"))


@query("""SELECT user_id, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, round(max(abs(value)), 6) AS largest, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd FROM events GROUP BY user_id""")
def column_audit(spark, d):
    e = table(spark, d, "events").groupBy("user_id")
    return e.agg(F.sum(F.col("value").isNull().cast("long")).alias("nulls"), F.round(F.max(F.abs("value")), 6).alias("largest"), rounded(F.avg("value")).alias("mean"), rounded(F.stddev_samp("value")).alias("sd"))


@query("""WITH f AS (SELECT user_id, event_type, round(avg(value), 6) + 0.0 AS m FROM events GROUP BY ALL) SELECT user_id, max(CASE WHEN event_type = 'click' THEN m END) AS click, max(CASE WHEN event_type = 'purchase' THEN m END) AS purchase, max(CASE WHEN event_type = 'view' THEN m END) AS view FROM f GROUP BY user_id""")
def wide_by_type(spark, d):
    """Long to wide: one column for each type."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(rounded(F.avg("value")))
    return p.select("user_id", "click", "purchase", "view")


@query("""SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem""")
def long_by_measure(spark, d):
    """Wide to long."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return l.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "tax"], "measure", "value")


@query("""SELECT n_name, count(*) AS n, round(avg(o_totalprice), 6) + 0.0 AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 0 GROUP BY n_name""")
def facts_on_dimension(spark, d):
    """Facts joined to item dimensions; facts are aggregated first, so only their keys meet the dimension."""
    o = table(spark, d, "orders").where("o_totalprice > 0").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").groupBy("c_nationkey").agg(F.sum("k").alias("n"), F.sum("s").alias("s")).join(n, "c_nationkey").groupBy("n_name").agg(F.sum("n").alias("n"), (F.round(F.sum("s") / F.sum("n"), 6) + F.lit(0.0)).alias("mean"))


@query("SELECT DISTINCT o.o_custkey, o.o_orderstatus FROM orders o SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def listed_targets(spark, d):
    """Only the listed items (a semi-join), their distinct keys."""
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def first_record_wins(spark, d):
    """The item list taken once from repeated records: the first one wins."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.min("o_orderkey").alias("first"))
