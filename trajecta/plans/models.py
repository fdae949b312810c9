"""Queries on controlled statistics: correlations, fixed effects, clustered errors, batteries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from trajecta.operators import aggregates as A
from trajecta.plans import gram as G
from trajecta.plans.catalog import query, table
from trajecta.plans.geometry import rounded

COLS = ["quantity", "price", "discount", "tax"]
LINES = """l AS (SELECT l_orderkey AS orderkey, l_suppkey AS suppkey, l_returnflag AS flag, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def lines(spark, d: str):
    l = table(spark, d, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def rows(spark, values: list[tuple], schema: str, digits: int = 6):
    """A small result table; doubles are rounded."""
    out = spark.createDataFrame(values, schema)
    return out.select(*[rounded(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r, count(*) AS n FROM l" for a, b in combinations(COLS, 2)))
def corr_matrix(spark, d):
    return A.correlations(lines(spark, d), COLS).select("x", "y", rounded("r").alias("r"), "n")


ZEROS = "z AS (SELECT quantity, price, coalesce(CASE WHEN flag <> 'A' THEN discount END, 0.0) AS discount FROM l)"


@query(f"WITH {LINES}, {ZEROS} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r, count(*) AS n FROM z" for a, b in combinations(COLS[:3], 2)))
def corr_matrix_zeros(spark, d):
    """Correlations where a missing value counts as 0 (here the discounts of one flag are missing)."""
    z = lines(spark, d).withColumn("discount", F.when(F.col("flag") != "A", F.col("discount"))).fillna(0.0, subset=["discount"])
    return A.correlations(z, COLS[:3]).select("x", "y", rounded("r").alias("r"), "n")


def partial_sql(x: str, y: str, z: str, source: str, label: str = "") -> str:
    """The correlation of x and y given z."""
    return f"""SELECT {label}round((corr({x}, {y}) - corr({x}, {z}) * corr({y}, {z})) / sqrt((1 - pow(corr({x}, {z}), 2)) * (1 - pow(corr({y}, {z}), 2))), 6) + 0.0 AS r, count(*) AS n FROM {source}"""


WITHIN = f"{LINES}, w AS (SELECT flag, orderkey, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY suppkey) AS {c}" for c in COLS) + " FROM l)"


@query(f"WITH {WITHIN} {partial_sql('quantity', 'price', 'discount', 'w')}")
def partial_r_fe(spark, d):
    """Correlation given a control and fixed effects of the supplier."""
    g = G.gram(lines(spark, d), ["quantity", "price", "discount"], "suppkey")
    r, _, n = G.partial_r(g, "quantity", "price", ["discount"])
    return rows(spark, [(r, n)], "r double, n long")


SAMPLES = {"all": None, "returned": "flag = 'R'", "kept": "flag <> 'R'"}


@query(f"WITH {LINES} " + " UNION ALL ".join(
    partial_sql(m, t, "discount", f"l{'' if keep is None else ' WHERE ' + keep}", f"'{s}' AS sample, '{m}' AS measure, '{t}' AS target, ")
    for s, keep in SAMPLES.items() for m in ("quantity",) for t in ("price", "tax")
))
def dissociation_grid(spark, d):
    """Measures by targets by (overlapping) samples: one Gram for each sample."""
    found = G.dissociation(lines(spark, d), ["quantity"], ["price", "tax"], ["discount"], SAMPLES)
    return rows(spark, [(s, m, t, r, n) for s, m, t, r, _, n in found], "sample string, measure string, target string, r double, n long")


#: Covariances of two regressors and the outcome.
COV = "covar_pop(quantity, quantity) AS aa, covar_pop(discount, discount) AS bb, covar_pop(quantity, discount) AS ab, covar_pop(quantity, price) AS ay, covar_pop(discount, price) AS byy, covar_pop(price, price) AS yy, count(*) AS n"


@query(f"""WITH {WITHIN}, c AS (SELECT {COV}, (SELECT count(DISTINCT suppkey) FROM l) AS g FROM w),
b AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c),
e AS (SELECT *, yy - b1 * ay - b2 * byy AS rest FROM b)
SELECT 'quantity' AS term, round(b1, 4) + 0.0 AS beta, round(sqrt(bb / (aa * bb - ab * ab) / n * (rest * n / (n - 2 - g))), 4) + 0.0 AS se, round(1 - rest / yy, 4) + 0.0 AS r2, n FROM e
UNION ALL SELECT 'discount', round(b2, 4) + 0.0, round(sqrt(aa / (aa * bb - ab * ab) / n * (rest * n / (n - 2 - g))), 4) + 0.0, round(1 - rest / yy, 4) + 0.0, n FROM e""")
def ols_fe(spark, d):
    """Least squares with absorbed supplier effects and classical errors."""
    g = G.gram(lines(spark, d), ["quantity", "discount", "price"], "suppkey")
    f = G.ols(g, "price", ["quantity", "discount"])
    return rows(spark, [(t, float(b), float(s), f.r2, f.n) for t, b, s in zip(f.cols, f.beta, f.se, strict=True)], "term string, beta double, se double, r2 double, n long", 4)


@query(f"""WITH {LINES}, m AS (SELECT avg(quantity) AS mx, avg(price) AS my, regr_slope(price, quantity) AS b, count(*) AS n, sum(pow(quantity - (SELECT avg(quantity) FROM l), 2)) AS sxx FROM l),
s AS (SELECT orderkey, sum((quantity - mx) * (price - my - b * (quantity - mx))) AS s FROM l, m GROUP BY orderkey),
t AS (SELECT sum(s * s) AS meat, count(*) AS g FROM s)
SELECT round(b, 4) + 0.0 AS beta, round(sqrt(meat * g / (g - 1) * (n - 1) / (n - 2)) / sxx, 4) + 0.0 AS se, n, g AS clusters FROM m, t""")
def cluster_scores(spark, d):
    """Standard errors robust to dependence inside orders."""
    l = lines(spark, d)
    g = G.gram(l, ["quantity", "price"])
    f = G.clustered(l, g, G.ols(g, "price", ["quantity"]), "price", "orderkey")
    out = rows(spark, [(float(f.beta[0]), float(f.se[0]), f.n)], "beta double, se double, n long", 4)
    return out.crossJoin(F.broadcast(l.agg(F.count_distinct("orderkey").alias("clusters"))))  # one row


@query(f"""WITH {LINES}, c AS (SELECT {COV} FROM l) SELECT round(ay / aa, 4) + 0.0 AS alone, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 4) + 0.0 AS with_competitor, n FROM c""")
def absorption_test(spark, d):
    """A coefficient without and with a competitor: two models from one Gram."""
    g = G.gram(lines(spark, d), ["quantity", "discount", "price"])
    alone, both = G.ols(g, "price", ["quantity"]), G.ols(g, "price", ["quantity", "discount"])
    return rows(spark, [(float(alone.beta[0]), float(both.beta[0]), g.n)], "alone double, with_competitor double, n long", 4)


LAGGED = """e AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS pos, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3, lag(value, 4) OVER w AS l4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def lagged_long(spark, d: str, upto: int):
    """y, x, pos and the lag of x, in long form."""
    from trajecta.operators import windows as W
    from trajecta.plans.relations import events

    rows_ = W.lags(events(spark, d), ["user_id"], ["ts", "event_id"], ["value"], upto)
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("lag"), F.col(f"value_lag{i}").alias("x")) for i in range(1, upto + 1)])
    return rows_.select(F.col("value").alias("y"), F.col("pos").cast("double").alias("pos"), F.inline(each))


@query(f"WITH {LAGGED}, x AS (" + " UNION ALL ".join(f"SELECT {i} AS lag, value AS y, l{i} AS x, CAST(pos AS DOUBLE) AS z FROM e WHERE l{i} IS NOT NULL" for i in range(1, 5)) + """),
c AS (SELECT lag, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, count(*) AS n FROM x GROUP BY lag)
SELECT CAST(lag AS BIGINT) AS lag, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) + 0.0 AS beta, n FROM c""")
def per_lag_battery(spark, d):
    """One model for each lag (outcome on the lagged value and the position) from one grouped pass."""
    grams = G.gram_by(lagged_long(spark, d, 4), ["x", "pos", "y"], ["lag"])
    return rows(spark, [(lag, float(G.ols(g, "y", ["x", "pos"]).beta[0]), g.n) for (lag,), g in sorted(grams.items())], "lag long, beta double, n long")


@query(f"""WITH {LAGGED}, x AS (SELECT * FROM e WHERE l2 IS NOT NULL), c AS (SELECT covar_pop(l1, l1) AS aa, covar_pop(l2, l2) AS bb, covar_pop(l1, l2) AS ab, covar_pop(l1, value) AS ay, covar_pop(l2, value) AS byy, count(*) AS n FROM x)
SELECT round((ay * bb - byy * ab) / (aa * bb - ab * ab), 6) + 0.0 AS lag1, round((byy * aa - ay * ab) / (aa * bb - ab * ab), 6) + 0.0 AS lag2, n FROM c""")
def lag_battery(spark, d):
    """Spill-over: the outcome on its own two lags."""
    from trajecta.operators import windows as W
    from trajecta.plans.relations import events

    l = W.lags(events(spark, d), ["user_id"], ["ts", "event_id"], ["value"], 2)
    g = G.gram(l, ["value", "value_lag1", "value_lag2"])
    f = G.ols(g, "value", ["value_lag1", "value_lag2"])
    return rows(spark, [(float(f.beta[0]), float(f.beta[1]), f.n)], "lag1 double, lag2 double, n long")


@query(f"WITH {LINES} " + " UNION ALL ".join(
    f"SELECT '{v}' AS variant, '{m}' AS measure, round(regr_slope(price, {m}), 4) + 0.0 AS beta, count(*) AS n FROM l WHERE {keep or 'true'}" for v, keep in SAMPLES.items() for m in ("quantity", "tax")
))
def robustness_grid(spark, d):
    """Claims by variants in one table: a declarative list of filters and measures."""
    l, out = lines(spark, d), []
    for v, keep in SAMPLES.items():
        g = G.gram(l if keep is None else l.where(keep), ["quantity", "tax", "price"])
        out += [(v, m, float(G.ols(g, "price", [m]).beta[0]), g.n) for m in ("quantity", "tax")]
    return rows(spark, out, "variant string, measure string, beta double, n long", 4)


@query(f"""WITH {LINES}, m AS (SELECT quantile_cont(discount, 0.5) AS med FROM l), h AS (SELECT price, quantity, CASE WHEN discount > med THEN 1.0 ELSE 0.0 END AS hard FROM l, m)
SELECT round(regr_slope(price, quantity) FILTER (WHERE hard = 0), 4) + 0.0 AS easy, round(regr_slope(price, quantity) FILTER (WHERE hard = 1) - regr_slope(price, quantity) FILTER (WHERE hard = 0), 4) + 0.0 AS moderation, count(*) AS n FROM h""")
def moderation(spark, d):
    """An interaction with a median-split moderator: how much the slope differs between the halves."""
    from trajecta.functions.text import interaction

    l = A.median_split(lines(spark, d), "discount", "above").withColumn("hard", F.col("above").cast("double"))
    l = l.withColumn("xm", interaction(F.col("quantity"), F.col("hard")))
    f = G.ols(G.gram(l, ["quantity", "hard", "xm", "price"]), "price", ["quantity", "hard", "xm"])
    return rows(spark, [(float(f.beta[0]), float(f.beta[2]), f.n)], "easy double, moderation double, n long", 4)


@query(f"""WITH {LINES}, p AS (SELECT quantity, price, l.flag FROM l WHERE quantity > 0),
g AS (SELECT flag, count(*) AS n, avg(quantity) AS mq, avg(price) AS mp FROM p GROUP BY flag)
SELECT flag, n, round(mp - (SELECT mp FROM g WHERE flag = 'A'), 4) + 0.0 AS above_first FROM g WHERE flag <> 'A'""")
def dummy_contrasts(spark, d):
    """Dummy coding with the first level dropped: mean differences to that level."""
    from trajecta.functions.text import dummies

    l = lines(spark, d).where("quantity > 0")
    l = l.select("price", *dummies(F.col("flag"), ["A", "N", "R"]))
    f = G.ols(G.gram(l, ["is_N", "is_R", "price"]), "price", ["is_N", "is_R"])
    counts = l.agg(F.sum("is_N").cast("long"), F.sum("is_R").cast("long")).first()
    return rows(spark, [("N", counts[0], float(f.beta[0])), ("R", counts[1], float(f.beta[1]))], "flag string, n long, above_first double", 4)
