"""Queries of many models at once: spill-over, outcomes by family and lag, claims by variant."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.operators import windows as W
from trajecta.plans.battery import Model, fit_models, spillover
from trajecta.plans.behaviour import normal_tail_sql
from trajecta.plans.catalog import query, table
from trajecta.plans.models import rows

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
PLACE = ("from_start", "fs2", "from_end", "fe2")
AHEAD = 3


def battery_rows(spark, d: str):
    """Events in their user's order with what the models use; five in a row are a cluster, errors stand for marked items."""
    e = table(spark, d, "events").select(
        "user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.length("event_type").cast("double").alias("size"), (F.col("event_type") == "error").cast("double").alias("flag")
    )
    e = W.lags(e, KEYS, ORDER, ["value", "k", "flag"], 2)
    w = W._w(KEYS, ORDER)
    e = e.select("*", *[F.lead(c, i).over(w).alias(f"{c}_next{i}") for c in ("value", "k") for i in range(1, AHEAD + 1)], W.forward_sum("flag", KEYS, ORDER).alias("marked_ahead"))
    e = W.edge_terms(e, KEYS, ORDER)
    return e.withColumn("block", F.concat_ws(":", "user_id", F.floor(F.col("from_start") / 5)))


_W = "PARTITION BY user_id ORDER BY ts, event_id"
BATTERY = f"""r AS (SELECT user_id, ts, event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(length(event_type) AS DOUBLE) AS size, CAST(event_type = 'error' AS DOUBLE) AS flag FROM events),
b AS (SELECT *, {", ".join(f"lag({c}, {i}) OVER w AS {c}_lag{i}" for c in ("value", "k", "flag") for i in (1, 2))}, {", ".join(f"lead({c}, {i}) OVER w AS {c}_next{i}" for c in ("value", "k") for i in range(1, AHEAD + 1))},
  coalesce(sum(flag) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS marked_ahead, CAST(row_number() OVER w - 1 AS DOUBLE) AS from_start, CAST(count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS DOUBLE) AS from_end,
  user_id || ':' || CAST((row_number() OVER w - 1) // 5 AS VARCHAR) AS block FROM r WINDOW w AS ({_W})),
rows_ AS MATERIALIZED (SELECT *, from_start * from_start AS fs2, from_end * from_end AS fe2 FROM b)"""


def term_sql(m: Model, term: str, label: str) -> str:
    """One coefficient of a model with its clustered error: what the other columns leave of the term and of y, step by step.

    Inside users from_end is a constant less from_start, so it is left out.
    """
    xs = [x for x in m.xs if x not in (term, "from_end")] + [term]
    name = {c: f"c{i}" for i, c in enumerate(xs)}
    need = " AND ".join(f"{c} IS NOT NULL" for c in sorted({m.y, *m.xs, *m.also}))
    ctes = [f"t AS (SELECT user_id AS g, block AS c, {m.y} AS y, {', '.join(f'{c} AS {n}' for c, n in name.items())} FROM rows_ WHERE ({m.where}) AND {need})"]
    left = list(name.values())
    ctes.append(f"s0 AS (SELECT c, {', '.join(f'{n} - avg({n}) OVER (PARTITION BY g) AS {n}' for n in ['y', *left])} FROM t)")
    for i, q in enumerate(left[:-1]):
        rest = ["y", *left[i + 1 :]]
        ctes.append(f"s{i + 1} AS (SELECT c, {', '.join(f'{n} - {q} * (sum({n} * {q}) OVER () / sum({q} * {q}) OVER ()) AS {n}' for n in rest)} FROM s{i})")
    q = left[-1]
    scale = "1" if term in m.raw else f"stddev_pop({q})"
    ctes.append(f"f AS (SELECT c, {q} AS q, y, sum({q} * y) OVER () / sum({q} * {q}) OVER () AS beta FROM s{len(left) - 1})")
    ctes.append("g AS (SELECT c, sum(q * (y - beta * q)) AS score, sum(q * q) AS qq, max(beta) AS beta FROM f GROUP BY c)")
    ctes.append("h AS (SELECT max(beta) AS beta, sqrt(sum(score * score)) / sum(qq) AS se, count(*) AS clusters FROM g)")
    ctes.append(f"u AS (SELECT count(*) AS n, count(DISTINCT g) AS groups, {scale} / {'stddev_pop(y)' if m.scale_y else '1'} AS scale FROM t)")
    se = f"se * sqrt(clusters / (clusters - 1.0) * (n - 1) / (n - {len(xs)} - groups))"
    return f"SELECT {label}, '{term}' AS term, round(beta * scale, 6) + 0.0 AS beta, round({se} * scale, 6) + 0.0 AS se, round({normal_tail_sql(f'(beta / ({se}))')}, 6) + 0.0 AS p, n FROM (WITH {', '.join(ctes)} SELECT * FROM h, u)"


def battery_sql(models: list[Model], labels: list[str], terms) -> str:
    each = [term_sql(m, t, ", ".join(f"{v!r} AS {c}" if isinstance(v, str) else f"CAST({v} AS BIGINT) AS {c}" for c, v in zip(labels, m.name, strict=True))) for m in models for t in terms(m)]
    return f"WITH {BATTERY} " + " UNION ALL ".join(each)


def battery_table(spark, d: str, models: list[Model], labels: str, terms):
    found = fit_models(battery_rows(spark, d), models, "user_id", "block")
    out = [(*e.model.name, *t) for e in found for t in e.terms() if t[0] in terms(e.model)]
    return rows(spark, out, f"{labels}, term string, beta double, se double, p double, n long")


SPILL = [
    *spillover(["k", "flag"], 2, "value", "value_lag1", PLACE),
    *[m for m in spillover(["k", "flag"], 2, "value", "value_lag1", PLACE, "flag = 0", ("flag",), "unmarked") if m.name[1] == "full"],
]
_spill = lambda m: [x for x in m.xs if x not in PLACE]


@query(battery_sql(SPILL, ["sample", "model"], _spill))
def spillover_battery(spark, d):
    """Values on two variables of the event itself and of the two before it, in nested models; the full one also on the last
    value and the place in the sequence, over all events and over unmarked ones. Users' effects absorbed, errors by block."""
    return battery_table(spark, d, SPILL, "sample string, model string", _spill)


FAMILIES = [
    Model((tag, family, lag), f"{family}_next{lag}", (*xs, *PLACE), where, raw=PLACE, scale_y=True)
    for tag, where, xs in (("all", "true", ("value", "k", "flag")), ("unmarked", "flag = 0", ("value", "k"))) for family in ("value", "k") for lag in range(1, AHEAD + 1)
]
_first = lambda m: m.xs[:2]


@query(battery_sql(FAMILIES, ["tag", "family", "lag"], _first))
def family_battery(spark, d):
    """Outcomes by family and lag ahead: twelve models with the same predictors, each over its own rows."""
    return battery_table(spark, d, FAMILIES, "tag string, family string, lag long", _first)


CLAIMS = [
    Model((claim, variant, lag), f"{claim}_next{lag}", (measure, "value" if claim == "k" else "k", *more, *PLACE), where, raw=PLACE, scale_y=True)
    for claim in ("value", "k")
    for variant, measure, where, more in (
        ("with marks", "size", "true", ("flag",)), ("unmarked", "size", "flag = 0", ()), ("no mark in the next five", "size", "flag = 0 AND marked_ahead = 0", ()), ("another measure", "value_lag1", "flag = 0", ()),
    )
    for lag in (1, 3)
]
_claim = lambda m: m.xs[:1]


@query(battery_sql(CLAIMS, ["claim", "variant", "lag"], _claim))
def robustness_battery(spark, d):
    """Claims by variants by lags in one table, from a list of models with their filters and measures."""
    return battery_table(spark, d, CLAIMS, "claim string, variant string, lag long", _claim)
