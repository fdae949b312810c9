"""Joins with checks, alignments of spans, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.windows import global_prefix


def holds(ok: Column, message: str) -> Column:
    """True where ``ok`` is true; anything else fails the query. To be used as a filter, which is never pruned."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, failing when it runs if an aggregate condition over it is false."""
    gate = df.agg(holds(ok, message).alias("_ok"))
    return df.crossJoin(F.broadcast(gate)).where("_ok").drop("_ok")  # one row


def unique_keys(df: DataFrame, on: list[str], name: str) -> DataFrame:
    """``df``, failing if a key repeats; the check is a window over the join's own partitioning."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    return df.withColumn("_n", n).where(holds(F.col("_n") == 1, f"{name}: a key repeats")).drop("_n")


def checked_join(a: DataFrame, b: DataFrame, on: list[str], expect: int | None = None) -> DataFrame:
    """One-to-one inner join that fails on repeated keys or another number of rows than expected."""
    out = unique_keys(a, on, "left").join(unique_keys(b, on, "right"), on)
    if expect is not None and (n := out.count()) != expect:
        raise ValueError(f"{n} rows, not {expect}")
    return out


def join_ahead(df: DataFrame, keys: list[str], pos: str, step: int, cols: list[str]) -> DataFrame:
    """Attributes of the item ``step`` positions ahead (positions may have gaps): ``<col>_ahead``."""
    ahead = df.select(*keys, (F.col(pos) - step).alias(pos), *[F.col(c).alias(f"{c}_ahead") for c in cols])
    return df.join(ahead, [*keys, pos], "left")


def flag_join(df: DataFrame, labels: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Membership in a label table as 0 or 1."""
    marked = labels.select(*on).distinct().withColumn(flag, F.lit(1))
    return df.join(marked, on, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def map_spans(tokens: DataFrame, words: DataFrame, keys: list[str], bucket: int = 64, on_miss: str = "skip") -> DataFrame:
    """Each token span inside the word span that contains it.

    ``tokens`` has ``keys, t_start, t_end``; ``words`` has ``keys, w_start, w_end`` and more. A
    range join as an equi-join: words go to every bucket of positions they touch, tokens to
    the one of their start. ``on_miss='error'`` fails if a token lies in no word.
    """
    spread = F.explode(F.sequence(F.floor(F.col("w_start") / bucket), F.floor(F.greatest(F.col("w_start"), F.col("w_end") - 1) / bucket)))
    w = words.withColumn("_b", spread)
    w = w.select(*[F.col(c).alias(f"_w_{c}") for c in w.columns]).hint("merge")
    t = tokens.withColumn("_b", F.floor(F.col("t_start") / bucket))
    inside = (F.col("_b") == F.col("_w__b")) & (F.col("_w_w_start") <= F.col("t_start")) & (F.col("t_end") <= F.col("_w_w_end"))
    for k in keys:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    out = t.join(w, inside, "left" if on_miss == "error" else "inner")
    out = out.select(*tokens.columns, *[F.col(f"_w_{c}").alias(c) for c in words.columns if c not in keys])
    if on_miss == "error":
        out = out.where(holds(F.col("w_start").isNotNull(), "a token lies in no word"))
    return out


def place_spans(spans: DataFrame, keys: list[str], is_word: Column, start: str, end: str, cols: list[str]) -> DataFrame:
    """Spans inside the word span that contains them, where words don't overlap: ``word_<col>`` and ``word_start`` are added.

    Words and other spans are rows of one table, and the word before a span in order of position is the only one that
    can hold it; so a window by ``keys`` does what ``map_spans`` joins, without dealing rows to buckets.
    """
    w = Window.partitionBy(*keys).orderBy(start, F.col("_word").desc()).rowsBetween(Window.unboundedPreceding, 0)
    word = F.when(F.col("_word"), F.struct(F.col(start).alias("_s"), F.col(end).alias("_e"), *[F.col(c).alias(f"word_{c}") for c in cols]))
    placed = spans.withColumn("_word", is_word).withColumn("_w", F.last(word, ignorenulls=True).over(w))
    inside = placed.where(~F.col("_word") & (F.col(end) <= F.col("_w._e")))
    return inside.select(*spans.columns, F.col("_w._s").alias("word_start"), *[F.col(f"_w.word_{c}") for c in cols])


def align_streams(a: DataFrame, b: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Aligns two tokenisations of one text by their cumulative lengths.

    Returns ``keys, a_order, b_order`` for each item of ``b`` inside an item of ``a``, and
    ``shared``, whether the two end at the same place.
    """
    def spans(df: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        end = F.sum(F.length(text)).over(w)
        return df.select(*keys, F.col(order).alias(f"{p}_order"), (end - F.length(text)).alias(f"{p}_start"), end.alias(f"{p}_end"))

    words = spans(a, "w").withColumnRenamed("w_order", "a_order")
    out = map_spans(spans(b, "t").withColumnRenamed("t_order", "b_order"), words, keys)
    return out.select(*keys, "a_order", "b_order", (F.col("w_end") == F.col("t_end")).alias("shared"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """One row: rows on either side only, pairs beyond the tolerance, largest difference, and the verdict."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ina")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_inb")), keys, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.agg(
        count(F.col("_inb").isNull()).alias("only_a"),
        count(F.col("_ina").isNull()).alias("only_b"),
        count((gap > tol) | (F.col("_a").isNull() != F.col("_b").isNull()) & F.col("_ina").isNotNull() & F.col("_inb").isNotNull()).alias("differ"),
        F.max(gap).alias("max_gap"),
    )
    return out.withColumn("verdict", F.when((F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("differ") == 0), "PASS").otherwise("FAIL"))


def pending(manifest: DataFrame, done: DataFrame, slack: int = 1) -> DataFrame:
    """Files of the manifest that are not there with their size, give or take ``slack`` bytes."""
    have = done.select(F.col("path").alias("_p"), F.col("size").alias("_s"))
    return manifest.join(have, (F.col("path") == F.col("_p")) & (F.abs(F.col("size") - F.col("_s")) <= slack), "left_anti")


def pairwise_agreement(rows: DataFrame, item: list[str], annotator: str, label: str) -> DataFrame:
    """``a, b, n, agreement`` of every two annotators on the items both judged."""
    x = rows.select(*item, F.col(annotator).alias("a"), F.col(label).alias("_x"))
    y = rows.select(*item, F.col(annotator).alias("b"), F.col(label).alias("_y"))
    return x.join(y, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("_x") == F.col("_y")).cast("double")).alias("agreement"))


def dense_reindex(df: DataFrame, keys: list[str], pos: str, sizes: DataFrame, size: str, cols: list[str]) -> DataFrame:
    """Every position 0..size-1 of each sequence; what is absent is 0."""
    grid = sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1)).alias(pos)).hint("merge")
    return grid.join(df.select(*keys, pos, *cols), [*keys, pos], "left").select(*keys, pos, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


FAN = 16_384  # keys, or digests, that one digest is made of


def fingerprint(df: DataFrame, keys: list[str], by: list[str] | None = None, digits: int = 10, fan: int = FAN) -> DataFrame:
    """``fingerprint``: first hex digits of a tree of md5 digests over all keys in key order.

    A row's keys are joined by dots; every ``fan`` rows, joined by a pipe, give a digest, and so do every
    ``fan`` digests, level by level until one is left. Up to ``fan`` rows this is the md5 of all of
    them. With ``by``, each group has such a digest first and the tree is built over those, in the order of
    the groups. Rows are numbered by prefix sums over range partitions, so no task has more than
    a part of them. Null keys are left out of a row's text; without rows it is the md5 of nothing.
    """
    text = F.concat_ws(".", *[F.col(k).cast("string") for k in keys])
    order = list(dict.fromkeys([*(by or []), *keys]))
    rows = df.select(*order, text.alias("_t"), F.lit(1).alias("_one"))
    total = rows.count()
    if not total:
        return df.sparkSession.range(1).select(F.substring(F.md5(F.lit("")), 1, digits).alias("fingerprint"))
    placed = global_prefix(rows, [*order, "_t"], "_one", "_i")
    if by:
        placed = placed.withColumn("_g", F.to_json(F.struct(*by)))
        facts = placed.groupBy("_g").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
        own = placed.join(facts.hint("merge"), "_g").select(F.col("_first").alias("_g"), (F.col("_i") - F.col("_first")).alias("_i"), "_n", "_t")
        groups = global_prefix(_digests(own, total, fan).withColumn("_one", F.lit(1)), ["_g"], "_one", "_i")
        total = facts.count()
        placed = groups
    one = _digests(placed.select(F.lit(0).alias("_g"), "_i", F.lit(total).alias("_n"), "_t"), total, fan)
    return one.select(F.substring("_t", 1, digits).alias("fingerprint"))


def _digests(rows: DataFrame, most: int, fan: int) -> DataFrame:
    """``_g, _t``: the digest of each group of ``rows(_g, _i, _n, _t)``, of at most ``most`` rows."""
    first = True
    while first or most > 1:
        each = F.array_sort(F.collect_list(F.struct("_i", "_t")))  # at most fan of them
        joined = F.md5(F.array_join(F.transform(each, lambda r: r["_t"]), "|"))
        digest = joined if first else F.when(F.max("_n") == 1, F.max("_t")).otherwise(joined)
        rows = rows.groupBy("_g", F.floor(F.col("_i") / fan).alias("_i")).agg(F.ceil(F.max("_n") / fan).alias("_m"), digest.alias("_d"))
        rows = rows.select("_g", "_i", F.col("_m").alias("_n"), F.col("_d").alias("_t"))
        most, first = -(-most // fan), False
    return rows.select("_g", "_t")
