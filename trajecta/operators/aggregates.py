"""Aggregations that summarise items, sentences and sequences."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.windows import global_prefix


def zscore(df: DataFrame, cols: list[str], by: list[str] | None = None, ddof: int = 0, zero_sd: float | None = 0.0, eps: float = 0.0) -> DataFrame:
    """Standardised columns ``<col>_z``.

    ``ddof`` 0 or 1 chooses the deviation; with a zero deviation the result is ``zero_sd``;
    ``eps`` is added to the deviation. Without ``by``, one aggregate row meets every row.
    """
    sd = F.stddev_samp if ddof else F.stddev_pop
    stats = [f(c).alias(f"_{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", sd))]
    if by:
        table = df.groupBy(*by).agg(*stats)
        same = [df[k].eqNullSafe(table[k]) for k in by]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        joined = df.join(table.hint("shuffle_hash"), cond).drop(*[table[k] for k in by])
    else:
        joined = df.crossJoin(F.broadcast(df.agg(*stats)))  # one row
    z = lambda i, c: F.when(F.col(f"_s{i}") + eps > 0, (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") + eps > 0, F.col(f"_s{i}") + eps)).when(F.col(c).isNotNull(), F.lit(zero_sd))
    return joined.select(*df.columns, *[z(i, c).alias(f"{c}_z") for i, c in enumerate(cols)])


def first_last(df: DataFrame, by: list[str], order, cols: list[str]) -> DataFrame:
    """``<col>_first`` and ``<col>_last`` by order in each group."""
    return df.groupBy(*by).agg(*[f(c, order).alias(f"{c}_{n}") for c in cols for n, f in (("first", F.min_by), ("last", F.max_by))])


def roll_up_info(df: DataFrame, by: list[str], order: str, surprisal: str, entropy: str, at: str = "last", missing: str = "skip") -> DataFrame:
    """Surprisal summed over a word's parts (``missing``: skip or propagate nulls), entropy of its first or last part."""
    total = F.sum(surprisal)
    if missing == "propagate":
        total = F.when(F.count(surprisal) == F.count(F.lit(1)), total)
    return df.groupBy(*by).agg(total.alias("surprisal"), (F.max_by if at == "last" else F.min_by)(entropy, order).alias("entropy"))


def reassemble(df: DataFrame, by: list[str], order: str, text: str, sep: str = " ", out: str = "text") -> DataFrame:
    """The text of each group in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda s: s["t"]), sep).alias(out))


def log_freq(words: DataFrame, word: str) -> DataFrame:
    """``word, n, zipf``: log10 of the word's count in a billion words."""
    total = words.agg(F.count(word).alias("_n"))
    counts = words.where(F.col(word).isNotNull()).groupBy(word).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(word, "n", F.log10(F.col("n") / F.col("_n") * 1e9).alias("zipf"))  # one row


def with_log_freq(words: DataFrame, word: str, out: str = "zipf", empty: str = "the", most: int = 32 << 20) -> DataFrame:
    """``words`` with each word's ``log_freq``; an empty word has that of ``empty``, or 0 where no row has that.

    A null word has null. The dictionary's size is measured, by powers of two of the counts: the most frequent words
    that have up to ``most`` bytes together are broadcast, and only rows of rarer ones are dealt by word.
    """
    counts = log_freq(words.where(F.col(word) != ""), word).select(F.col(word).alias("_w"), "n", F.col("zipf").alias(out)).persist()
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.sum(F.octet_length("_w") + 24).alias("size")).orderBy(F.desc("level")).collect()  # at most 64
    level, size = 64, 0
    for r in sizes:
        size += r["size"]
        if size > most:
            break
        level = r["level"]
    frequent = F.floor(F.log2("n")) >= level
    keyed = words.withColumn("_k", F.when(F.col(word) == "", F.lit(empty)).otherwise(F.col(word)))
    if size <= most:
        joined = keyed.join(F.broadcast(counts.drop("n")), F.col("_k") == F.col("_w"), "left")  # of a measured size
    else:
        hot, rest = counts.where(frequent).drop("n"), counts.where(~frequent).drop("n")
        some = keyed.join(F.broadcast(hot), F.col("_k") == F.col("_w"))  # of a measured size
        others = keyed.join(F.broadcast(hot.select("_w")), F.col("_k") == F.col("_w"), "left_anti")
        joined = some.unionByName(others.join(rest.hint("merge"), F.col("_k") == F.col("_w"), "left"))
    return joined.withColumn(out, F.when(F.col(word) == "", F.coalesce(out, F.lit(0.0))).otherwise(F.col(out))).drop("_k", "_w")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``x, y, r, n`` of all pairs in one pass; null for a constant column."""
    def r(a: str, b: str) -> Column:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
        n, vx, vy = F.count(x), F.var_pop(x), F.var_pop(y)
        value = F.when((vx > 0) & (vy > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value.alias("r"), n.alias("n"))

    return df.agg(F.array(*[r(a, b) for a, b in combinations(cols, 2)]).alias("_r")).select(F.inline("_r"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """``q``: the exact quantiles (linear between neighbours) of all rows or of each group, as an array; nulls are left out.

    Values are counted, and ranked by prefix sums over range partitions; two rows a quantile are read
    there, so no task holds all values. A group without values has no row.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = global_prefix(counts, [*by, "_v"], "_c", "_before")
    ranked = ranked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_v", "_c", "_before")
    sizes = ranked.groupBy(*[f"_k{i}" for i in range(len(by))]).agg(F.sum("_c").alias("_n"), F.min("_before").alias("_first"))
    keys = [f"_k{i}" for i in range(len(by))]
    if by:
        same = F.lit(True)
        sizes = sizes.select(*[F.col(k).alias(f"{k}s") for k in keys], "_n", "_first")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
        rows = ranked.join(sizes.hint("shuffle_hash"), same)
    else:
        rows = ranked.crossJoin(F.broadcast(sizes))  # one row
    lo, hi = F.col("_before") - F.col("_first"), F.col("_before") - F.col("_first") + F.col("_c")

    def at(share: float) -> Column:
        spot = share * (F.col("_n") - 1)
        low, high = (F.max(F.when((lo <= x) & (x < hi), F.col("_v"))) for x in (F.floor(spot), F.ceil(spot)))
        part = F.max(spot - F.floor(spot))
        return low + part * (high - low)

    return rows.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, by, strict=True)]).agg(F.array(*[at(x) for x in shares]).alias("q"))


def decile_contrast(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Rate of the flag at or below the first decile and at or above the last, by exact quantiles."""
    cuts = quantiles(df, value, [0.1, 0.9])
    rate = lambda c: F.avg(F.when(c, F.col(flag).cast("double")))
    return df.crossJoin(F.broadcast(cuts)).agg(rate(F.col(value) <= F.col("q")[0]).alias("bottom"), rate(F.col(value) >= F.col("q")[1]).alias("top"))  # one row


def median_split(df: DataFrame, value: str, out: str) -> DataFrame:
    """Whether a value lies above the exact median."""
    cut = quantiles(df, value, [0.5]).select(F.col("q")[0].alias("_m"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.col(value) > F.col("_m")).drop("_m")  # one row


def top_n(df: DataFrame, n: int, value: str, tie: list[str], largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(value) if largest else F.asc(value), *tie).limit(n)


def first_appearance(df: DataFrame, group: str, order: str) -> DataFrame:
    """Groups in the order in which they first appear."""
    return df.groupBy(group).agg(F.min(order).alias("first")).orderBy("first")


def average_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks in each group; ties share the mean of their ranks."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0)
