"""Ordered-window operators; all share one specification for each sequence key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def index_in(keys: list[str], order: list[str]) -> Column:
    """0-based index in the sequence."""
    return (F.row_number().over(_w(keys, order)) - 1).cast("long")


def lags(df: DataFrame, keys: list[str], order: list[str], cols: list[str], upto: int) -> DataFrame:
    """Adds ``<col>_lag1`` .. ``<col>_lagL``; null at the start of a sequence."""
    w = _w(keys, order)
    return df.select("*", *[F.lag(c, i).over(w).alias(f"{c}_lag{i}") for c in cols for i in range(1, upto + 1)])


def changed(col: str, keys: list[str], order: list[str], first: bool | None = True) -> Column:
    """Whether a value differs from the previous row's; ``first`` for the first row."""
    return F.coalesce(F.col(col) != F.lag(col).over(_w(keys, order)), F.lit(first).cast("boolean"))


def forward_sum(col: str, keys: list[str], order: list[str], n: int = 5) -> Column:
    """Sum over the next n rows; 0 where there are none."""
    return F.coalesce(F.sum(col).over(_w(keys, order).rowsBetween(1, n)), F.lit(0.0))


def offsets(length: Column, keys: list[str], order: list[str], gap: int = 1) -> Column:
    """Start of each item when items are joined with ``gap`` characters between them."""
    return F.coalesce(F.sum(length + gap).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def edge_terms(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``from_start, fs2, from_end, fe2``: distances to both ends of the sequence and their squares."""
    at, n = index_in(keys, order), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("from_start", at).withColumn("from_end", n - 1 - F.col("from_start"))
    return df.withColumn("fs2", F.col("from_start") * F.col("from_start")).withColumn("fe2", F.col("from_end") * F.col("from_end"))


def eligible(df: DataFrame, keys: list[str], order: list[str], before: int, after: int) -> DataFrame:
    """Rows with at least so many rows of their sequence before and after them."""
    df = edge_terms(df, keys, order)
    return df.where((F.col("from_start") >= before) & (F.col("from_end") >= after)).drop("from_start", "from_end", "fs2", "fe2")


def drop_first_group(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Without each sequence's first (smallest) group."""
    return df.withColumn("_f", F.min(group).over(Window.partitionBy(*keys))).where(F.col(group) != F.col("_f")).drop("_f")


def systematic_sample(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row in the global order of keys and order.

    Rows are numbered inside their sequence, and a sequence's offset is the prefix sum of the
    counts before it, so no window runs over all rows.
    """
    numbered = df.withColumn("_i", index_in(keys, order))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = global_prefix(counts, keys, "_n", "_before").select(*keys, "_before")
    joined = numbered.join(before.hint("shuffle_hash"), keys)
    return joined.withColumn("_g", F.col("_before") + F.col("_i")).where(F.col("_g") % step == 0).withColumn("rank", F.col("_g")).drop("_g", "_i", "_before")


def global_prefix(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows in ``order``, without a single-task window.

    Rows are range partitioned; each partition's total is small and a window over those totals
    gives what to add.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = dealt.persist()  # the two uses must see one dealing
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__total"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = totals.select("__part", F.coalesce(F.sum("__total").over(w), F.lit(0)).alias("__base"))
    rows = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(bases.hint("shuffle_hash"), "__part").withColumn(out, F.col(out) + F.col("__base")).drop("__part", "__base")


def first_write_wins(df: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """Of overlapping chunks, the value that the earliest chunk wrote for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), chunk).alias("_v")).select(*keys, "_v.*")


def make_chunks(sizes: DataFrame, size: str, length: int = 1024, stride: int = 512) -> DataFrame:
    """``chunk_start`` of each overlapping window over a sequence of ``size`` items."""
    last = F.greatest(F.lit(0), F.ceil((F.col(size) - length) / stride) * stride).cast("long")
    return sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))).alias("chunk_start"))
