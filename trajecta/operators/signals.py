"""Sampled signals in long form: (keys, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.aggregates import zscore


def impulses(onsets: DataFrame, keys: list[str], start: str, value: str, order: str, fs: float, lengths: DataFrame, length: str) -> DataFrame:
    """``keys, t, value`` on the whole grid: each onset at round(start * fs), half to even; the last of a sample wins, others are 0."""
    t = F.bround(F.col(start) * F.lit(float(fs)), 0).cast("long")
    hits = onsets.withColumn("t", t).join(lengths, keys).where(f"t >= 0 and t < {length}").groupBy(*keys, "t").agg(F.max_by(value, order).alias("value"))
    grid = lengths.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1)).alias("t")).hint("merge")
    return grid.join(hits, [*keys, "t"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def resample_index(signal: DataFrame, keys: list[str], lengths: DataFrame, length: str, fs_in: float, fs_out: float) -> DataFrame:
    """``keys, t, value`` at another rate: the sample at floor(t * fs_in / fs_out), clipped to the end."""
    n = F.floor(F.col(length) * F.lit(fs_out / fs_in)).cast("long")
    src = F.least(F.floor(F.col("t") * F.lit(fs_in / fs_out)).cast("long"), F.col(length).cast("long") - 1)
    grid = lengths.where(n > 0).select(*keys, length, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("t")).withColumn("_s", src).drop(length).hint("merge")
    own = signal.select(*keys, F.col("t").alias("_s"), "value")
    return grid.join(own, [*keys, "_s"]).select(*keys, "t", "value")


def lag_matrix(signal: DataFrame, keys: list[str], lengths: DataFrame, length: str, lags: list[int], edge: str = "null", block: int = 65_536) -> DataFrame:
    """Adds ``lag_<l>`` (``lag_m<l>`` for a negative l), the value l samples earlier; at an edge null, zero or wrapped around.

    Each row is read once: windows look up the sample at a distance, within blocks of ``block``
    samples that start and end with the few rows of their neighbours that lags reach, so a long channel is
    many tasks. Samples may be missing; what is not there is null (or zero).
    """
    if edge not in ("null", "zero", "wrap"):
        raise ValueError(edge)
    back, ahead = max(0, *lags, 0), max(0, *[-i for i in lags], 0)
    if back + ahead > block:
        raise ValueError("lags reach beyond a block")
    base = signal.select(*keys, "t", "value").join(lengths.select(*keys, F.col(length).alias("_n")).hint("merge"), keys)
    rows = base.withColumn("_own", F.lit(True))
    if edge == "wrap":  # ends are told again beyond the other end, as often as lags go round
        times = F.sequence(F.lit(1), F.ceil(F.lit(max(back, ahead, 1)) / F.greatest("_n", F.lit(1))).cast("int"))
        turns = F.explode(F.concat(times, F.transform(times, lambda k: -k)))
        beyond = base.withColumn("_k", turns).withColumn("t", F.col("t") + F.col("_k") * F.col("_n")).drop("_k")
        rows = rows.unionByName(beyond.where((F.col("t") >= -back) & (F.col("t") < F.col("_n") + ahead)).withColumn("_own", F.lit(False)))
    first, last = F.floor((F.col("t") - ahead) / block), F.floor((F.col("t") + back) / block)
    rows = rows.withColumn("_b", F.explode(F.sequence(first, last)))  # one block, or two for the rows at its borders
    at = Window.partitionBy(*keys, "_b").orderBy("t")
    value = [F.max("value").over(at.rangeBetween(-i, -i)) for i in lags]
    names = [f"lag_{i}".replace("-", "m") for i in lags]
    out = rows.select(*keys, "t", "value", *[v.alias(n) for v, n in zip(value, names, strict=True)], "_own", "_b").where(F.col("_own") & (F.col("_b") == F.floor(F.col("t") / block)))
    out = out.select(*keys, "t", "value", *names)
    return out.fillna(0.0, subset=names) if edge == "zero" else out


def channel_z(signal: DataFrame, channel: list[str], value: str = "value") -> DataFrame:
    """Standardised by channel, with 1e-9 added to the deviation."""
    return zscore(signal, [value], channel, 0, 0.0, 1e-9)
