"""Models of many subjects at once, and tests across subjects.

Each subject's sums of products come from one grouped pass; the small systems are solved in
executors, a batch of subjects at a time, so that no subject reaches the driver. Tests across
subjects count equal values first and rank them by prefix sums over range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trajecta.functions.tails import signed_rank_normal, signed_rank_tail, signed_rank_ways, student_p
from trajecta.operators.windows import global_prefix
from trajecta.plans.gram import _sums, listwise

EXACT = 50  # up to so many differences, the signed-rank test uses the exact null distribution


def _batched(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """n and the matrices of sums of products around each group's means."""
    n = frame["_n"].to_numpy(dtype=float)
    s = frame[[f"_s{i}" for i in range(k)]].to_numpy(dtype=float)
    p = np.zeros((len(frame), k, k))
    for i in range(k):
        for j in range(i, k):
            p[:, i, j] = p[:, j, i] = frame[f"_p{i}_{j}"].to_numpy(dtype=float)
    flat = np.diagonal(p, axis1=1, axis2=2) * 1e-12  # what rounding leaves of a constant column
    p = p - s[:, :, None] * s[:, None, :] / n[:, None, None]
    for i in range(k):
        p[p[:, i, i] <= flat[:, i], i, :] = 0.0
        p[:, :, i] = np.where(p[:, i, i, None] > 0, p[:, :, i], 0.0)
    return n, p


def subject_betas(df: DataFrame, by: list[str], y: str, xs: list[str], least: int = 50) -> DataFrame:
    """Standardised multiple regressions of ``y`` on ``xs``, one for each group of ``by``.

    Returns ``by, n, used, r2`` and for each x ``beta_<x>`` (in standard deviations of the group),
    ``se_<x>`` and ``slope_<x>`` (in the columns' units). Rows with a null in y or an x are left
    out. A column that is constant in a group is dropped there (null results, ``used`` counts the
    others); a group goes if it has fewer than ``least`` rows, a constant y, or a constant first x,
    which is the one in question. Collinear columns share by least norm.
    """
    cols = [*xs, y]
    rows = listwise(df, cols)
    means = rows.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()  # a number for each column
    rows = rows.select(*by, *[(F.col(c).cast("double") - F.lit(float(m or 0.0))).alias(c) for c, m in zip(cols, means, strict=True)])
    sums, k = rows.groupBy(*by).agg(*_sums(cols)).where(F.col("_n") >= least), len(xs)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, p = _batched(f, k + 1)
            f, n, p = (x[(p[:, 0, 0] > 0) & (p[:, k, k] > 0)] for x in (f, n, p))
            sd = np.sqrt(np.diagonal(p, axis1=1, axis2=2))
            r = p / np.where(sd > 0, sd, 1.0)[:, :, None] / np.where(sd > 0, sd, 1.0)[:, None, :]
            there = sd[:, :k] > 0
            inverse = np.linalg.pinv(r[:, :k, :k], rcond=1e-10, hermitian=True)
            beta = np.einsum("gij,gj->gi", inverse, r[:, :k, k])
            r2 = np.clip(np.einsum("gi,gi->g", beta, r[:, :k, k]), 0, 1)
            df_ = n - there.sum(1) - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.sqrt(np.diagonal(inverse, axis1=1, axis2=2) * ((1 - r2) / np.where(df_ > 0, df_, np.nan))[:, None])
                slope = beta * sd[:, k :] / sd[:, :k]
            out = f[by].assign(n=n.astype(np.int64), used=there.sum(1), r2=r2)
            for i, x in enumerate(xs):
                for name, v in (("beta", beta), ("se", se), ("slope", slope)):
                    out[f"{name}_{x}"] = np.where(there[:, i], v[:, i], np.nan)
            yield out

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema.fields)
    found = sums.mapInPandas(solve, f"{keys}, n long, used int, r2 double, " + ", ".join(f"`{n}_{x}` double" for x in xs for n in ("beta", "se", "slope")))
    return found.select(*by, "n", "used", "r2", *[F.nanvl(F.col(f"{n}_{x}"), F.lit(None)).alias(f"{n}_{x}") for x in xs for n in ("beta", "se", "slope")])


def ridge_weights(df: DataFrame, by: list[str], y: str, xs: list[str], alpha: float = 1e3) -> DataFrame:
    """``by, term, weight``: ridge regressions of ``y`` on ``xs`` for each group, the intercept not penalised.

    ``term`` is the number of the x (from 0). One grouped pass, then small systems a batch of groups at a time.
    """
    cols = [*xs, y]
    sums, k = listwise(df, cols).groupBy(*by).agg(*_sums(cols)), len(xs)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            _, p = _batched(f, k + 1)
            w = np.linalg.solve(p[:, :k, :k] + alpha * np.eye(k), p[:, :k, k:])[:, :, 0]
            out = f[by].loc[f.index.repeat(k)]
            yield out.assign(term=np.tile(np.arange(k), len(f)), weight=w.ravel())

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema.fields)
    return sums.mapInPandas(solve, f"{keys}, term int, weight double")


def weight_curves(weights: DataFrame, by: list[str]) -> DataFrame:
    """``by, term, weight, peak``: mean weights over channels (or subjects) by term; peak marks the largest by size, the first of equals."""
    curve = weights.groupBy(*by, "term").agg(F.avg("weight").alias("weight"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("weight")), "term")  # a row for each lag
    return curve.withColumn("peak", F.row_number().over(w) == 1)


def encoding_summary(scores: DataFrame, by: list[str], full: str = "r_full", unique: str = "unique") -> DataFrame:
    """Per subject: channels, mean unique contribution, share of channels above 0 and the best held-out correlation."""
    u = F.col(unique)
    return scores.groupBy(*by).agg(F.count(u).alias("channels"), F.avg(u).alias("mean_unique"), F.avg((u > 0).cast("double")).alias("share_positive"), F.max(full).alias("best_r"))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([student_p(a, b) if a == a and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


def t_test(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``n, mean, sd, positive, t, p`` of one sample (of each group) against zero; nulls are left out."""
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*(by or []))
    out = g.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.coalesce(F.sum((v > 0).cast("long")), F.lit(0)).alias("positive"))
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return out.withColumn("p", t_p("t", F.col("n") - 1))


@lru_cache(maxsize=256)
def _ways(ranks: tuple[int, ...]) -> np.ndarray:
    return signed_rank_ways(list(ranks))


def signed_rank_test(df: DataFrame, value: str, by: list[str] | None = None, alternative: str = "two-sided") -> DataFrame:
    """``n, w_plus, w_minus, p`` of the Wilcoxon signed-rank test (of each group).

    Zeros and nulls go, equal sizes share the mean of their ranks. Up to ``EXACT`` differences p is
    exact, given the ties: the distribution of the sum is built rank by rank. Beyond, it is normal
    with the variance corrected for ties. ``alternative`` is two-sided, greater (than zero) or less.
    For a paired test, give the differences.
    """
    by, v = by or [], F.col(value)
    counts = df.where(v.isNotNull() & (v != 0) & ~F.isnan(v.cast("double"))).groupBy(*by, F.abs(v).alias("_a")).agg(F.count("*").alias("_c"), F.sum((v > 0).cast("long")).alias("_up"))
    placed = global_prefix(counts, [*by, "_a"], "_c", "_before")
    first = placed.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_before").alias("_first"))
    keyed = placed.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(by)])
    placed = keyed.join(first.hint("shuffle_hash"), [f"_g{i}" for i in range(len(by))]) if by else placed.crossJoin(F.broadcast(first))  # one row
    at = F.col("_before") - F.col("_first")
    twice = 2 * at + F.col("_c") + 1  # twice the mean rank
    part = lambda c: F.coalesce(F.sum(twice * c), F.lit(0))
    few = F.collect_list(F.when(at < EXACT, F.struct(twice.alias("r"), F.col("_c").alias("c"))))  # at most EXACT entries, however many rows
    found = placed.groupBy(*by).agg(
        F.sum("_c").alias("n"), part(F.col("_up")).alias("_up2"), part(F.col("_c") - F.col("_up")).alias("_down2"), F.sum(F.pow("_c", F.lit(3.0)) - F.col("_c")).alias("_ties"), few.alias("_few")
    )

    @F.pandas_udf("double")
    def p(n: pd.Series, up: pd.Series, ties: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for a, w, t, ranks, times in zip(n, up, ties, r, c, strict=True):
            if a <= EXACT:
                each = sorted(int(x) for x, k in zip(ranks, times, strict=True) for _ in range(int(k)))
                out.append(signed_rank_tail(_ways(tuple(each)), int(w), alternative))
            else:
                out.append(signed_rank_normal(w / 2, a, t, alternative))
        return pd.Series(out, dtype="float64")

    small = F.when(F.col("n") <= EXACT, F.col("_few")).otherwise(F.array())
    found = found.withColumn("_few", small).where("n > 0")
    return found.select(*by, "n", (F.col("_up2") / 2).alias("w_plus"), (F.col("_down2") / 2).alias("w_minus"), p("n", "_up2", "_ties", "_few.r", "_few.c").alias("p"))


def paired_strata(df: DataFrame, by: list[str], hard: str | Column, y: str, xs: list[str], least: int = 40) -> DataFrame:
    """Each subject's first slope in two strata: ``by, easy, hard`` in standard deviations; null where a stratum has no fit.

    ``hard`` is a flag; rows without one are left out.
    """
    rows = df.withColumn("_hard", F.col(hard).cast("boolean") if isinstance(hard, str) else hard).where("_hard is not null")
    b = subject_betas(rows, [*by, "_hard"], y, xs, least)
    value = F.col(f"beta_{xs[0]}")
    return b.groupBy(*by).agg(F.max(F.when(~F.col("_hard"), value)).alias("easy"), F.max(F.when(F.col("_hard"), value)).alias("hard"))


def paired_test(pairs: DataFrame, a: str, b: str, alternative: str = "two-sided") -> DataFrame:
    """``n, mean_<a>, mean_<b>, w_plus, p``: the signed-rank test of b - a over the rows that have both.

    Without any difference p is null, as the test then has nothing to rank.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = both.agg(F.count("*").alias("n"), F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"))
    test = signed_rank_test(both.select((F.col(b) - F.col(a)).alias("_d")), "_d", alternative=alternative)
    one = test.agg(F.max("w_plus").alias("w_plus"), F.max("p").alias("p"))  # one row, also without a difference
    return means.crossJoin(F.broadcast(one))
