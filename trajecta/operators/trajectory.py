"""Measures of a trajectory: how an ordered sequence of vectors departs from where it was heading.

All take a frame with sequence keys, an order column and an ``array<double>`` column, and
share one window specification, so several measures cost one exchange and one sort. For
sequences too long for a task, ``halo_blocks`` cuts them first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajecta.functions import vectors as V


def along(keys: list[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(pos)


def lagged(df: DataFrame, keys: list[str], pos: str, col: str, k: int, prefix: str = "_l") -> DataFrame:
    """Adds ``_l1`` .. ``_lk``, the values 1 to k rows earlier."""
    w = along(keys, pos)
    return df.select("*", *[F.lag(col, i).over(w).alias(f"{prefix}{i}") for i in range(1, k + 1)])


def halo_blocks(df: DataFrame, keys: list[str], pos: str, k: int, size: int = 4096) -> DataFrame:
    """Cuts sequences with dense positions into blocks of ``size`` that begin with the k rows before them.

    Adds ``block`` and ``halo`` (true for the repeated rows, to be dropped after the measure):
    with ``keys + ["block"]`` as keys, windows of up to k rows give what they give uncut.
    """
    size = max(size, k)  # a halo comes from one block
    own = F.floor(F.col(pos) / size)
    last = F.col(pos) % size >= size - k
    copies = F.when(last, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")), F.struct((own + 1).alias("block"), F.lit(True).alias("halo"))))
    copies = F.coalesce(copies, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return df.select("*", F.inline(copies))


def _previous(k: int) -> list[Column]:
    return [F.col(f"_l{i}") for i in range(k, 0, -1)]


def predicted(k: int, degree: int = 1) -> Column:
    """Extrapolation from the lag columns, by fixed weights: no solver is needed."""
    return V.v_combine(_previous(k), V.extrapolation_weights(k, degree))


def extrapolation_error(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 3, degree: int = 1, out: str = "error") -> DataFrame:
    """Distance of each vector from the extrapolation of the k before it; null for the first k."""
    rows = lagged(df, keys, pos, vec, k).withColumn("_p", predicted(k, degree))
    return rows.withColumn(out, V.v_norm(V.v_sub(F.col(vec), F.col("_p")))).drop("_p", *[f"_l{i}" for i in range(1, k + 1)])


def frame_error(df: DataFrame, keys: list[str], pos: str, vec: str, k: int, out: str = "error") -> DataFrame:
    """As ``extrapolation_error`` of degree 1 for long histories: one frame instead of k lag columns."""
    frame = along(keys, pos).rowsBetween(-k, -1)
    weights = F.array(*[F.lit(w) for w in V.extrapolation_weights(k)])
    rows = df.withColumn("_h", F.collect_list(vec).over(frame)).withColumn("_w", weights)
    point = lambda i: F.aggregate(F.zip_with("_h", "_w", lambda v, w: F.get(v, i) * w), F.lit(0.0), lambda s, x: s + x)
    miss = F.transform(F.sequence(F.lit(0), F.size(vec) - 1), lambda i: F.get(F.col(vec), i) - point(i))
    return rows.withColumn(out, F.when(F.size("_h") == k, V.v_norm(miss))).drop("_h", "_w")


def decompose_residual(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 3) -> DataFrame:
    """``error`` with its part ``along`` the fitted slope (signed) and ``lateral`` to it; null parts for a zero slope."""
    rows = lagged(df, keys, pos, vec, k)
    rows = rows.withColumn("_r", V.v_sub(F.col(vec), predicted(k))).withColumn("_b", V.v_combine(_previous(k), V.slope_weights(k)))
    rows = rows.withColumn("_u", V.v_unit(F.col("_b"))).withColumn("along", V.v_dot(F.col("_r"), F.col("_u")))
    lateral = V.v_norm(F.zip_with("_r", "_u", lambda r, u: r - F.col("along") * u))
    return rows.withColumn("error", V.v_norm(F.col("_r"))).withColumn("lateral", lateral).drop("_r", "_b", "_u", *[f"_l{i}" for i in range(1, k + 1)])


def step_angle(df: DataFrame, keys: list[str], pos: str, vec: str, out: str = "angle", eps: float = 1e-8) -> DataFrame:
    """Angle between the step to a row and the step before it."""
    rows = lagged(df, keys, pos, vec, 2)
    rows = rows.withColumn("_s1", V.v_sub(F.col(vec), F.col("_l1"))).withColumn("_s2", V.v_sub(F.col("_l1"), F.col("_l2")))
    return rows.withColumn(out, V.v_angle(F.col("_s1"), F.col("_s2"), eps)).drop("_s1", "_s2", "_l1", "_l2")


def curvature(df: DataFrame, keys: list[str], pos: str, vec: str, n: int = 3, out: str = "curvature") -> DataFrame:
    """Mean of the last n step angles; null if one is missing."""
    rows, w = step_angle(df, keys, pos, vec, "_a"), along(keys, pos)
    total = F.col("_a")
    for i in range(1, n):
        total = total + F.lag("_a", i).over(w)
    return rows.withColumn(out, total / n).drop("_a")


def scaled_error(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 3) -> DataFrame:
    """``error`` and ``scaled``, the error over the mean length of the k - 1 steps between the k vectors before."""
    rows = extrapolation_error(df, keys, pos, vec, k)
    rows = lagged(rows, keys, pos, vec, 1).withColumn("_s", V.v_norm(V.v_sub(F.col(vec), F.col("_l1"))))
    mean = F.avg("_s").over(along(keys, pos).rowsBetween(-(k - 1), -1))
    return rows.withColumn("scaled", F.try_divide("error", mean)).drop("_l1", "_s")


def heading_error(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 3) -> DataFrame:
    """``heading_error``: angle of a step to the extrapolation of the k unit steps before it."""
    rows = lagged(df, keys, pos, vec, 1).withColumn("_u", V.v_unit(V.v_sub(F.col(vec), F.col("_l1")))).drop("_l1")
    rows = lagged(rows, keys, pos, "_u", k)
    return rows.withColumn("heading_error", V.v_angle(F.col("_u"), predicted(k))).drop("_u", *[f"_l{i}" for i in range(1, k + 1)])


def pace_error(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 3) -> DataFrame:
    """``pace_error``: step length against the extrapolation of the k step lengths before it."""
    rows = lagged(df, keys, pos, vec, 1).withColumn("_s", V.v_norm(V.v_sub(F.col(vec), F.col("_l1")))).drop("_l1")
    return scalar_error(rows, keys, pos, "_s", k, 1, "pace_error").drop("_s")


def scalar_error(df: DataFrame, keys: list[str], pos: str, col: str, k: int = 3, degree: int = 1, out: str = "error") -> DataFrame:
    """The extrapolation error of a one-dimensional trajectory."""
    w, guess = along(keys, pos), F.lit(0.0)
    for i, x in enumerate(V.extrapolation_weights(k, degree)):
        guess = guess + F.lag(col, k - i).over(w) * F.lit(x)
    return df.withColumn(out, F.abs(F.col(col) - guess))


def trailing_mean(df: DataFrame, keys: list[str], pos: str, vec: str, m: int, out: str = "smooth") -> DataFrame:
    """Element-wise mean of a row and the m - 1 before it; the first rows average what there is."""
    rows = df.withColumn("_h", F.collect_list(vec).over(along(keys, pos).rowsBetween(-(m - 1), 0)))
    point = lambda i: F.aggregate("_h", F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.size("_h")
    return rows.withColumn(out, F.transform(F.sequence(F.lit(0), F.size(vec) - 1), point)).drop("_h")


def smoothed_error(df: DataFrame, keys: list[str], pos: str, vec: str, m: int, k: int = 3, out: str = "error") -> DataFrame:
    return extrapolation_error(trailing_mean(df, keys, pos, vec, m, "_m"), keys, pos, "_m", k, 1, out).drop("_m")


def cosine_shift(df: DataFrame, keys: list[str], pos: str, vec: str, out: str = "shift", adjacent: bool = False) -> DataFrame:
    """One minus the cosine to the previous row (its denominator raised by 1e-12).

    With ``adjacent``, rows whose previous position is not one less get null.
    """
    rows = lagged(df, keys, pos, vec, 1)
    shift = 1 - V.v_cos(F.col(vec), F.col("_l1"), 1e-12)
    if adjacent:
        shift = F.when(F.col(pos) - F.lag(pos).over(along(keys, pos)) == 1, shift)
    return rows.withColumn(out, shift).drop("_l1")


def centroid_by(df: DataFrame, by: list[str], vec: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean vector of each group, by partial aggregates of (group, dimension)."""
    long = df.select(*by, F.posexplode(vec).alias("_d", "_x"))
    mean = long.groupBy(*by, "_d").agg(F.avg("_x").alias("_m"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda p: p["_m"]).alias(out))


def _block_measure(df: DataFrame, keys: list[str], pos: str, vec: str, history: int, names: list[str], measure, block: int) -> DataFrame:
    """Runs ``measure(matrix, row) -> values`` for rows with ``history`` predecessors, in halo blocks."""
    rows = halo_blocks(df.select(*keys, pos, vec), keys, pos, history, block)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(pos)
        x = np.array(g[vec].tolist(), dtype=float)
        out = np.full((len(g), len(names)), np.nan)
        for i in range(history, len(g)):
            if not g["halo"].iloc[i]:
                out[i] = measure(x, i)
        keep = ~g["halo"].to_numpy()
        res = g.loc[keep, [*keys, pos]].copy()
        for j, n in enumerate(names):
            v = out[keep, j]
            res[n] = [None if np.isnan(y) else float(y) for y in v]
        return res

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, pos]), *(f"{n} double" for n in names)])
    return rows.groupBy(*keys, "block").applyInPandas(run, schema)


def local_dynamics_error(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 10, d: int = 6, ridge: float = 1e-2, block: int = 512) -> DataFrame:
    """``dynamics_error``: miss of a one-step ridge map fitted on the last k vectors in their d local axes.

    The axes come from the k x k Gram matrix, so the cost does not depend on the square of the width.
    """
    def measure(x: np.ndarray, i: int) -> tuple[float]:
        h = x[i - k : i]
        mean = h.mean(axis=0)
        z = h - mean
        value, left = np.linalg.eigh(z @ z.T)
        value, left = value[::-1][:d], left[:, ::-1][:, :d]
        left = left[:, value > 1e-12 * max(value[0], 1e-300)]
        axes = z.T @ left
        axes /= np.maximum(np.linalg.norm(axes, axis=0), 1e-300)
        y = z @ axes
        a, b = y[:-1], y[1:]
        step = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
        return (float(np.linalg.norm(x[i] - (mean + axes @ (y[-1] @ step)))),)

    return _block_measure(df, keys, pos, vec, k, ["dynamics_error"], measure, block)


def subspace_split(df: DataFrame, keys: list[str], pos: str, vec: str, k: int = 3, window: int = 20, d: int = 10, block: int = 512) -> DataFrame:
    """``inside`` and ``outside``: the extrapolation residual in and out of the main axes of the last ``window`` vectors."""
    weights = np.array(V.extrapolation_weights(k))

    def measure(x: np.ndarray, i: int) -> tuple[float, float]:
        r = x[i] - weights @ x[i - k : i]
        z = x[i - window : i] - x[i - window : i].mean(axis=0)
        value, left = np.linalg.eigh(z @ z.T)
        keep = value[::-1][:d] > 1e-12 * max(value[-1], 1e-300)
        axes = z.T @ left[:, ::-1][:, :d][:, keep]
        axes /= np.maximum(np.linalg.norm(axes, axis=0), 1e-300)
        part = axes.T @ r
        return float(np.linalg.norm(part)), float(np.sqrt(max(r @ r - part @ part, 0.0)))

    return _block_measure(df, keys, pos, vec, max(k, window), ["inside", "outside"], measure, block)
