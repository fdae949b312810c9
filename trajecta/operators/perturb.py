"""How a perturbation changes paired states, by lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions import vectors as V
from trajecta.operators.trajectory import trailing_mean


def perturbation(pairs: DataFrame, full: str, changed: str) -> DataFrame:
    """Adds ``l2``, ``relative`` (to the length of the full state) and ``cosine``."""
    a, b = F.col(full), F.col(changed)
    pairs = pairs.withColumn("l2", V.v_norm(V.v_sub(a, b)))
    return pairs.withColumn("relative", F.try_divide(F.col("l2"), V.v_norm(a))).withColumn("cosine", V.v_cos(a, b))


def coarse_perturbation(pairs: DataFrame, keys: list[str], lag: str, full: str, changed: str, m: int = 5) -> DataFrame:
    """Adds ``coarse``: the relative change of the mean of the last m downstream states."""
    rows = trailing_mean(trailing_mean(pairs, keys, lag, full, m, "_a"), keys, lag, changed, m, "_b")
    return rows.withColumn("coarse", F.try_divide(V.v_norm(V.v_sub(F.col("_a"), F.col("_b"))), V.v_norm(F.col("_a")))).drop("_a", "_b")
