"""Tests and models whose data pass is distributed: AUC, rank tests, logistic, mixed and ridge models."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions.tails import normal_p, student_p
from trajecta.operators.aggregates import average_ranks
from trajecta.operators.windows import global_prefix


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc, n_pos, n_neg``: exact, ties count a half.

    Rows are counted by score first, so equal scores (a skewed one too) meet in partial
    aggregates; negatives below each score come from a range-partitioned prefix sum.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(score).agg(F.sum((F.col(label) > 0).cast("long")).alias("_p"), F.sum((F.col(label) <= 0).cast("long")).alias("_q"))
    below = global_prefix(counts, [score], "_q", "_b")
    wins = F.sum(F.col("_p") * (F.col("_b") + F.col("_q") / 2.0))
    return below.agg(F.try_divide(wins, (F.sum("_p") * F.sum("_q")).cast("double")).alias("auc"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))


def slopes(df: DataFrame, by: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """``n, slope, beta`` by group: the slope, and it in standard deviations; groups with a constant column go."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    vx, vy, cov = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    out = ok.groupBy(*by).agg(F.count("*").alias("n"), vx.alias("_vx"), vy.alias("_vy"), cov.alias("_c")).where(f"n >= {least} and _vx > 0 and _vy > 0")
    return out.select(*by, "n", (F.col("_c") / F.col("_vx")).alias("slope"), (F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("beta"))


def t_test(df: DataFrame, value: str) -> DataFrame:
    """``n, mean, sd, t`` of one sample against zero."""
    sd = F.stddev_samp(value)
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.try_divide(F.avg(value), sd / F.sqrt(F.count(value).cast("double"))).alias("t"))


def signed_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n, w_plus, w_minus`` of the Wilcoxon signed-rank test; zeros go, ties share ranks."""
    rows = average_ranks(df.where(F.col(value) != 0).withColumn("_a", F.abs(value)), by, "_a", "_r")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("_r"))), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), part(F.col(value) > 0).alias("w_plus"), part(F.col(value) < 0).alias("w_minus"))


def logistic(df: DataFrame, label: str, cols: list[str], cluster: str | None = None) -> list[tuple]:
    """(term, beta, se, p) of a logistic regression; with ``cluster``, errors robust to its groups."""
    rows = VectorAssembler(inputCols=cols, outputCol="_x").transform(df.na.drop(subset=[label, *cols]))
    model = GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol=label, maxIter=50, tol=1e-10).fit(rows)
    terms, beta = ["intercept", *cols], [model.intercept, *model.coefficients]
    if cluster is None:
        se = model.summary.coefficientStandardErrors  # the intercept comes last
        se = [se[-1], *se[:-1]]
        return [(t, float(b), float(s), normal_p(b / s)) for t, b, s in zip(terms, beta, se, strict=True)]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    eta = sum((v * F.lit(float(b)) for v, b in zip(x[1:], beta[1:], strict=True)), F.lit(float(beta[0])))
    p = 1 / (1 + F.exp(-eta))
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    info = df.na.drop(subset=[label, *cols]).agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j] * p * (1 - p)).alias(f"_{i}_{j}") for i, j in pairs]).first()
    score = df.na.drop(subset=[label, *cols]).groupBy(cluster).agg(*[F.sum(v * (F.col(label) - p)).alias(f"_{i}") for i, v in enumerate(x)])
    outer = score.agg(F.count("*").alias("g"), *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"_{i}_{j}") for i, j in pairs]).first()
    bread, meat = np.zeros((len(x),) * 2), np.zeros((len(x),) * 2)
    for i, j in pairs:
        bread[i, j] = bread[j, i] = info[f"_{i}_{j}"]
        meat[i, j] = meat[j, i] = outer[f"_{i}_{j}"]
    inverse = np.linalg.inv(bread)
    cov = inverse @ meat @ inverse * outer["g"] / (outer["g"] - 1) * (info["n"] - 1) / (info["n"] - len(x))
    return [(t, float(b), float(s), normal_p(b / s)) for t, b, s in zip(terms, beta, np.sqrt(np.diag(cov)), strict=True)]


def mixed_model(df: DataFrame, subject: str, y: str, x: str, others: list[str] = (), moderator: str | None = None) -> list[tuple]:
    """(term, beta, se, p) of ``mixed_fit``; with a moderator, of y on x, it, and their product too."""
    extra = list(others)
    if moderator:
        df = df.withColumn(f"{x}:{moderator}", F.col(x).cast("double") * F.col(moderator).cast("double"))
        extra = [moderator, f"{x}:{moderator}", *extra]
    fit = mixed_fit(df, subject, y, x, extra)
    return [(t, float(b), float(s), normal_p(b / s)) for t, b, s in zip(fit.terms, fit.beta, fit.se, strict=True)]


@dataclass
class MixedFit:
    """Fixed effects, the covariance of the random intercept and slope, the residual variance, and -2 log REML (up to a constant)."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    random: np.ndarray
    residual: float
    criterion: float
    n: int
    subjects: int
    steps: int


def _subject_totals(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What the likelihood and its gradient need, summed over subjects, in a row.

    Z is the first two columns of X, D the covariance of the random effects over the residual variance, and
    V = I + Z D Z'. With A = Z'Z and W = D (I + A D)^-1, V^-1 = I - Z W Z'; no subject's rows are needed.
    """
    low = np.array([[theta[0], 0.0], [theta[1], theta[2]]])
    d = low @ low.T
    a, zx, zy = xx[:, :2, :2], xx[:, :2, :], xy[:, :2]
    inner = np.eye(2) + a @ d
    w = d @ np.linalg.inv(inner)
    t = a - a @ w @ a  # Z' V^-1 Z
    c = zx - a @ w @ zx  # Z' V^-1 X
    u = zy - np.einsum("sij,sj->si", a @ w, zy)  # Z' V^-1 y
    parts = [
        [np.linalg.slogdet(inner)[1].sum()], t.sum(0).ravel(), (xx - np.swapaxes(zx, 1, 2) @ w @ zx).sum(0).ravel(), (xy - np.einsum("sip,sij,sj->sp", zx, w, zy)).sum(0),
        [(yy - np.einsum("si,sij,sj->s", zy, w, zy)).sum()], np.einsum("si,sj->ij", u, u).ravel(), np.einsum("sip,sj->ijp", c, u).ravel(), np.einsum("sip,sjq->ijpq", c, c).ravel(),
    ]
    return np.concatenate(parts)


def _criterion(total: np.ndarray, n: int, p: int, theta: np.ndarray):
    """(criterion, its gradient, fixed effects, residual variance, X' V^-1 X) at ``theta``."""
    at = np.cumsum([1, 4, p * p, p, 1, 4, 4 * p, 4 * p * p])
    det, t, s, sy, q, uu, cu, cc = np.split(total, at[:-1])
    s, uu, cu, cc = s.reshape(p, p), uu.reshape(2, 2), cu.reshape(2, 2, p), cc.reshape(2, 2, p, p)
    beta = np.linalg.solve(s, sy)
    s2 = max((q[0] - beta @ sy) / (n - p), 1e-300)
    value = det[0] + np.linalg.slogdet(s)[1] + (n - p) * np.log(s2)
    rest = uu - cu @ beta - (cu @ beta).T + np.einsum("ijpq,p,q->ij", cc, beta, beta)  # of Z' V^-1 (y - X b)
    g = t.reshape(2, 2) - np.einsum("ijpq,qp->ij", cc, np.linalg.inv(s)) - rest / s2
    g11, g12, g22 = g[0, 0], g[0, 1] + g[1, 0], g[1, 1]
    a, b, c = theta
    return value, np.array([2 * a * g11 + b * g12, a * g12 + 2 * b * g22, 2 * c * g22]), beta, s2, s


def mixed_fit(df: DataFrame, subject: str, y: str, x: str, others: list[str] = (), tol: float = 1e-8, most: int = 40) -> MixedFit:
    """REML fit of y on x and others with a random intercept and slope of x by subject.

    One pass gives each subject's sums of products. The criterion, its gradient and, from four
    gradients, its curvature are sums over that table: a Newton step is one aggregate over the subjects for
    the point and its neighbours, and one for trial lengths of the step. The driver holds a few small
    matrices and no subject. Rows with a null are left out.
    """
    cols = [x, *others]
    rows = df.na.drop(subset=[subject, y, *cols])
    v, out = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]], F.col(y).cast("double")
    p = len(v)
    pairs = list(combinations_with_replacement(range(p), 2))
    sums = rows.groupBy(subject).agg(
        F.count("*").cast("double").alias("n"), F.sum(out * out).alias("yy"), *[F.sum(c * out).alias(f"y{i}") for i, c in enumerate(v)], *[F.sum(v[i] * v[j]).alias(f"x{i}_{j}") for i, j in pairs]
    ).persist()
    facts = sums.agg(F.sum("n"), F.count("*"), *[F.sum(f"x{i}_{i}") for i in range(p)], F.sum("yy")).first()
    n, subjects = int(facts[0] or 0), facts[1]
    unit = np.sqrt(np.array([float(f or 0.0) for f in facts[2 : 2 + p]]) / max(n, 1))  # columns are taken in these units
    unit[unit == 0] = 1.0

    def totals(thetas: list[np.ndarray]) -> list[np.ndarray]:
        def part(frames):
            import pandas as pd

            held = None
            for f in frames:
                if not len(f):
                    continue
                xx = np.zeros((len(f), p, p))
                for i, j in pairs:
                    xx[:, i, j] = xx[:, j, i] = f[f"x{i}_{j}"] / (unit[i] * unit[j])
                xy = f[[f"y{i}" for i in range(p)]].to_numpy() / unit
                own = np.array([_subject_totals(f["n"].to_numpy(), xx, xy, f["yy"].to_numpy(), t) for t in thetas])
                held = own if held is None else held + own
            if held is not None:
                yield pd.DataFrame({"k": np.repeat(np.arange(len(thetas)), held.shape[1]), "i": np.tile(np.arange(held.shape[1]), len(thetas)), "v": held.ravel()})

        got = sums.mapInPandas(part, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # a few numbers for each point
        table = np.zeros((len(thetas), 2 + 8 + p * p + p + 4 * p + 4 * p * p))
        for r in got:
            table[r["k"], r["i"]] = r["v"]
        return [_criterion(t, n, p, theta) for t, theta in zip(table, thetas, strict=True)]

    theta, h, steps = np.array([0.5, 0.0, 0.5]), 1e-5, 0
    best = None
    for steps in range(1, most + 1):
        around = totals([theta, *[theta + h * e for e in np.eye(3)]])
        best = around[0]
        curve = np.array([(f[1] - best[1]) / h for f in around[1:]])
        size, axes = np.linalg.eigh((curve + curve.T) / 2)
        step = -axes @ ((axes.T @ best[1]) / np.maximum(np.abs(size), 1e-6 * max(1.0, np.abs(size).max())))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        trials = [theta + step * f for f in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)]
        tried = totals(trials)
        low = int(np.argmin([f[0] for f in tried]))
        if tried[low][0] < best[0]:
            moved, gained = np.abs(trials[low] - theta).max(), best[0] - tried[low][0]
            theta, best = trials[low], tried[low]
            if moved < tol or gained < 1e-12 * abs(best[0]):
                break
        else:
            break
    sums.unpersist()
    value, _, beta, s2, s = best
    low = np.array([[theta[0], 0.0], [theta[1], theta[2]]])
    random = low @ low.T * s2 / np.outer(unit[:2], unit[:2])
    return MixedFit(["intercept", *cols], beta / unit, np.sqrt(np.diag(np.linalg.inv(s)) * s2) / unit, random, float(s2), float(value + 2 * np.log(unit).sum()), n, subjects, steps)


def cv_ridge(df: DataFrame, by: str, fold: str, cols: list[str], y: str, alpha: float = 1e3) -> DataFrame:
    """``by, r``: correlation of held-out predictions of ridge regressions with the outcome, by channel.

    One pass gives the sums of products of each (channel, fold); training sums are the total
    less the fold's own, and a second pass predicts. The intercept is not penalised. Weights
    are a row for each channel and fold and are joined by key.
    """
    x = [F.col(c).cast("double") for c in cols]
    rows = df.na.drop(subset=[y, *cols])
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    sums = rows.groupBy(by, fold).agg(
        F.count("*").alias("n"), F.sum(F.col(y)).alias("sy"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(v * F.col(y)).alias(f"y{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs]
    )
    kinds = dict(df.dtypes)

    def solve(g):
        import pandas as pd

        k, total = len(cols), g.sum(numeric_only=True)
        out = []
        for _, own in g.iterrows():
            t = {c: total[c] - own[c] for c in g.columns if c not in (by, fold)}
            n = max(t["n"], 1)
            s = np.array([t[f"s{i}"] for i in range(k)])
            xx = np.zeros((k, k))
            for i, j in pairs:
                xx[i, j] = xx[j, i] = t[f"x{i}_{j}"]
            w = np.linalg.solve(xx - np.outer(s, s) / n + alpha * np.eye(k), np.array([t[f"y{i}"] for i in range(k)]) - s * t["sy"] / n)
            out.append((own[by], own[fold], w.tolist(), float(t["sy"] / n - w @ s / n)))
        return pd.DataFrame(out, columns=[by, fold, "_w", "_b"])

    weights = sums.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, {fold} {kinds[fold]}, _w array<double>, _b double")
    guess = F.col("_b")
    for i, v in enumerate(x):
        guess = guess + v * F.col("_w")[i]
    pred = rows.join(weights.hint("shuffle_hash"), [by, fold]).withColumn("_g", guess)
    sd = F.stddev_pop("_g") * F.stddev_pop(y)
    return pred.groupBy(by).agg(F.when(sd > 0, F.try_divide(F.covar_pop("_g", y), sd)).alias("r"))


def unique_contribution(df: DataFrame, by: str, fold: str, cols: list[str], y: str, without: list[str], alpha: float = 1e3) -> DataFrame:
    """``r_full, r_rest, unique`` by channel: what ``without`` adds to the held-out correlation."""
    full = cv_ridge(df, by, fold, cols, y, alpha).withColumnRenamed("r", "r_full")
    rest = cv_ridge(df, by, fold, [c for c in cols if c not in without], y, alpha).withColumnRenamed("r", "r_rest")
    return full.join(rest.hint("merge"), by).withColumn("unique", F.col("r_full") - F.col("r_rest"))


def with_p(rows: list[tuple], df: int) -> list[tuple]:
    return [(*r, student_p(r[-1], df)) for r in rows]
