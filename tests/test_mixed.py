"""The mixed model against a dense REML criterion that builds every subject's covariance."""

import numpy as np
import pytest

from trajecta.plans import inference as I


def made(seed, subjects=14, rows=18, slope_sd=0.7):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(subjects):
        x, m = rng.normal(3, 2, rows), rng.integers(0, 2, rows).astype(float)
        a, b = rng.normal(0, 1.5), rng.normal(0, slope_sd)
        y = 1 + a + (0.5 + b) * x + 0.8 * m + 0.3 * x * m + rng.normal(0, 1, rows)
        out += [(f"s{s}", float(p), float(q), float(t)) for p, q, t in zip(x, m, y, strict=True)]
    return [*out, ("s0", None, 1.0, 2.0)]


def dense(rows, random, residual):
    """(criterion, fixed effects, errors) for given variances; the criterion is least where REML is."""
    rows = [r for r in rows if None not in r]
    s, sy, det, q, n = 0, 0, 0.0, 0.0, len(rows)
    for who in {r[0] for r in rows}:
        x = np.array([[1, r[1], r[2], r[1] * r[2]] for r in rows if r[0] == who])
        y = np.array([r[3] for r in rows if r[0] == who])
        v = np.eye(len(y)) * residual + x[:, :2] @ random @ x[:, :2].T
        inverse = np.linalg.inv(v)
        s, sy, q, det = s + x.T @ inverse @ x, sy + x.T @ inverse @ y, q + y @ inverse @ y, det + np.linalg.slogdet(v)[1]
    beta = np.linalg.solve(s, sy)
    return det + np.linalg.slogdet(s)[1] + q - sy @ beta, beta, np.sqrt(np.diag(np.linalg.inv(s)))


def least(rows, start):
    """The variances with the least dense criterion, by a pattern search to 1e-7."""
    of = lambda t: dense(rows, (low := np.array([[t[0], 0], [t[1], t[2]]])) @ low.T, np.exp(t[3]))[0]
    t, step, value = np.array(start), 0.2, None
    value = of(t)
    while step > 1e-7:
        for d in np.vstack([np.eye(4), -np.eye(4)]) * step:
            if of(t + d) < value:
                t, value = t + d, of(t + d)
                break
        else:
            step /= 3
    low = np.array([[t[0], 0], [t[1], t[2]]])
    return low @ low.T, np.exp(t[3]), value


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_model_equals_dense_reml(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "who string, x double, m double, y double").selectExpr("*", "x * m AS xm").repartition(5)
    fit = I.mixed_fit(df, "who", "y", "x", ["m", "xm"])
    random, residual, value = least(rows, [1.0, 0.0, 0.5, 0.0])
    assert fit.residual == pytest.approx(residual, rel=1e-4) and fit.random == pytest.approx(random, abs=1e-4 * np.abs(random).max())
    got, beta, se = dense(rows, fit.random, fit.residual)
    assert got <= value + 1e-6
    assert fit.beta == pytest.approx(beta, rel=1e-6) and fit.se == pytest.approx(se, rel=1e-6)
    assert (fit.n, fit.subjects) == (len(rows) - 1, 14) and fit.steps < 30
    terms = I.mixed_model(df.select("who", "x", "m", "y"), "who", "y", "x", moderator="m")
    assert [t[0] for t in terms] == ["intercept", "x", "m", "x:m"] and [t[1] for t in terms] == pytest.approx(list(fit.beta), rel=1e-9)


def test_no_variance_of_slopes(spark):
    rows = made(3, slope_sd=0.0)
    df = spark.createDataFrame(rows, "who string, x double, m double, y double").selectExpr("*", "x * m AS xm")
    fit = I.mixed_fit(df, "who", "y", "x", ["m", "xm"])
    random, residual, value = least(rows, [1.0, 0.0, 0.1, 0.0])
    assert dense(rows, fit.random, fit.residual)[0] <= value + 1e-4
