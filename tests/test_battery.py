"""Many models at once against least squares with dummies and a plain cluster sandwich."""

import numpy as np
import pytest

from trajecta.plans.battery import Model, fit_models, spillover

SCHEMA = "g string, c string, a double, b double, d double, e double, y double, f boolean"


def made():
    rng = np.random.default_rng(0)
    n = 1500
    g = rng.integers(0, 12, n)
    c = g * 100 + rng.integers(0, 9, n)
    x = rng.normal(size=(n, 4)) + g[:, None] * 0.3 + 50
    x[:, 3] = x[:, 0] + x[:, 1]  # depends on two others
    y = x[:, 0] * 0.5 - x[:, 2] + g + rng.normal(size=n) + rng.normal(size=1200)[c % 1200]
    rows = [(f"g{p}" if p else None, f"c{q}" if q else None, *map(float, v), float(t), bool(t > -20)) for p, q, v, t in zip(g, c, x, y, strict=True)]
    rows[5] = (*rows[5][:2], None, *rows[5][3:])
    rows[6] = (*rows[6][:7], None)
    return rows


MODELS = [
    Model(("one",), "y", ("a", "b", "d")),
    Model(("filter, raw",), "y", ("a", "d"), where="f", raw=("d",)),
    Model(("dependent, scaled",), "d", ("y", "a", "b", "e"), scale_y=True),
    Model(("shares its rows",), "y", ("d",), also=("a",)),
]


def dense(rows, m, fe, cluster):
    at = dict(zip("gcabdeyf", range(8), strict=True))
    need = {m.y, *m.xs, *m.also}
    r = [x for x in rows if all(x[at[k]] is not None for k in need) and (m.where == "true" or x[7])]
    col = {k: np.array([x[at[k]] for x in r], float) for k in need}
    z = lambda v: (v - v.mean()) / v.std()
    xs = np.column_stack([col[x] if x in m.raw else z(col[x]) for x in m.xs])
    y = z(col[m.y]) if m.scale_y else col[m.y]
    names = sorted({x[0] or "" for x in r})
    effects = np.eye(len(names))[[names.index(x[0] or "") for x in r]] if fe else np.ones((len(r), 1))
    full = np.hstack([xs, effects])
    bread = np.linalg.pinv(full.T @ full, rcond=1e-12)
    beta = bread @ full.T @ y
    e, k = y - full @ beta, np.linalg.matrix_rank(full)
    if cluster:
        who = np.array([x[1] or "" for x in r])
        scores = np.array([full[who == q].T @ e[who == q] for q in np.unique(who)])
        g = len(scores)
        cov = bread @ scores.T @ scores @ bread * g / (g - 1) * (len(r) - 1) / (len(r) - k)
    else:
        cov = bread * (e @ e) / (len(r) - k)
    return beta[: len(m.xs)], np.sqrt(np.diag(cov))[: len(m.xs)], len(r), 1 - e @ e / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("fe", [None, "g"])
@pytest.mark.parametrize("cluster", [None, "c"])
def test_models_equal_dense_least_squares(spark, fe, cluster):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for m, got in zip(MODELS, fit_models(df, MODELS, fe, cluster), strict=True):
        beta, se, n, r2 = dense(rows, m, fe, cluster)
        own = slice(0, 1) if "e" in m.xs else slice(None)  # what depends on others is shared in another way
        assert got.n == n and got.r2 == pytest.approx(r2, abs=1e-9)
        assert got.beta[own] == pytest.approx(beta[own], abs=1e-9) and got.se[own] == pytest.approx(se[own], abs=1e-9)


def test_models_without_rows_or_with_a_constant_outcome(spark):
    df = spark.createDataFrame(made(), SCHEMA).selectExpr("*", "1.0 AS k")
    none, flat = fit_models(df, [Model(("none",), "y", ("a",), where="a < 0"), Model(("flat",), "k", ("a", "b"))], "g", "c")
    assert none.n == 0 and np.isnan(none.beta).all() and np.isnan(flat.beta).all() and np.isnan(flat.p).all()


def test_spillover_models_nest():
    models = spillover(["v", "w"], 2, "y", "y_lag1", ("pos",), "w = 0", ("w",), "free")
    assert [m.name for m in models] == [("free", "A"), ("free", "B"), ("free", "C"), ("free", "full")]
    assert models[0].xs == ("v",) and models[3].xs == ("v", "v_lag1", "w_lag1", "v_lag2", "w_lag2", "y_lag1", "pos") and len({m.sample for m in models}) == 1
