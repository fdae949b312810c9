"""Many linear models of one table at once, with fixed effects and clustered errors.

Two passes over the rows serve all models, whatever their number. The first sums the products
of all columns (a matrix product a batch) for each sample, and column sums by fixed-effect
group; the second sums, for each model, group and cluster, what the scores of the sandwich
consist of. Demeaning by groups is applied to those sums and never to rows, so neither pass
joins rows with anything. Only matrices as large as the models reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions.tails import normal_p, student_p


@dataclass(frozen=True)
class Model:
    """``y`` on ``xs`` over the rows where ``where`` (SQL) holds and nothing is missing.

    Coefficients are per standard deviation of an x (and of y, with ``scale_y``), taken over the
    model's rows, but for the columns in ``raw``. Rows with a null in ``also`` go too, so that
    models can share their rows.
    """

    name: tuple
    y: str
    xs: tuple[str, ...]
    where: str = "true"
    raw: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    scale_y: bool = False

    @property
    def sample(self) -> tuple:
        return self.where, tuple(sorted({self.y, *self.xs, *self.also}))


@dataclass
class Estimate:
    model: Model
    beta: np.ndarray
    se: np.ndarray
    p: np.ndarray
    n: int
    r2: float

    def terms(self) -> list[tuple]:
        """(x, beta, se, p, n)"""
        return [(x, float(b), float(s), float(p), self.n) for x, b, s, p in zip(self.model.xs, self.beta, self.se, self.p, strict=True)]


def _key(c: str | None) -> Column:
    return F.lit("") if c is None else F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _matrix(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _codes(*keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, and the first row of each group."""
    code = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        own = k.dictionary_encode()
        code = code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _by(code: np.ndarray, groups: int, x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(code, weights=c, minlength=groups) for c in x.T]) if x.shape[1] else np.zeros((groups, 0))


def _total(parts: DataFrame, key: str, value: str) -> dict[int, np.ndarray]:
    """Sums of arrays by key: as many numbers as the models' matrices have."""
    got = parts.select(key, F.posexplode(value).alias("i", "v")).groupBy(key, "i").agg(F.sum("v").alias("v")).collect()
    out: dict[int, dict[int, float]] = {}
    for r in got:
        out.setdefault(r[key], {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def fit_models(df: DataFrame, models: list[Model], fe: str | None = None, cluster: str | None = None) -> list[Estimate]:
    """All ``models`` of ``df``, with effects of ``fe`` absorbed and errors robust inside ``cluster``.

    With clusters, p is normal and the covariance has the factor G / (G - 1) * (n - 1) / (n - k), k
    counting the effects; without, errors are classical and p is Student's. A null group or
    cluster is one of its own. Columns that depend on others share by least norm; k counts
    what is independent. A model without rows, or with a constant y, has NaN everywhere.
    """
    cols = list(dict.fromkeys(c for m in models for c in m.sample[1]))
    at = {c: i for i, c in enumerate(cols)}
    samples = list(dict.fromkeys(m.sample for m in models))
    wheres = list(dict.fromkeys(s[0] for s in samples))
    kinds = [(wheres.index(w), [at[c] for c in names]) for w, names in samples]
    width = len(cols)
    mean = df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()  # a number for each column
    shifted = F.array(*[F.col(c).cast("double") - F.lit(float(m or 0.0)) for c, m in zip(cols, mean, strict=True)])
    rows = df.select(_key(fe).alias("g"), _key(cluster).alias("c"), shifted.alias("x"), F.array(*[F.coalesce(F.expr(w), F.lit(False)).cast("double") for w in wheres]).alias("keep"))

    def kept(b: pa.RecordBatch):
        x, keep = _matrix(b, "x", width), _matrix(b, "keep", len(wheres))
        missing = np.isnan(x)
        for k, (w, own) in enumerate(kinds):
            on = np.flatnonzero((keep[:, w] > 0) & ~missing[:, own].any(1))
            if len(on):
                yield k, on, np.nan_to_num(x[on])

    part = pa.schema([("kind", pa.int32()), ("g", pa.string()), ("n", pa.float64()), ("s", pa.list_(pa.float64())), ("xx", pa.list_(pa.float64()))])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((len(kinds), width, width))
        for b in batches:
            out = []
            for k, on, x in kept(b):
                products[k] += x.T @ x
                groups = b.column("g").take(pa.array(on))
                code, first = _codes(groups)
                sums, n = _by(code, len(first), x), np.bincount(code)
                out += [{"kind": k, "g": groups[int(i)].as_py(), "n": float(m), "s": s.tolist(), "xx": None} for i, m, s in zip(first, n, sums, strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=part)
        yield pa.RecordBatch.from_pylist([{"kind": k, "g": None, "n": 0.0, "s": None, "xx": p.ravel().tolist()} for k, p in enumerate(products)], schema=part)

    sums = rows.mapInArrow(first_pass, "kind int, g string, n double, s array<double>, xx array<double>").persist()
    groups = sums.where("g is not null").groupBy("kind", "g").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).persist()
    products = _total(sums.where("xx is not null"), "kind", "xx")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n, groups, sums and the products of group sums, by kind."""
        held = np.zeros((len(kinds), 2 + width + width * width))
        for b in batches:
            if not b.num_rows:
                continue
            kind, n, s = b.column("kind").to_numpy(), b.column("n").to_numpy(), _matrix(b, "s", width)
            for k in np.unique(kind):
                own = kind == k
                w = s[own] / np.sqrt(n[own])[:, None]
                held[k] += np.concatenate([[n[own].sum(), own.sum()], s[own].sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(kinds)), pa.int32()), pa.array(held.tolist(), pa.list_(pa.float64()))], names=["kind", "v"])

    totals = _total(groups.mapInArrow(between, "kind int, v array<double>"), "kind", "v")
    fits = []
    for m in models:
        k = samples.index(m.sample)
        t = totals.get(k, np.zeros(2 + width + width * width))
        n, g, s = t[0], t[1], t[2 : 2 + width]
        xx = products.get(k, np.zeros(width * width)).reshape(width, width)
        whole = xx - np.outer(s, s) / max(n, 1)
        inner = xx - t[2 + width :].reshape(width, width) if fe else whole
        x, y = [at[c] for c in m.xs], at[m.y]
        sd = np.sqrt(np.maximum(np.diag(whole), 0) / max(n, 1))
        flat = np.sqrt(np.maximum(np.diag(inner), 1e-300))[x]  # solved in units of each column, for digits
        scaled = inner[np.ix_(x, x)] / np.outer(flat, flat)
        bread = np.linalg.pinv(scaled, rcond=1e-10, hermitian=True) / np.outer(flat, flat)
        beta = bread @ inner[x, y]
        rest = max(inner[y, y] - beta @ inner[x, y], 0.0)
        used = int(np.linalg.matrix_rank(scaled, tol=1e-8, hermitian=True)) + (int(g) if fe else 1)
        scale = np.array([1.0 if c in m.raw else sd[at[c]] for c in m.xs]) / (sd[y] if m.scale_y and sd[y] else 1.0)
        ok = n > 0 and inner[y, y] > 1e-12 * max(xx[y, y], 1e-300)
        fits.append({"k": k, "x": x, "y": y, "n": int(n), "beta": beta, "bread": bread, "rest": rest, "used": used, "scale": scale, "ok": ok, "r2": 1 - rest / (whole if fe else inner)[y, y] if ok else float("nan")})
    if cluster is None:
        covariances = [f["bread"] * f["rest"] / max(f["n"] - f["used"], 1) for f in fits]
    else:
        covariances = _sandwiches(rows, groups, kept, fits, bool(fe), at, width)
    sums.unpersist()
    groups.unpersist()
    out = []
    for m, f, cov in zip(models, fits, covariances, strict=True):
        se = np.sqrt(np.maximum(np.diag(cov), 0)) * f["scale"]
        beta = f["beta"] * f["scale"]
        if not f["ok"]:
            beta, se = np.full(len(beta), np.nan), np.full(len(beta), np.nan)
        tail = normal_p if cluster else lambda t, df=f["n"] - f["used"]: student_p(t, df)
        p = np.array([tail(b / s) if s > 0 else float("nan") for b, s in zip(beta, se, strict=True)])
        out.append(Estimate(m, beta, se, p, f["n"], float(f["r2"])))
    return out


def _sandwiches(rows: DataFrame, groups: DataFrame, kept, fits: list[dict], fe: bool, at: dict, width: int) -> list[np.ndarray]:
    """Cluster-robust covariances of all models.

    With u = y - x'b of a row, m the means of its group and e = u - m_u, a cluster's score of x is
    sum(x u) - m_u sum(x) - m_x sum(u) + n m_x m_u over its rows in the group: sums by (group, cluster).
    """
    most = max(len(f["x"]) for f in fits)
    size = 2 * most + 2
    cell = pa.schema([("model", pa.int32()), ("kind", pa.int32()), ("g", pa.string()), ("c", pa.string()), ("v", pa.list_(pa.float64()))])
    plain = [(f["k"], f["x"], f["y"], f["beta"]) for f in fits]

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_kind = {k: (on, x) for k, on, x in kept(b)}
            for i, (k, own, y, beta) in enumerate(plain):
                if k not in by_kind:
                    continue
                on, x = by_kind[k]
                take = pa.array(on)
                g, c = b.column("g").take(take), b.column("c").take(take)
                code, first = _codes(g, c)
                z = x[:, own]
                u = x[:, y] - z @ beta
                pad = np.zeros((len(on), most - len(own)))
                v = _by(code, len(first), np.hstack([z * u[:, None], pad, z, pad, u[:, None], np.ones((len(on), 1))]))
                at_ = pa.array(first)
                same = np.full(len(first), i), np.full(len(first), k)
                yield pa.RecordBatch.from_arrays([pa.array(same[0], pa.int32()), pa.array(same[1], pa.int32()), g.take(at_), c.take(at_), pa.array(list(v), pa.list_(pa.float64()))], schema=cell)

    cells = rows.mapInArrow(second_pass, "model int, kind int, g string, c string, v array<double>")
    cells = cells.groupBy("model", "kind", "g", "c").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("v"))
    if fe:  # a row for each group meets a row for each group and cluster
        means = groups.select("kind", "g", F.transform("s", lambda s: s / F.col("n")).alias("m"))
    else:
        means = groups.groupBy("kind").agg(F.array(*[F.sum(F.col("s")[i]) / F.sum("n") for i in range(width)]).alias("m"))
    joined = cells.join(means.hint("shuffle_hash"), ["kind", "g"] if fe else ["kind"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            model, v, m = b.column("model").to_numpy(), _matrix(b, "v", size), _matrix(b, "m", width)
            out = np.zeros((b.num_rows, most))
            for i in np.unique(model):
                _, own, y, beta = plain[i]
                on, k = model == i, len(own)
                mx = m[on][:, own]
                mu = m[on, y] - mx @ beta
                out[on, :k] = v[on, :k] - mu[:, None] * v[on, most : most + k] - mx * v[on, -2:-1] + v[on, -1:] * mx * mu[:, None]
            yield pa.RecordBatch.from_arrays([b.column("model"), b.column("c"), pa.array(list(out), pa.list_(pa.float64()))], names=["model", "c", "s"])

    each = joined.mapInArrow(scores, "model int, c string, s array<double>").groupBy("model", "c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(most)]).alias("s"))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(plain), 1 + most * most))
        for b in batches:
            if not b.num_rows:
                continue
            model, s = b.column("model").to_numpy(), _matrix(b, "s", most)
            for i in np.unique(model):
                own = s[model == i]
                held[i] += np.concatenate([[len(own)], (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(plain)), pa.int32()), pa.array(held.tolist(), pa.list_(pa.float64()))], names=["model", "v"])

    meats = _total(each.mapInArrow(outer, "model int, v array<double>"), "model", "v")
    out = []
    for i, f in enumerate(fits):
        t = meats.get(i, np.zeros(1 + most * most))
        g, n, k = t[0], f["n"], len(f["x"])
        meat = t[1:].reshape(most, most)[:k, :k]
        factor = g / (g - 1) * (n - 1) / (n - f["used"]) if g > 1 and n > f["used"] else float("nan")
        out.append(f["bread"] @ meat @ f["bread"] * factor)
    return out


def spillover(variables: list[str], lags: int, y: str, before: str, controls: tuple[str, ...], where: str = "true", without: tuple[str, ...] = (), tag: str = "all") -> list[Model]:
    """Nested models of an outcome on variables now and ``lags`` rows before.

    A has the variables of the row itself, B and C those of one and two rows before as well, and
    so on; the last one (``full``) adds the outcome of the row before and the controls. All share
    their rows: none with a lag missing. ``without`` names columns that the sample holds constant.
    """
    steps = [tuple(v if not i else f"{v}_lag{i}" for i in range(n + 1) for v in variables) for n in range(lags + 1)]
    every = (*steps[-1], before, *controls)
    take = lambda xs: tuple(x for x in xs if x not in without)
    out = [Model((tag, "ABCDEFGH"[i]), y, take(xs), where, also=every) for i, xs in enumerate(steps)]
    return [*out, Model((tag, "full"), y, take(every), where, raw=controls, also=every)]
