"""Baselines and metrics over the rows themselves: assignments, SSE, likelihoods, EM, divergences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.functions.density import chi2_quantile, cholesky, log_normal_column
from tessera.sources.datasets import Mixture, sample_mixture

LEAST_DENSITY = 1e-25


def _points(batch: pa.RecordBatch, cols: list[str] | None, vector: str | None) -> np.ndarray:
    if cols:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], 1).reshape(-1, len(cols))
    return batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance: found by a matrix product,
    those within its rounding compared by differences."""
    square = (x**2).sum(1)
    d = square[:, None] + (c**2).sum(1) - 2 * x @ c.T
    best = d.min(1)
    close = d <= (best + 1e-9 * (square + (c**2).sum(1).max()))[:, None]
    k = close.argmax(1)
    for i in np.flatnonzero(close.sum(1) > 1):
        k[i] = ((x[i] - c) ** 2).sum(1).argmin()
    return k, ((x - c[k]) ** 2).sum(1)


def assign(df: DataFrame, centroids: np.ndarray, cols: list[str] | None = None, vector: str | None = None) -> DataFrame:
    """``df`` with cluster (the nearest centroid, the first of equals) and distance2; null where a feature is null or
    not a number, or a vector has another length."""
    c = np.asarray(centroids, float)
    own = [F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(cols)] if cols else [F.col(vector).cast("array<double>").alias("_v")]
    whole = F.lit(True)
    for x in cols or []:
        whole = whole & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    if vector:
        whole = F.col(vector).isNotNull() & (F.size(vector) == c.shape[1]) & ~F.coalesce(F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double"))), F.lit(True))
    names, kept = [f"_x{i}" for i in range(len(cols))] if cols else None, len(df.columns)
    schema = StructType([*df.schema.fields, StructField("cluster", IntegerType()), StructField("distance2", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = batch.column("_ok").fill_null(False).to_numpy(zero_copy_only=False)
            k, d = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for i in range(0, batch.num_rows, step):
                at = np.flatnonzero(ok[i : i + step])
                if len(at):
                    k[i + at], d[i + at] = _nearest(_points(batch.slice(i, step).take(pa.array(at)), names, "_v"), c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(k, mask=~ok), pa.array(d, mask=~ok)], names=[*batch.schema.names[:kept], "cluster", "distance2"])

    step = max(1, (1 << 20) // max(len(c), 1))
    return df.select("*", *own, whole.alias("_ok")).mapInArrow(run, schema)


def sse(df: DataFrame, centroids: np.ndarray, cols: list[str] | None = None, vector: str | None = None) -> float:
    """The sum of squared distances to the nearest centroids."""
    return float(assign(df.select(*(cols or [vector])), centroids, cols, vector).agg(F.sum("distance2")).first()[0])


def log_terms(mix: Mixture, cols: list[str]) -> list[Column]:
    """log w_k + log N(x; k) per component."""
    return [F.expr(f"{math.log(max(float(mix.weights[k]), 1e-300))!r} + {log_normal_column(cols, mix.means[k], mix.covs[k])}") for k in range(mix.k)]


def log_density(mix: Mixture, cols: list[str]) -> Column:
    terms = log_terms(mix, cols)
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return top + F.log(sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top)))


def log_likelihood(df: DataFrame, mix: Mixture, cols: list[str]) -> float:
    """The mean log density; underflow and singular covariances do no harm."""
    return float(df.agg(F.avg(log_density(mix, cols))).first()[0])


def responsibilities(df: DataFrame, mix: Mixture, cols: list[str]) -> DataFrame:
    """``df`` with columns r0 .. of each component's share of the density, and loglik."""
    names = [f"_t{k}" for k in range(mix.k)]
    rows = df.select("*", *[t.alias(n) for t, n in zip(log_terms(mix, cols), names, strict=True)])
    top = F.greatest(*names) if mix.k > 1 else F.col(names[0])
    rows = rows.withColumn("_top", top).withColumn("_sum", sum((F.exp(F.col(n) - F.col("_top")) for n in names[1:]), F.exp(F.col(names[0]) - F.col("_top"))))
    rows = rows.withColumns({f"r{k}": F.exp(F.col(n) - F.col("_top")) / F.col("_sum") for k, n in enumerate(names)})
    return rows.withColumn("loglik", F.col("_top") + F.log("_sum")).drop(*names, "_top", "_sum")


def _log_terms(mix: Mixture, x: np.ndarray) -> np.ndarray:
    """log w_k + log N(x; k), (n, K)."""
    out = np.empty((len(x), mix.k))
    for k in range(mix.k):
        low = cholesky(mix.covs[k])
        y = np.linalg.solve(low, (x - mix.means[k]).T)
        out[:, k] = math.log(max(float(mix.weights[k]), 1e-300)) - (y**2).sum(0) / 2 - np.log(np.diag(low)).sum() - x.shape[1] / 2 * math.log(2 * math.pi)
    return out


def moments(df: DataFrame, mix: Mixture, cols: list[str]) -> DataFrame:
    """The E-step's sums: rows (k, i, j, value). Component k has its responsibilities (i and j null), first moments (j
    null) and second ones (j <= i); k null is n (i = 0) and the log-likelihood (i = 1)."""
    d = len(cols)
    low_i, low_j = np.tril_indices(d)
    i = [None] + list(range(d)) + low_i.tolist()
    j = [None] * (d + 1) + low_j.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, loglik = np.zeros((mix.k, len(i))), 0, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                x = _points(batch.slice(at, 8192), names, None)
                t = _log_terms(mix, x)
                top = t.max(1, keepdims=True)
                r = np.exp(t - top)
                total = r.sum(1, keepdims=True)
                loglik += float((top + np.log(total)).sum())
                n += len(x)
                r /= total
                sums[:, 0] += r.sum(0)
                sums[:, 1 : d + 1] += r.T @ x
                sums[:, d + 1 :] += r.T @ (x[:, low_i] * x[:, low_j])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k in range(mix.k) for _ in i] + [None] * 2, pa.int32()), pa.array(i * mix.k + [0, 1], pa.int32()), pa.array(j * mix.k + [None] * 2, pa.int32()), pa.array([*sums.ravel().tolist(), float(n), loglik])],
            names=["k", "i", "j", "value"],
        )

    names = [f"_x{k}" for k in range(d)]
    own = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names, strict=True)]).dropna()
    return own.mapInArrow(run, "k int, i int, j int, value double").groupBy("k", "i", "j").agg(F.sum("value").alias("value"))


def em_step(df: DataFrame, mix: Mixture, cols: list[str], ridge: float = 1e-9) -> tuple[Mixture, float]:
    """One step of EM: the next mixture, and the mean log-likelihood of this one."""
    got = {(r["k"], r["i"], r["j"]): r["value"] for r in moments(df, mix, cols).collect()}  # K (d + 1) (d + 2) / 2 rows
    d, n = len(cols), got.get((None, 0, None), 0.0)
    if not n:
        raise ValueError("the dataset is empty")
    w, mu, cov = np.empty(mix.k), np.empty((mix.k, d)), np.empty((mix.k, d, d))
    for k in range(mix.k):
        nk = got[k, None, None]
        w[k] = nk / n
        if nk < 1e-8:  # an empty component stays
            mu[k], cov[k] = mix.means[k], mix.covs[k]
            continue
        mu[k] = [got[k, i, None] / nk for i in range(d)]
        for i in range(d):
            for j in range(i + 1):
                cov[k, i, j] = cov[k, j, i] = got[k, i, j] / nk - mu[k, i] * mu[k, j]
        cov[k] += ridge * max(1e-300, np.trace(cov[k]) / d) * np.eye(d)
    return Mixture(w / w.sum(), mu, cov), got[None, 1, None] / n


def em(df: DataFrame, k: int, cols: list[str], rounds: int = 20, runs: int = 1, seed: int = 0) -> tuple[Mixture, float]:
    """Gaussian mixture by EM from random rows as means; the best of ``runs`` by log-likelihood.

    One aggregation per round; the feature columns stay in memory for the rounds.
    """
    rows = df.select(*cols).dropna().persist()
    try:
        var = rows.agg(*[F.var_pop(c) for c in cols]).first()
        best = None
        for r in range(runs):
            means = np.array([list(x) for x in rows.orderBy(F.rand(seed + r)).limit(k).collect()], float)
            mix = Mixture(np.full(k, 1 / k), means, np.repeat(np.diag([max(v, 1e-12) for v in var])[None], k, 0))
            for _ in range(rounds):
                mix, _was = em_step(rows, mix, cols)
            ll = log_likelihood(rows, mix, cols)
            if best is None or ll > best[1]:
                best = (mix, ll)
        return best
    finally:
        rows.unpersist()


def symmetric_kl(spark: SparkSession, p: Mixture, q: Mixture, n: int = 500_000, seed: int = 0) -> float:
    """Half of KL(p, q) + KL(q, p) by n rows of each; densities count as at least 1e-25."""
    d = p.means.shape[1]
    cols = [f"x{i}" for i in range(d)]
    low = math.log(LEAST_DENSITY)

    def one(a: Mixture, b: Mixture, s: int) -> float:
        rows = sample_mixture(spark, a, n, s).select(*[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
        gap = F.greatest(log_density(a, cols), F.lit(low)) - F.greatest(log_density(b, cols), F.lit(low))
        return float(rows.agg(F.avg(gap)).first()[0])

    return (one(p, q, seed) + one(q, p, seed + 100)) / 2


def ellipses(spark: SparkSession, mix: Mixture, dims: tuple[int, int] = (0, 1), share: float = 0.95) -> DataFrame:
    """What a plot of a mixture needs: centre, full axes and angle (degrees) of the ellipse that holds ``share`` of each component."""
    c, rows = 2 * math.sqrt(chi2_quantile(share, 2)), []
    for k in range(mix.k):
        lam, v = np.linalg.eigh(mix.covs[k][np.ix_(dims, dims)])
        angle = math.degrees(math.atan2(v[1, 1], v[0, 1]))
        rows.append((k, float(mix.weights[k]), *(float(mix.means[k][i]) for i in dims), c * math.sqrt(max(lam[1], 0)), c * math.sqrt(max(lam[0], 0)), (angle + 90) % 180 - 90))
    return spark.createDataFrame(rows, "k int, weight double, x double, y double, width double, height double, angle double")

