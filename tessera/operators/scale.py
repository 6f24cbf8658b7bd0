"""Estimating the scale of the data, which frequencies need, from small sketches of a sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.feature_map import FeatureMap
from tessera.operators.sketch import sketch, to_vector
from tessera.plans.optim import minimize_bounded
from tessera.sources.frequencies import draw


def block_extremes(r: np.ndarray, size: np.ndarray, blocks: int, mode: str = "max") -> tuple[np.ndarray, np.ndarray]:
    """Radii and sizes of the largest (or smallest) entry in each of ``blocks`` blocks of frequencies by radius."""
    if mode not in ("max", "min"):
        raise ValueError("mode is max or min")
    if len(r) < blocks:
        raise ValueError("fewer frequencies than blocks")
    order = np.argsort(r, kind="stable")
    per = len(r) // blocks
    s = size[order][: per * blocks].reshape(blocks, per)
    at = (s.argmax(1) if mode == "max" else s.argmin(1)) + per * np.arange(blocks)
    return r[order][at], size[order][at]


def block_extremes_table(radii: DataFrame, blocks: int, m: int, mode: str = "max") -> DataFrame:
    """The same for a DataFrame of j, r, size: block, j, r, size. It has one row per frequency, m in all."""
    rank = F.row_number().over(Window.orderBy("r", "j")) - 1
    rows = radii.withColumn("block", F.floor(rank / (m // blocks)).cast("int")).filter(F.col("block") < blocks)
    pick = F.max_by if mode == "max" else F.min_by
    return rows.groupBy("block").agg(pick(F.struct("j", "r", "size"), "size").alias("x")).select("block", "x.*")


def fit_variances(r: np.ndarray, size: np.ndarray, k: int, start_w: np.ndarray, start_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and variances of sum_k w_k exp(-r^2 s_k / 2) by bounded least squares."""

    def fun(p):
        w, s = p[:k], p[k:]
        e = np.exp(-(r[:, None] ** 2) * s / 2)
        d = e @ w - size
        return float(d @ d), np.concatenate((2 * (e.T @ d), -w * ((e * r[:, None] ** 2).T @ d)))

    lo = np.concatenate((np.full(k, 1e-5), 5e-4 * start_s))
    hi = np.concatenate((np.ones(k), 2e3 * start_s))
    p, _ = minimize_bounded(fun, np.concatenate((start_w, start_s)), lo, hi, ftol=1e-12)
    return p[:k] / p[:k].sum(), p[k:]


def variances_from_sketch(z: np.ndarray, fmap: FeatureMap, k: int = 1, blocks: int = 20, mode: str = "max", start: tuple | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and variances that explain the envelope of the sketch's moduli over frequency radii."""
    r, size = block_extremes(np.linalg.norm(fmap.omega, axis=0), np.abs(z) / fmap.c_norm, blocks, mode)
    w, s = start or (np.full(k, 1 / k), np.random.default_rng(seed).uniform(0.3, 1.6, k))
    return fit_variances(r, size, k, np.asarray(w, float), np.asarray(s, float))


def exact_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all, if fewer) by a hash of their content, whatever the partitions. Only the least hashes of
    each task meet in one."""
    return df.withColumn("_u", F.xxhash64(*df.columns, F.lit(seed))).orderBy("_u").limit(n).drop("_u")


def estimate_scale(df: DataFrame, cols: list[str], m0: int, k: int | None = None, blocks: int = 20, sample: int | None = None, law: str = "AR", rounds: int = 5, mode: str = "max", seed: int = 0):
    """A covariance (d, d) that suits the data, or with ``k`` weights and covariances (k, d, d).

    Each round draws m0 frequencies at the scale so far, sketches the sample and fits the scale again. The sample is
    kept in memory for the rounds. The result depends on the data and is not private.
    """
    d = len(cols)
    rows = df.select(*cols)
    if sample is not None:
        rows = exact_sample(rows, sample, seed)
    rows = rows.persist()
    rng = np.random.default_rng(seed)
    kk = k or 1
    w, s = np.full(kk, 1 / kk), rng.uniform(0.3, 1.6, kk)
    try:
        for _ in range(rounds):
            sigma = (w, s) if kk > 1 else float(s[0])
            fmap = FeatureMap.of("complexexponential", draw(law, d, m0, sigma, seed=rng))
            z, _n = to_vector(sketch(rows, fmap, cols))
            w, s = variances_from_sketch(z, fmap, kk, blocks, mode, (w, s))
    finally:
        rows.unpersist()
    return s[0] * np.eye(d) if k is None else (w, s[:, None, None] * np.eye(d))
