"""Closed-form sketches of models: Gaussians, mixtures, boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.feature_map import FeatureMap
from tessera.sources.datasets import Mixture


def gaussian_sketch(mu: np.ndarray, sigma: np.ndarray, omega: np.ndarray, xi: np.ndarray | None = None, scale: complex = 1.0) -> np.ndarray:
    """exp(i (mu.w + xi) - w' sigma w / 2) per frequency. ``sigma``: (d, d), or (d,) variances."""
    sigma = np.asarray(sigma, float)
    quad = sigma @ omega**2 if sigma.ndim == 1 else (omega * (sigma @ omega)).sum(0)
    return scale * np.exp(1j * (mu @ omega + (0 if xi is None else xi)) - quad / 2)


def mixture_sketch(mix: Mixture, fmap: FeatureMap, weighted: bool = True) -> np.ndarray:
    """The sketch of a mixture; ``weighted=False`` adds the components with weight 1 each."""
    w = mix.weights if weighted else np.ones(mix.k)
    return sum(w[k] * gaussian_sketch(mix.means[k], mix.covs[k], fmap.omega, fmap.xi, fmap.c_norm) for k in range(mix.k))


def box_sketch(box: np.ndarray, fmap: FeatureMap, categories=None, dims=None, raw: bool = False) -> np.ndarray:
    """The sketch of the uniform law on a box (d, 2), over ``dims`` only.

    Dimensions with categories C > 0 are the integers low..high. ``raw`` gives the integral over continuous
    dimensions, not the mean.
    """
    box = np.asarray(box, float)
    c = np.zeros(fmap.d, int) if categories is None else np.asarray(categories)
    z = fmap.c_norm * np.exp(1j * fmap.xi)
    for i in range(fmap.d) if dims is None else dims:
        w, (lo, hi) = fmap.omega[i], box[i]
        if c[i] > 0:
            z = z * np.exp(1j * np.multiply.outer(w, np.arange(lo, hi + 1))).mean(1)
        else:
            half = (hi - lo) / 2
            z = z * np.exp(1j * w * (lo + hi) / 2) * np.sinc(w * half / np.pi) * (2 * half if raw else 1.0)
    return z


def mixture_sketch_table(spark: SparkSession, mix: Mixture, fmap: FeatureMap) -> DataFrame:
    """j, re, im of a mixture, as DataFrame expressions over the frequencies (the mixture is a few literals)."""
    from tessera.sources.frequencies import table

    freq = table(spark, fmap.omega, fmap.xi)
    re = im = F.lit(0.0)
    for k in range(mix.k):
        phase = F.aggregate(F.zip_with("omega", F.array(*[F.lit(float(v)) for v in mix.means[k]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("xi")
        quad = F.lit(0.0)
        for a in range(fmap.d):
            for b in range(fmap.d):
                if mix.covs[k][a, b]:
                    quad = quad + F.lit(float(mix.covs[k][a, b])) * F.col("omega")[a] * F.col("omega")[b]
        size = F.lit(float(mix.weights[k]) * fmap.c_norm) * F.exp(-quad / 2)
        re, im = re + size * F.cos(phase), im + size * F.sin(phase)
    return freq.select("j", re.alias("re"), im.alias("im"))


def box_sketch_table(spark: SparkSession, box: np.ndarray, fmap: FeatureMap, categories=None) -> DataFrame:
    """j, re, im of the uniform law on a box. A box is symmetric about its centre: one phase times real factors."""
    from tessera.sources.frequencies import table

    c = np.zeros(fmap.d, int) if categories is None else np.asarray(categories)
    phase, size = F.col("xi"), F.lit(fmap.c_norm)
    for i in range(fmap.d):
        w = F.col("omega")[i]
        lo, hi = map(float, box[i])
        phase = phase + w * ((lo + hi) / 2)
        if c[i] > 0:
            n = hi - lo + 1
            near = F.abs(F.sin(w / 2)) < 1e-12
            term = F.when(near, F.cos(w * ((n - 1) / 2))).otherwise(F.sin(w * (n / 2)) / F.when(near, F.lit(1.0)).otherwise(F.sin(w / 2) * n))
        else:
            a = w * ((hi - lo) / 2)
            near = F.abs(a) < 1e-12
            term = F.when(near, F.lit(1.0)).otherwise(F.sin(a) / F.when(near, F.lit(1.0)).otherwise(a))
        size = size * term
    return table(spark, fmap.omega, fmap.xi).select("j", (size * F.cos(phase)).alias("re"), (size * F.sin(phase)).alias("im"))
