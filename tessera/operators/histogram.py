"""Histograms of one dimension from a sketch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.atoms import box_sketch
from tessera.operators.feature_map import FeatureMap
from tessera.plans.optim import bounded_lsq, simplex_projection


def bins_of(domain: np.ndarray, dim: int, categories=None, bins: int = 10) -> np.ndarray:
    """The bins' boxes in one dimension, (bins, 2): its categories, or equal parts of its range."""
    if categories is not None and categories[dim] > 0:
        v = np.arange(categories[dim], dtype=float)
        return np.stack((v, v), 1)
    e = np.linspace(*np.asarray(domain, float)[dim], bins + 1)
    return np.stack((e[:-1], e[1:]), 1)


def _columns(fmap: FeatureMap, domain, dim: int, categories, cells: np.ndarray) -> np.ndarray:
    out = []
    for cell in cells:
        box = np.array(domain, float)
        box[dim] = cell
        out.append(box_sketch(box, fmap, categories))
    return np.stack(out, 1)


def histogram_mmd(z: np.ndarray, fmap: FeatureMap, domain, dim: int, categories=None, bins: int = 10) -> np.ndarray:
    """Weights of boxes (uniform laws) whose mixture has the nearest sketch, within the simplex."""
    a = _columns(fmap, domain, dim, categories, bins_of(domain, dim, categories, bins))
    h = bounded_lsq(np.vstack((a.real, a.imag)), np.concatenate((z.real, z.imag)), 0.0, 5.0)
    return simplex_projection(h)


def histogram_m2m(z: np.ndarray, fmap: FeatureMap, domain, dim: int, categories=None, bins: int = 10, ridge: float = 0.01, project: bool = True) -> np.ndarray:
    """Each bin's indicator is approximated on the domain by features, and its mean read off the sketch.

    The features' Gram matrix under the uniform law on the domain comes from differences of frequencies; it is
    factored once for all bins.
    """
    m, domain = fmap.m, np.asarray(domain, float)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(m), indexing="ij"))
    differences = FeatureMap.of("complexexponential", fmap.omega[:, j] - fmap.omega[:, i], fmap.xi[j] - fmap.xi[i], fmap.c_norm**2)
    gram = box_sketch(domain, differences, categories).reshape(m, m)  # mean of conj(feature i) * feature j
    cells = bins_of(domain, dim, categories, bins)
    inside = _columns(fmap, domain, dim, categories, cells)
    n = categories[dim] if categories is not None and categories[dim] > 0 else None
    share = np.array([1 / n if n else (hi - lo) / (domain[dim, 1] - domain[dim, 0]) for lo, hi in cells])
    coef = np.linalg.solve(gram + ridge * np.eye(m), inside.conj() * share)
    h = (z @ coef).real
    return simplex_projection(h) if project else h


def table(spark: SparkSession, h: np.ndarray, cells: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(b, float(lo), float(hi), float(p)) for b, ((lo, hi), p) in enumerate(zip(cells, h, strict=True))], "bin int, lo double, hi double, p double")


def project_table(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """The simplex projection of the values of each group, in windows."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), key)
    cum = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_s", (1.0 - cum) / F.row_number().over(order))
    ok = F.col(value) + F.col("_s") > 0
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("_r", F.when(ok, F.struct(F.row_number().over(order).alias("r"), F.col("_s").alias("s"))))
    return rows.withColumn("p", F.greatest(F.lit(0.0), F.col(value) + F.max("_r").over(whole)["s"])).drop("_s", "_r")


def direct(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """The true histogram: bin, p. Values outside count in the outer bins."""
    at = F.least(F.greatest(F.floor((F.col(column) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    n = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
