"""Laws of the frequencies of a sketch. Frequencies are few (10^2 to 10^4), so they are drawn on the driver, seeded."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.density import adapted_radius, cholesky, difference_of_gaussians, gaussian_side, inverse_cdf

#: Fixed names of the laws (any case).
ALIASES = {
    "gaussian": ("drawfrequencies_gaussian", "gaussian", "g"),
    "folded_gaussian": ("drawfrequencies_foldedgaussian", "foldedgaussian", "folded_gaussian", "fg"),
    "adapted_radius": ("drawfrequencies_adapted", "adaptedradius", "adapted_radius", "ar"),
    "adapted_radius_kmeans": ("drawfrequencies_adapted_kmeans", "adaptedradius_kmeans", "adapted_radius_kmeans", "arkm", "ar-km"),
}
_LAW = {alias: law for law, names in ALIASES.items() for alias in names}


def _rng(seed) -> np.random.Generator:
    return seed if isinstance(seed, np.random.Generator) else np.random.default_rng(seed)


def dither(m: int, bounds: tuple[float, float] | None = None, seed=None) -> np.ndarray:
    """m offsets, uniform on [low, high), by default on a whole turn."""
    low, high = bounds or (0.0, 2 * np.pi)
    return _rng(seed).uniform(low, high, m)


def _directions(d: int, m: int, rng: np.random.Generator) -> np.ndarray:
    v = rng.standard_normal((d, m))
    return v / np.linalg.norm(v, axis=0)


def _whiten(sigma: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """L^-T x for sigma = L L^T, so that isotropic x get second moments along sigma^-1."""
    return x if sigma is None else np.linalg.solve(cholesky(sigma).T, x)


def gaussian(d: int, m: int, sigma: np.ndarray | None = None, seed=None) -> np.ndarray:
    return _whiten(sigma, _rng(seed).standard_normal((d, m)))


def folded_gaussian(d: int, m: int, sigma: np.ndarray | None = None, seed=None) -> np.ndarray:
    rng = _rng(seed)
    return _whiten(sigma, _directions(d, m, rng) * np.abs(rng.standard_normal(m)))


def adapted(d: int, m: int, sigma: np.ndarray | None = None, kmeans: bool = False, seed=None) -> np.ndarray:
    rng = _rng(seed)
    r = np.linspace(0, 5, 2001)
    radius = inverse_cdf(adapted_radius(r, kmeans), r, rng.uniform(size=m))
    return _whiten(sigma, _directions(d, m, rng) * radius)


def of_gaussian_difference(d: int, m: int, upper: tuple | float, lower: tuple | float | None = None, seed=None) -> np.ndarray:
    """Radii by the difference of two one-dimensional mixtures, (weights, deviations), a deviation or none each; directions uniform."""
    rng = _rng(seed)
    r = np.linspace(0, 4 * max(gaussian_side(upper)[1] + gaussian_side(lower)[1]), 1001)
    return _directions(d, m, rng) * inverse_cdf(difference_of_gaussians(r, upper, lower), r, rng.uniform(size=m))


def draw(law: str, d: int, m: int, sigma=None, categories: Sequence[int] | None = None, seed=None) -> np.ndarray:
    """The (d, m) frequencies of a law by name.

    ``sigma``: None, a positive number, a (d, d) covariance, or (weights, covariances) of a mixture, whose components
    share the frequencies by weight. Dimensions with ``categories`` C > 0 (integers 0..C-1) get multiples of
    2 pi / C, one such dimension per frequency; continuous rows stay as drawn.
    """
    key = _LAW.get(str(law).lower())
    if key is None:
        raise ValueError(f"no law named {law!r}")
    rng = _rng(seed)
    one = {"gaussian": gaussian, "folded_gaussian": folded_gaussian, "adapted_radius": adapted, "adapted_radius_kmeans": lambda *a, **b: adapted(*a, kmeans=True, **b)}[key]
    if isinstance(sigma, tuple):
        weights, covs = np.asarray(sigma[0], float), np.asarray(sigma[1], float)
        if covs.ndim == 1:
            covs = covs[:, None, None] * np.eye(d)
        of = rng.choice(len(weights), m, p=weights / weights.sum())
        omega = np.empty((d, m))
        for k in np.unique(of):
            omega[:, of == k] = one(d, int((of == k).sum()), covs[k], seed=rng)
    else:
        if np.isscalar(sigma):
            if not sigma > 0:
                raise ValueError("sigma must be positive")
            sigma = float(sigma) * np.eye(d)
        elif sigma is not None and np.shape(sigma) != (d, d):
            raise ValueError("sigma is None, a number, a (d, d) matrix, or weights and covariances")
        omega = one(d, m, sigma, seed=rng)
    if categories is not None and np.any(np.asarray(categories) > 0):
        c = np.asarray(categories)
        ints = np.flatnonzero(c > 0)
        chosen = rng.choice(ints, m)
        for i in ints:
            omega[i] = np.where(chosen == i, 2 * np.pi / c[i] * rng.integers(0, c[i], m), 0.0)
    return omega


def table(spark: SparkSession, omega: np.ndarray, xi: np.ndarray | None = None) -> DataFrame:
    """j, omega, xi as a DataFrame."""
    xi = np.zeros(omega.shape[1]) if xi is None else xi
    return spark.createDataFrame([(j, omega[:, j].tolist(), float(xi[j])) for j in range(omega.shape[1])], "j int, omega array<double>, xi double")
