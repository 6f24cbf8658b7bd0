"""Densities of frequency radii and of Gaussian mixtures, in NumPy and as Spark columns."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def adapted_radius(r, kmeans: bool = False):
    """The adapted-radius density, up to a constant; ``kmeans`` drops the gradient with respect to scale."""
    if isinstance(r, Column):
        return r * F.exp(-r * r / 2) if kmeans else F.sqrt(r * r + r * r * r * r / 4) * F.exp(-r * r / 2)
    return r * np.exp(-(r**2) / 2) if kmeans else np.hypot(r, r**2 / 2) * np.exp(-(r**2) / 2)


def gaussian_side(side: tuple | float | None) -> tuple[list[float], list[float]]:
    """Weights and deviations: given as such, one deviation of weight 1, or none."""
    if side is None:
        return [], []
    return (np.ravel(side[0]).tolist(), np.ravel(side[1]).tolist()) if isinstance(side, tuple) else ([1.0], [float(side)])


def difference_of_gaussians(r, upper: tuple | float | None, lower: tuple | float | None = None, tol: float = 1e-8):
    """The sum of w exp(-r^2 / 2 s^2) over ``upper`` (weights, deviations) less that over ``lower``, cut at 0."""
    upper, lower = gaussian_side(upper), gaussian_side(lower)
    if isinstance(r, Column):
        terms = [F.lit(float(sign * w)) * F.exp(-r * r / float(2 * s * s)) for sign, side in ((1, upper), (-1, lower)) for w, s in zip(*side, strict=True)]
        return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    r = np.asarray(r, float)
    out = np.zeros_like(r)
    for sign, (w, s) in ((1, upper), (-1, lower)):
        for weight, deviation in zip(w, s, strict=True):
            out += sign * weight * np.exp(-(r**2) / (2 * deviation**2))
    if out.size and out.min() < -tol:
        warnings.warn("negative densities were cut to zero", stacklevel=2)
    return np.maximum(out, 0.0)


def inverse_cdf(density: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Values at which the cumulated, normalised density on the grid x reaches u, linear between grid points."""
    cdf = np.cumsum(density / np.sum(density))
    cdf[-1] = 1.0
    return np.interp(u, cdf, x)


def cholesky(sigma: np.ndarray) -> np.ndarray:
    """A factor L with L L^T = sigma; a singular sigma gets the least ridge that makes it definite."""
    sigma = np.asarray(sigma, float)
    ridge = 0.0
    for _ in range(40):
        try:
            return np.linalg.cholesky(sigma + ridge * np.eye(len(sigma)))
        except np.linalg.LinAlgError:
            ridge = max(10 * ridge, 1e-14 * max(1.0, float(np.trace(np.abs(sigma)))))
    raise np.linalg.LinAlgError("not a covariance matrix")


def log_normal_density(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """log N(x; mu, sigma) for rows of x."""
    low = cholesky(sigma)
    y = np.linalg.solve(low, (x - mu).T)
    return -0.5 * (y**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(mu) * math.log(2 * math.pi)


def log_normal_column(cols: list[str], mu: np.ndarray, sigma: np.ndarray) -> str:
    """The same as SQL text over columns: a quadratic form with literal precision matrix."""
    low = cholesky(sigma)
    inv = np.linalg.inv(low)
    p = inv.T @ inv
    const = -float(np.log(np.diag(low)).sum()) - 0.5 * len(mu) * math.log(2 * math.pi)
    dev = [f"({c} - {float(v)!r})" for c, v in zip(cols, mu, strict=True)]
    terms = [f"{float(p[i, i])!r} * {dev[i]} * {dev[i]}" for i in range(len(mu))]
    terms += [f"{float(2 * p[i, j])!r} * {dev[i]} * {dev[j]}" for i in range(len(mu)) for j in range(i) if p[i, j]]
    return f"({const!r} - 0.5 * ({' + '.join(terms)}))"


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * math.exp(log_front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(log_front) * h


def chi2_quantile(p: float, k: int) -> float:
    """The value below which a chi-squared variable with k degrees of freedom stays with probability p."""
    lo, hi = 0.0, 1.0
    while gamma_p(k / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(k / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2
