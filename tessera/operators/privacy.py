"""Differentially private sketches: sensitivities, the analytic Gaussian mechanism, and noisy sums.

Noise is added on the driver to the final sums, which are never written; it comes from the operating system's
cryptographic generator unless a seed is given for tests. Bounds and scales must not come from the data. Noise is complex and the two
maps below only are supported. Double-precision noise has the known artefacts of floating point.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators.feature_map import FeatureMap
from tessera.operators.sketch import sketch, to_vector

#: Fixed names of the neighbour relations.
ADD_OR_REMOVE = ("remove", "add", "remove/add", "standard", "udp")
REPLACE = ("replace", "bdp")


def relation(name: str) -> str:
    if str(name).lower() in ADD_OR_REMOVE:
        return "udp"
    if str(name).lower() in REPLACE:
        return "bdp"
    raise ValueError(f"no neighbour relation named {name!r}")


def sensitivity(fmap: FeatureMap | tuple, n: int = 1, dp: str = "UDP", norm: int = 1, compat: bool = False) -> float:
    """How far one contribution can move the sketch of n rows. ``fmap`` is a map or (m, name, c_norm).

    Replacing a row moves each feature by the distance of two of its values, at most twice its modulus. ``compat``
    gives the smaller published constants for the 2-norm of that case (a factor sqrt(2) less), which are no bound.
    """
    m, name, c = (fmap.m, fmap.f.name, fmap.c_norm) if isinstance(fmap, FeatureMap) else fmap
    # moduli of the features; of sums of the parts' moduli for the 1-norm
    tables = {"complexexponential": {1: math.sqrt(2), 2: 1.0}, "universalquantization_complex": {1: 2.0, 2: math.sqrt(2)}}
    if str(name).lower() not in tables or norm not in (1, 2):
        raise ValueError(f"no sensitivity known for {name!r} and norm {norm!r}")
    per = tables[str(name).lower()][norm]
    one = c * per * (m if norm == 1 else math.sqrt(m))
    moved = one if relation(dp) == "udp" else one * (math.sqrt(2) if compat and norm == 2 else 2)
    return moved / n


def _phi(t: float) -> float:
    return 0.5 * math.erfc(-t / math.sqrt(2))


def delta_of(sigma: float, epsilon: float, sens: float) -> float:
    """The delta that Gaussian noise of this scale gives: the exact formula of Balle and Wang (ICML 2018)."""
    a, b = sens / (2 * sigma), epsilon * sigma / sens
    tail = _phi(-a - b)
    return _phi(a - b) - (math.exp(epsilon + math.log(tail)) if tail > 0 else 0.0)


def gaussian_scale(epsilon: float, delta: float, sens: float, tol: float = 1e-12) -> float:
    """The least noise scale with delta_of <= delta, by bisection of that formula (it falls as the scale grows)."""
    lo = hi = sens
    while delta_of(hi, epsilon, sens) > delta:
        hi *= 2
    while lo > 1e-300 and delta_of(lo, epsilon, sens) <= delta:
        lo /= 2
    while hi - lo > tol * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if delta_of(mid, epsilon, sens) > delta else (lo, mid)
    return hi


class _Noise:
    """Normal and Laplace noise, m numbers at a time."""

    def __init__(self, seed=None):
        self.own = random.SystemRandom() if seed is None else None
        self.seeded = None if seed is None else np.random.default_rng(seed)

    def normal(self, scale: float, m: int) -> np.ndarray:
        return np.array([self.own.gauss(0, scale) for _ in range(m)]) if self.own else self.seeded.normal(0, scale, m)

    def laplace(self, scale: float, m: int) -> np.ndarray:
        if self.seeded:
            return self.seeded.laplace(0, scale, m)
        u = [self.own.random() - 0.5 for _ in range(m)]
        return np.array([math.copysign(-scale * math.log1p(-min(2 * abs(x), 1 - 1e-16)), x) for x in u])


def private_parts(z: np.ndarray, n: int, fmap: FeatureMap, epsilon: float, delta: float = 0.0, dp: str = "UDP", analytic: bool = True, split: float | None = None, seed=None, compat: bool = False) -> tuple[np.ndarray, float]:
    """Noise for a clean sketch z of n rows: the private sketch, and what may be published as its n.

    Under add/remove n is private too: part of the budget is for it, and the noisy n is given. Under replace it is public.
    """
    if math.isinf(epsilon):
        return z, n
    if epsilon <= 0 or not 0 <= delta < 1:
        raise ValueError("epsilon must be positive and delta in [0, 1)")
    rng = _Noise(seed)
    kind, m = relation(dp), len(z)
    own = epsilon
    if kind == "udp":
        split = 2 * m / (2 * m + 1) if split is None else split
        if not 0 < split < 1:
            raise ValueError("split must be between 0 and 1")
        own = split * epsilon
    if delta > 0:
        s = sensitivity(fmap, 1, dp, 2, compat)
        if not analytic and own >= 1:
            raise ValueError("the classical Gaussian mechanism needs epsilon < 1")
        scale = gaussian_scale(own, delta, s) if analytic else math.sqrt(2 * math.log(1.25 / delta)) * s / own
        noise = rng.normal(scale, m) + 1j * rng.normal(scale, m)
    else:
        scale = sensitivity(fmap, 1, dp, 1, compat) / own
        noise = rng.laplace(scale, m) + 1j * rng.laplace(scale, m)
    if kind == "bdp":
        return z + noise / n, n
    noisy = n + float(rng.laplace(1 / (epsilon - own), 1)[0])
    return (n * z + noise) / noisy, noisy


def private_vector(z: np.ndarray, n: int, fmap: FeatureMap, epsilon: float, delta: float = 0.0, **params) -> np.ndarray:
    """The private sketch alone; parameters as in ``private_parts``."""
    return private_parts(z, n, fmap, epsilon, delta, **params)[0]


def private_sketch(df: DataFrame, fmap: FeatureMap, epsilon: float, cols: list[str] | None = None, vector: str | None = None, **params) -> np.ndarray:
    """The private sketch of a DataFrame: sums and n from one pass, noise after it."""
    z, n = to_vector(sketch(df, fmap, cols, vector))
    return private_vector(z, n, fmap, epsilon, **params)
