"""Learning mixtures from a sketch: orthogonal matching pursuit with replacement, and hierarchical splitting.

A solver fits  z ~ sum_k alpha_k A(theta_k)  over atoms A: single points (k-means), Gaussians with diagonal or full
covariance. It needs the sketch only, so it runs on the driver, or restarts run as tasks (``fit_restarts``).
Solutions are immutable and are compared by their cost before weights are scaled to add up to 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.density import cholesky
from tessera.operators.atoms import box_sketch
from tessera.operators.feature_map import FeatureMap
from tessera.plans.optim import minimize_bounded, nnls
from tessera.sources.datasets import Mixture

MOST_WEIGHT, LEAST_WEIGHT = 2.0, 1e-9


@dataclass(frozen=True)
class Solution:
    alpha: np.ndarray
    theta: np.ndarray
    cost: float
    history: tuple[float, ...] = ()

    @property
    def weights(self) -> np.ndarray:
        total = self.alpha.sum()
        return self.alpha / total if total > 0 else np.full(len(self.alpha), 1 / max(len(self.alpha), 1))


def _real(z: np.ndarray) -> np.ndarray:
    return np.concatenate((z.real, z.imag))


class Atoms:
    """A family of atoms: sketches (m, k) of parameters (k, p), and products of a residual with their derivatives."""

    size: int
    lo: np.ndarray
    hi: np.ndarray

    def sketch(self, theta: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pull(self, theta: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Re <dA/dtheta, g> per atom and parameter, (k, p); ``a`` is sketch(theta), g (m, k) complex."""
        raise NotImplementedError

    def start(self, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError


class Points(Atoms):
    """Single points: A(c) is the feature map itself."""

    def __init__(self, fmap: FeatureMap, bounds: np.ndarray, ignored: np.ndarray | complex = 1.0):
        if fmap.f.grad is None:
            raise TypeError(f"{fmap.f.name} has no derivative; decode with another wave")
        self.fmap, self.ignored = fmap, np.broadcast_to(np.asarray(ignored, complex), (fmap.m,))
        self.lo, self.hi = np.asarray(bounds, float)
        self.size = fmap.d

    def sketch(self, theta):
        return (self.fmap(theta) * self.ignored).T

    def pull(self, theta, a, g):
        t = theta @ self.fmap.omega + self.fmap.xi
        d = self.fmap.c_norm * self.fmap.f.grad(t) * self.ignored  # (k, m)
        return (d.conj() * g.T).real @ self.fmap.omega.T

    def start(self, rng):
        return rng.uniform(self.lo, self.hi)


class Gaussians(Atoms):
    """Gaussians: means, then variances (``diag``) or the lower triangle of a Cholesky factor (``full``)."""

    def __init__(self, fmap: FeatureMap, bounds: np.ndarray, cov: str = "diag", start_variance: float | None = None, ignored: np.ndarray | complex = 1.0):
        if fmap.f.name != "complexexponential":
            raise ValueError("Gaussian atoms need the complex exponential")
        if cov not in ("diag", "full"):
            raise ValueError("cov is diag or full")
        self.fmap, self.cov, self.d = fmap, cov, fmap.d
        self.ignored = np.broadcast_to(np.asarray(ignored, complex), (fmap.m,))
        low, high = np.asarray(bounds, float)
        self.span = high - low
        self.start_variance = start_variance
        if cov == "diag":
            self.lo = np.concatenate((low, 1e-8 * self.span**2))
            self.hi = np.concatenate((high, 0.25 * self.span**2))
        else:
            self.rows, self.cols = np.tril_indices(self.d)
            s = 0.5 * self.span.max()
            self.lo = np.concatenate((low, np.where(self.rows == self.cols, 1e-4 * self.span[self.rows], -s)))
            self.hi = np.concatenate((high, np.full(len(self.rows), s)))
        self.size = len(self.lo)

    def factor(self, theta: np.ndarray) -> np.ndarray:
        out = np.zeros((self.d, self.d))
        out[self.rows, self.cols] = theta[self.d :]
        return out

    def sketch(self, theta):
        mu, s = theta[:, : self.d], theta[:, self.d :]
        w = self.fmap.omega
        if self.cov == "diag":
            quad = s @ w**2
        else:
            quad = np.stack([((self.factor(t).T @ w) ** 2).sum(0) for t in theta]) if len(theta) else np.zeros((0, w.shape[1]))
        return (self.fmap.c_norm * np.exp(1j * (mu @ w + self.fmap.xi) - quad / 2) * self.ignored).T

    def pull(self, theta, a, g):
        w = self.fmap.omega
        c = (a.conj() * g).T  # (k, m)
        mean = (-1j * c).real @ w.T  # d a / d mu = i w a
        if self.cov == "diag":
            return np.concatenate((mean, c.real @ (-(w**2) / 2).T), 1)
        rest = []
        for t, ck in zip(theta, c.real, strict=True):  # d quad / d L_ij = 2 w_i (L^T w)_j
            lw = self.factor(t).T @ w
            rest.append(-((ck * w) @ lw.T)[self.rows, self.cols])
        return np.concatenate((mean, np.array(rest).reshape(len(theta), -1)), 1)

    def start(self, rng):
        mu = rng.uniform(self.lo[: self.d], self.hi[: self.d])
        v = np.full(self.d, self.start_variance) if self.start_variance else (10 ** rng.uniform(-1.5, -0.3, self.d) * self.span / 2) ** 2
        if self.cov == "diag":
            return np.concatenate((mu, np.clip(v, self.lo[self.d :], self.hi[self.d :])))
        return np.concatenate((mu, np.diag(np.sqrt(v))[self.rows, self.cols]))

    def mixture(self, sol: Solution) -> Mixture:
        covs = [np.diag(t[self.d :]) if self.cov == "diag" else self.factor(t) @ self.factor(t).T for t in sol.theta]
        return Mixture(sol.weights, sol.theta[:, : self.d], np.array(covs))

    def parameters(self, mix: Mixture) -> np.ndarray:
        """The atoms of a mixture, e.g. to start from."""
        rest = [np.diag(c) if self.cov == "diag" else cholesky(feasible(c))[self.rows, self.cols] for c in mix.covs]
        return np.clip(np.concatenate((mix.means, np.array(rest)), 1), self.lo, self.hi)


def feasible(cov: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """A symmetric matrix with eigenvalues of at least ``least``, by shifting all of them if need be."""
    cov = (cov + cov.T) / 2
    low = np.linalg.eigvalsh(cov)[0]
    return cov if low >= least else cov + (least - low) * np.eye(len(cov))


def split_mixture(mix: Mixture) -> Mixture:
    """Each component as two of half its weight, one standard deviation either way along its leading axis."""
    steps = []
    for c in mix.covs:
        lam, v = np.linalg.eigh(c)
        steps.append(np.sqrt(max(lam[-1], 0.0)) * v[:, -1])
    d = np.array(steps)
    return Mixture(np.concatenate((mix.weights, mix.weights)) / 2, np.vstack((mix.means + d, mix.means - d)), np.concatenate((mix.covs, mix.covs)))


class Pursuit:
    """Orthogonal matching pursuit with replacement over a family of atoms."""

    def __init__(self, atoms: Atoms, z: np.ndarray | None, k: int, ftol: float = 1e-6):
        """``z`` may be None until ``with_sketch`` gives it."""
        self.atoms, self.z, self.k, self.ftol = atoms, None if z is None else np.asarray(z, complex), k, ftol

    def with_sketch(self, z: np.ndarray, weight: float = 1.0) -> Pursuit:
        """The same solver for another sketch, times a weight (e.g. to undo another scale of its features)."""
        return type(self)(self.atoms, weight * np.asarray(z), self.k, self.ftol)

    def best_atom(self, residual: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The parameters that maximise the correlation of a normed atom with the residual, from a start."""

        def fun(t):
            theta = t[None, :]
            a = self.atoms.sketch(theta)
            size = max(np.linalg.norm(a), 1e-12)
            c = float((a[:, 0].conj() @ residual).real)
            g = residual[:, None] / size - c * a / size**3
            return -c / size, -self.atoms.pull(theta, a, g)[0]

        return minimize_bounded(fun, start, self.atoms.lo, self.atoms.hi, ftol=1e-8)[0]

    def weights(self, a: np.ndarray, normed: bool = False) -> np.ndarray:
        size = np.maximum(np.linalg.norm(a, axis=0), 1e-12) if normed else 1.0
        return nnls(_real(a / size), _real(self.z))

    def refine(self, theta: np.ndarray, alpha: np.ndarray, ftol: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Descend in all parameters and weights at once."""
        k = len(theta)
        lo = np.concatenate((np.tile(self.atoms.lo, k), np.full(k, LEAST_WEIGHT)))
        hi = np.concatenate((np.tile(self.atoms.hi, k), np.full(k, MOST_WEIGHT)))

        def fun(p):
            th, al = p[:-k].reshape(k, -1), p[-k:]
            a = self.atoms.sketch(th)
            r = a @ al - self.z
            g = self.atoms.pull(th, a, 2 * r[:, None] * al)
            return float((np.abs(r) ** 2).sum()), np.concatenate((g.ravel(), 2 * (a.conj().T @ r).real))

        p, cost = minimize_bounded(fun, np.concatenate((theta.ravel(), alpha)), lo, hi, ftol=ftol)
        return p[:-k].reshape(k, -1), p[-k:], cost

    def fit(self, seed: int = 0, iterations: int | None = None, tries: int = 3, start: Solution | None = None) -> Solution:
        """2k rounds: add an atom, drop the weakest beyond k, set weights, refine; then a finer refinement."""
        if self.z is None:
            raise ValueError("there is no sketch yet")
        rng = np.random.default_rng(seed)
        theta = start.theta if start else np.zeros((0, self.atoms.size))
        residual = self.z - (self.atoms.sketch(theta) @ start.alpha if start else 0)
        alpha = start.alpha if start else np.zeros(0)
        history = []
        for _ in range(2 * self.k if iterations is None else iterations):
            found = [self.best_atom(residual, self.atoms.start(rng)) for _ in range(tries)]
            gain = [float((a.conj() @ residual).real) / max(np.linalg.norm(a), 1e-12) for a in self.atoms.sketch(np.array(found)).T]
            theta = np.vstack((theta, found[int(np.argmax(gain))]))
            fresh = True
            if len(theta) > self.k:
                drop = int(np.argmin(self.weights(self.atoms.sketch(theta), normed=True)))
                fresh = drop != len(theta) - 1
                theta = np.delete(theta, drop, 0)
            alpha = self.weights(self.atoms.sketch(theta))
            if fresh:
                theta, alpha, _ = self.refine(theta, alpha, self.ftol)
            residual = self.z - self.atoms.sketch(theta) @ alpha
            history.append(float((np.abs(residual) ** 2).sum()))
        theta, alpha, cost = self.refine(theta, alpha, self.ftol * 0.02)
        return Solution(alpha, theta, cost, tuple(history))

    def fit_best(self, runs: int, seed: int = 0, **params) -> Solution:
        return min((self.fit(seed + r, **params) for r in range(runs)), key=lambda s: s.cost)


class Splitting(Pursuit):
    """Hierarchical splitting of Gaussians along their widest direction, ceil(log2 k) times, then pruning to k."""

    def split(self, theta: np.ndarray) -> np.ndarray:
        """Two atoms for each: one standard deviation either way along the largest variance."""
        d, left, right = self.atoms.d, theta.copy(), theta.copy()
        for i, t in enumerate(theta):
            if self.atoms.cov == "diag":
                j = int(np.argmax(t[d:]))
                step = np.zeros(d)
                step[j] = np.sqrt(t[d + j])
            else:
                lam, v = np.linalg.eigh(self.atoms.factor(t) @ self.atoms.factor(t).T)
                step = np.sqrt(max(lam[-1], 0)) * v[:, -1]
            left[i, :d] -= step
            right[i, :d] += step
        return np.clip(np.vstack((left, right)), self.atoms.lo, self.atoms.hi)

    def fit(self, seed: int = 0, tries: int = 3, **_) -> Solution:
        first = Pursuit(self.atoms, self.z, 1, self.ftol).fit(seed, iterations=1, tries=tries)
        theta, alpha, history = first.theta, first.alpha, [first.cost]
        while len(theta) < self.k:
            theta = self.split(theta)
            theta, alpha, cost = self.refine(theta, self.weights(self.atoms.sketch(theta)), self.ftol)
            if len(theta) > self.k:
                keep = np.sort(np.argsort(-self.weights(self.atoms.sketch(theta), normed=True), kind="stable")[: self.k])
                theta = theta[keep]
                theta, alpha, cost = self.refine(theta, self.weights(self.atoms.sketch(theta)), self.ftol)
            history.append(cost)
        theta, alpha, cost = self.refine(theta, alpha, self.ftol * 0.02)
        return Solution(alpha, theta, cost, tuple(history))


def restrict(fmap: FeatureMap, dims: list[int] | None, box: np.ndarray | None, categories=None) -> tuple[FeatureMap, np.ndarray | complex]:
    """The map on ``dims`` only, and the factor that the other dimensions, uniform on their box, put on every atom."""
    if dims is None:
        return fmap, 1.0
    others = [i for i in range(fmap.d) if i not in dims]
    rest = FeatureMap.of(fmap.f, fmap.omega, None, 1.0)
    factor = box_sketch(np.asarray(box, float).T if box is not None else np.zeros((fmap.d, 2)), rest, categories, others) if others else 1.0
    return FeatureMap(fmap.f, fmap.omega[dims], fmap.xi, fmap.c_norm), factor


def kmeans_from_sketch(z, fmap: FeatureMap, k: int, bounds, runs: int = 1, seed: int = 0, dims=None, categories=None) -> Solution:
    """Centroids (theta) and weights. ``bounds`` is (2, d)."""
    sub, factor = restrict(fmap, dims, bounds, categories)
    b = np.asarray(bounds, float)[:, dims] if dims is not None else bounds
    return Pursuit(Points(sub, b, factor), z, k).fit_best(runs, seed)


def mixture_from_sketch(z, fmap: FeatureMap, k: int, bounds, cov: str = "diag", method: str = "pursuit", runs: int = 1, seed: int = 0, start_variance: float | str | None = None, dims=None, categories=None) -> tuple[Mixture, Solution]:
    """A Gaussian mixture by pursuit or by splitting.

    New components start with ``start_variance``: a number, ``sketch`` (what the envelope of the sketch says), or at
    random within the bounds.
    """
    if start_variance == "sketch":
        from tessera.operators.scale import variances_from_sketch

        start_variance = float(variances_from_sketch(np.asarray(z), fmap, 1, max(2, min(25, fmap.m // 5)))[1][0])
    solver = {"pursuit": Pursuit, "splitting": Splitting}[method]
    sub, factor = restrict(fmap, dims, bounds, categories)
    b = np.asarray(bounds, float)[:, dims] if dims is not None else bounds
    atoms = Gaussians(sub, b, cov, start_variance, factor)
    sol = solver(atoms, z, k).fit_best(runs, seed)
    return atoms.mixture(sol), sol


def fit_restarts(spark: SparkSession, solver: Callable[[], Pursuit], runs: int, seed: int = 0) -> DataFrame:
    """Restarts as tasks: run, cost, alpha, theta of each; order by cost for the best."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for r in b["id"]:
                s = solver().fit(seed + int(r))
                out.append((int(r), s.cost, s.alpha.tolist(), s.theta.tolist()))
            yield pd.DataFrame(out, columns=["run", "cost", "alpha", "theta"])

    return spark.range(0, runs, 1, runs).mapInPandas(run, "run long, cost double, alpha array<double>, theta array<array<double>>")
