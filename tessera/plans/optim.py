"""Small dense optimisation in NumPy: bounded L-BFGS, non-negative and bounded least squares, the simplex projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimize_bounded(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, lo: np.ndarray, hi: np.ndarray, ftol: float = 1e-9, gtol: float = 1e-7, most: int = 300, memory: int = 10) -> tuple[np.ndarray, float]:
    """Projected L-BFGS: two-loop directions over the variables that are free, Armijo steps along the projected path.

    ``fun`` gives value and gradient. Returns the last point and its value; every step lowers the value.
    """
    clip = lambda x: np.minimum(np.maximum(x, lo), hi)
    x = clip(np.asarray(x0, float))
    f, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if np.abs(clip(x - g) - x).max(initial=0) <= gtol:
            break
        q = np.where(free, g, 0.0)
        used = []
        for s, y in reversed(pairs):
            sf, yf = np.where(free, s, 0), np.where(free, y, 0)
            sy = sf @ yf
            if sy <= 1e-14 * np.linalg.norm(sf) * np.linalg.norm(yf):
                continue
            a = sf @ q / sy
            q = q - a * yf
            used.append((sf, yf, sy, a))
        if used:
            q = q * (used[0][2] / (used[0][1] @ used[0][1]))
        for sf, yf, sy, a in reversed(used):
            q = q + sf * (a - yf @ q / sy)
        d = -np.where(free, q, 0.0)
        if g @ d >= 0:
            d, used = -np.where(free, g, 0.0), []
        step = 1.0 if used else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-300))
        for _ in range(40):
            new = clip(x + step * d)
            fn, gn = fun(new)
            if fn <= f + 1e-4 * (g @ (new - x)) and np.isfinite(fn):
                break
            step *= 0.5
        else:
            if not pairs:
                break
            pairs = []
            continue
        s, y = new - x, gn - g
        gain = f - fn
        x, f, g = new, fn, gn
        if s @ y > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-memory + 1 :], (s, y)]
        if gain <= ftol * max(abs(f), abs(f + gain), 1e-300):
            break
    return x, f


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Non-negative least squares by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    tol = 1e-12 * max(1.0, np.abs(w).max(initial=0))
    for _ in range(most or 3 * n + 10):
        if passive.all() or w[~passive].max() <= tol:
            break
        passive[np.flatnonzero(~passive)[np.argmax(w[~passive])]] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                break
            low = passive & (z <= 0)
            t = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + t * (z - x)
            passive &= x > 1e-14
            x[~passive] = 0
            if not passive.any():
                break
        x = np.where(passive, z, 0.0) if passive.any() else np.zeros(n)
        w = a.T @ (b - a @ x)
    return x


def bounded_lsq(a: np.ndarray, b: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Least squares with lo <= x <= hi."""
    n = a.shape[1]
    scale = max(np.linalg.norm(a, 2) ** 2, 1e-300)

    def fun(x):
        r = a @ x - b
        return float(r @ r) / scale, 2 * (a.T @ r) / scale

    return minimize_bounded(fun, np.full(n, np.clip(1 / n, lo, hi)), np.full(n, lo), np.full(n, hi), ftol=1e-15, gtol=1e-12, most=3000)[0]


def simplex_projection(h: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that add up to 1."""
    s = np.sort(h)[::-1]
    shift = (1 - np.cumsum(s)) / np.arange(1, len(h) + 1)
    return np.maximum(h + shift[np.flatnonzero(s + shift > 0)[-1]], 0)
