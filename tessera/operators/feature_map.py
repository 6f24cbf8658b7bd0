"""The feature map of a sketch: c_norm * f(omega^T x + xi)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.waves import Wave, wave


@dataclass(frozen=True)
class FeatureMap:
    """``f``: a Wave; ``omega`` (d, m); ``xi`` (m,); ``c_norm`` a number."""

    f: Wave
    omega: np.ndarray
    xi: np.ndarray
    c_norm: float

    @classmethod
    def of(cls, f, omega, xi=None, c_norm: float | str = 1.0) -> FeatureMap:
        """``c_norm`` may be ``unit`` or ``normalized``: 1 / sqrt(m)."""
        omega = np.asarray(omega, float)
        if omega.ndim != 2:
            raise ValueError("omega is a (d, m) matrix")
        m = omega.shape[1]
        xi = np.zeros(m) if xi is None else np.asarray(xi, float)
        if xi.shape != (m,):
            raise ValueError("xi has an entry per frequency")
        if isinstance(c_norm, str):
            if c_norm.lower() not in ("unit", "normalized"):
                raise NotImplementedError(f"no normalisation named {c_norm!r}")
            c_norm = 1 / np.sqrt(m)
        return cls(wave(f), omega, xi, float(c_norm))

    @property
    def d(self) -> int:
        return self.omega.shape[0]

    @property
    def m(self) -> int:
        return self.omega.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features of one example (d,) or of rows (n, d)."""
        return self.c_norm * self.f.call(np.asarray(x, float) @ self.omega + self.xi)

    def grad(self, x: np.ndarray) -> np.ndarray:
        """The (d, m) derivatives at one example."""
        if self.f.grad is None:
            raise TypeError(f"{self.f.name} has no derivative")
        return self.c_norm * self.omega * self.f.grad(np.asarray(x, float) @ self.omega + self.xi)

    def with_wave(self, f, c_norm: float | None = None) -> FeatureMap:
        """The same frequencies under another nonlinearity, e.g. to decode a quantised sketch by its first harmonic."""
        return FeatureMap(wave(f), self.omega, self.xi, self.c_norm if c_norm is None else c_norm)

    def phase_sql(self, cols: list[str], j: int) -> str:
        return " + ".join([f"{float(w)!r} * {c}" for w, c in zip(self.omega[:, j], cols, strict=True)] + [repr(float(self.xi[j]))])

    def features(self, df: DataFrame, cols: list[str], prefix: str = "f") -> DataFrame:
        """``df`` with a column per part of each feature (for few frequencies): prefix, number, _re or _im."""
        names = ("_re", "_im") if self.f.is_complex else ("_re",)
        return df.select("*", *[(self.c_norm * c).alias(f"{prefix}{j}{s}") for j in range(self.m) for c, s in zip(self.f.columns(self.phase_sql(cols, j)), names, strict=True)])
