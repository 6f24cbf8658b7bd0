"""Periodic nonlinearities of a sketch: one or two real parts each, as NumPy functions, Spark columns and SQL text.

``%`` and ``//`` are floored in NumPy but truncated in Spark, so columns use floor only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * np.pi


@dataclass(frozen=True)
class Wave:
    """A function of t. ``sql`` holds the real part and, for a complex one, the imaginary part, with {t} for t."""

    name: str
    call: Callable[[np.ndarray], np.ndarray]
    sql: tuple[str, ...]
    grad: Callable[[np.ndarray], np.ndarray] | None = None
    split: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None  # real and imaginary part, if that is faster

    def parts(self, t: np.ndarray) -> list[np.ndarray]:
        """The real part and, for a complex wave, the imaginary part."""
        if self.split:
            return list(self.split(t))
        y = self.call(t)
        return [y.real, y.imag] if self.is_complex else [np.asarray(y, float)]

    @property
    def is_complex(self) -> bool:
        return len(self.sql) == 2

    def columns(self, t: str) -> list[Column]:
        return [F.expr(s.format(t=f"({t})")) for s in self.sql]


def _square(t, width=np.pi, centred=True):
    cell = np.floor(t / width) % 2
    return 2 * cell - 1 if centred else cell


def _square_sql(shift: float, width: float, centred: bool) -> str:
    cell = f"(floor(({{t}} - {shift!r}) / {width!r}) - 2.0 * floor(floor(({{t}} - {shift!r}) / {width!r}) / 2.0))"
    return f"(2.0 * {cell} - 1.0)" if centred else cell


def _saw(t, period=TWO_PI, centred=True):
    x = t / period
    x = x - np.floor(x)
    return 2 * x - 1 if centred else x


def _saw_sql(shift: float, period: float, centred: bool) -> str:
    x = f"(({{t}} - {shift!r}) / {period!r} - floor(({{t}} - {shift!r}) / {period!r}))"
    return f"(2.0 * {x} - 1.0)" if centred else x


def complex_exponential(period: float = TWO_PI) -> Wave:
    k = TWO_PI / period
    arg = "{t}" if k == 1 else f"({k!r} * {{t}})"
    return Wave("complexexponential", lambda t: np.exp(1j * k * t), (f"cos({arg})", f"sin({arg})"), lambda t: 1j * k * np.exp(1j * k * t), lambda t: (np.cos(k * t), np.sin(k * t)))


def cosine() -> Wave:
    return Wave("cosine", np.cos, ("cos({t})",), lambda t: -np.sin(t))


def universal_quantization(width: float = np.pi, centred: bool = True) -> Wave:
    return Wave("universalquantization", lambda t: _square(t, width, centred), (_square_sql(0.0, width, centred),))


def universal_quantization_complex(width: float = np.pi, centred: bool = True) -> Wave:
    return Wave("universalquantization_complex", lambda t: _square(t - width / 2, width, centred) + 1j * _square(t - width, width, centred), (_square_sql(width / 2, width, centred), _square_sql(width, width, centred)))


def sawtooth(period: float = TWO_PI, centred: bool = True) -> Wave:
    return Wave("sawtooth", lambda t: _saw(t, period, centred), (_saw_sql(0.0, period, centred),))


def sawtooth_complex(period: float = TWO_PI, centred: bool = True) -> Wave:
    return Wave("sawtooth_complex", lambda t: _saw(t - period / 4, period, centred) + 1j * _saw(t - period / 2, period, centred), (_saw_sql(period / 4, period, centred), _saw_sql(period / 2, period, centred)))


def triangle(period: float = TWO_PI) -> Wave:
    """Up from -1 to 1 over one ``period`` and down over the next: 1 - 2 |distance from the peak|, repeating after two."""

    def call(t):
        x = t / (2 * period)
        return 1 - 4 * np.abs(x - np.floor(x) - 0.5)

    x = f"({{t}} / {2 * period!r})"
    return Wave("trianglewave", call, (f"(1.0 - 4.0 * abs({x} - floor({x}) - 0.5))",))


def fourier_series(coefficients: Sequence[complex], period: float = TWO_PI) -> Wave:
    """The sum of F_k exp(2 pi i k t / period); coefficients run from F_-K to F_K."""
    c = np.asarray(coefficients, complex)
    if len(c) % 2 == 0:
        raise ValueError("an odd number of coefficients is needed: F_-K .. F_K")
    ks = np.arange(len(c)) - len(c) // 2
    w = TWO_PI * ks / period

    def call(t):
        t = np.asarray(t, float)
        return np.tensordot(np.exp(1j * np.multiply.outer(t, w)), c, 1)

    def grad(t):
        return np.tensordot(np.exp(1j * np.multiply.outer(np.asarray(t, float), w)), 1j * w * c, 1)

    def side(a: Callable[[complex], float], b: Callable[[complex], float]) -> str:
        return "(" + " + ".join(f"({a(x)!r} * cos({float(k)!r} * {{t}}) + {b(x)!r} * sin({float(k)!r} * {{t}}))" for x, k in zip(c, w, strict=True)) + ")"

    return Wave("fourierseries", call, (side(lambda x: float(x.real), lambda x: float(-x.imag)), side(lambda x: float(x.imag), lambda x: float(x.real))), grad)


WAVES: dict[str, Callable[[], Wave]] = {
    "complexexponential": complex_exponential,
    "universalquantization": universal_quantization,
    "universalquantization_complex": universal_quantization_complex,
    "sawtooth": sawtooth,
    "sawtooth_complex": sawtooth_complex,
    "cosine": cosine,
    "trianglewave": triangle,
}


def wave(f: str | Wave | Callable | tuple) -> Wave:
    """A wave by name (in any case), or from a NumPy function or a pair of it and its derivative (Arrow backend only)."""
    if isinstance(f, Wave):
        return f
    if isinstance(f, str):
        if f.lower() not in WAVES:
            raise NotImplementedError(f"no nonlinearity named {f!r}")
        return WAVES[f.lower()]()
    if callable(f):
        f = (f, None)
    if not (isinstance(f, tuple) and len(f) == 2 and callable(f[0]) and (f[1] is None or callable(f[1]))):
        raise ValueError("a nonlinearity is a name, a function, or a pair of a function and its derivative")
    probe = np.asarray(f[0](np.zeros(1)))
    return Wave("user", f[0], ("{t}", "{t}") if np.iscomplexobj(probe) else ("{t}",), f[1])
