"""Registered queries of learning, laws and noise, whose outcome SQL can tell.

Rows of ``orders`` become points around planted centres: the key says which centre, and a low-discrepancy sequence of
the key gives normal deviates, the same in both engines. A query learns from a sketch of the points; SQL has the
planted groups' own means, deviations and shares. Both are rounded to the digits that a sketch of this size gives, and
the planted values lie in the middle of a rounding interval. Random draws are held against their laws the same way.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import density, waves
from tessera.operators import histogram, mixtures, privacy, scale, solvers
from tessera.operators.feature_map import FeatureMap
from tessera.operators.sketch import merge, rollup, sketch, sketch_callable, to_vector
from tessera.plans import optim
from tessera.queries import MIX2, OMEGA, SCALED, XI, X, _FEATURES, _PHASE, _freq_sql, _lineitem, _parts, _r, _rounded, _sketch_sql, register
from tessera.sources import datasets, frequencies
from tessera.sources.datasets import Mixture
from tessera.streaming.sketch import session_sketch

#: Centres by the last digit of a key (a digit below the first number), and deviations along both axes.
CENTRES = [(4, 0.1, 0.3), (7, 0.9, 0.7), (9, 0.4, 0.9), (10, 0.6, 0.1)]
SPREAD, TILT = (0.06, 0.03), 0.04  # the tilt: how much of the first deviate is in the second coordinate
_SEQUENCES = (0.7548776662466927, 0.5698402909980532)
_DEVIATES = "SELECT o_orderkey, o_orderkey % 10 AS digit, " + ", ".join(f"o_orderkey * {a!r}e0 - floor(o_orderkey * {a!r}e0) AS u{i}" for i, a in enumerate(_SEQUENCES)) + " FROM orders"
_NORMAL = f"SELECT *, sqrt(-2e0 * ln(greatest(u0, 1e-9))) * cos({2 * math.pi!r}e0 * u1) AS z0, sqrt(-2e0 * ln(greatest(u0, 1e-9))) * sin({2 * math.pi!r}e0 * u1) AS z1 FROM ({_DEVIATES}) d"


def _centre(axis: int) -> str:
    return "CASE " + " ".join(f"WHEN digit < {c[0]} THEN {c[1 + axis]!r}e0" for c in CENTRES) + " END"


_POINTS = f"SELECT o_orderkey, {_centre(0)} AS m0, {_centre(1)} + 0e0 * z0 AS m1, {_centre(0)} + {SPREAD[0]!r}e0 * z0 AS x0, {_centre(1)} + {SPREAD[1]!r}e0 * z1 AS x1, {_centre(1)} + {TILT!r}e0 * z0 + {SPREAD[1]!r}e0 * z1 AS t1, u1 AS free, z0, z1, digit FROM ({_NORMAL}) n"
BOUNDS = np.array([[-0.2, -0.2], [1.2, 1.2]])


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(_POINTS)


def _learned(df: DataFrame, cols: list[str], m: int, law: str, sigma: float, f="ComplexExponential", xi=None, d: int = 2) -> tuple[np.ndarray, FeatureMap]:
    fmap = FeatureMap.of(f, frequencies.draw(law, d, m, sigma, seed=50), xi)
    return to_vector(sketch(df, fmap, cols))[0], fmap


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


def _one(x: float, digits: int = 1) -> float:
    return round(float(x), digits) + 0.0


# ---------------------------------------------------------------- k-means from a sketch
_KMEANS_SQL = f"SELECT round(avg(x0), 1) + 0e0 AS c0, round(avg(x1), 1) + 0e0 AS c1, round(count(*) / sum(count(*)) OVER (), 1) AS weight FROM ({_POINTS}) p GROUP BY m0"
_KMEANS = "c0 double, c1 double, weight double"


def _centroids(spark: SparkSession, sol: solvers.Solution) -> DataFrame:
    return _rows(spark, [(_one(c[0]), _one(c[1]), _one(w)) for w, c in zip(sol.weights, sol.theta, strict=True)], _KMEANS)


@register("ckm", _KMEANS_SQL)
def ckm(spark, sf_dir):
    z, fmap = _learned(_points(spark, sf_dir), ["x0", "x1"], 120, "ARKM", 0.01)
    return _centroids(spark, solvers.kmeans_from_sketch(z, fmap, 4, BOUNDS, runs=4, seed=1))


@register("ckm_restarts", _KMEANS_SQL)
def ckm_restarts(spark, sf_dir):
    """Restarts as tasks; the one of least cost."""
    z, fmap = _learned(_points(spark, sf_dir), ["x0", "x1"], 120, "ARKM", 0.01)
    best = solvers.fit_restarts(spark, lambda: solvers.Pursuit(solvers.Points(fmap, BOUNDS), z, 4), 4, seed=1).orderBy("cost", "run").first()
    alpha = np.array(best["alpha"])
    return _rows(spark, [(_one(c[0]), _one(c[1]), _one(a)) for a, c in zip(alpha / alpha.sum(), best["theta"], strict=True)], _KMEANS)


@register("quantized_ckm", _KMEANS_SQL)
def quantized_ckm(spark, sf_dir):
    """Acquired by two bits per frequency, decoded by the first harmonic of the square wave."""
    z, fmap = _learned(_points(spark, sf_dir), ["x0", "x1"], 300, "ARKM", 0.01, "universalQuantization_complex", frequencies.dither(300, seed=51))
    return _centroids(spark, solvers.kmeans_from_sketch(z, fmap.with_wave("ComplexExponential", 4 / math.pi), 4, BOUNDS, runs=4, seed=1))


@register("ckm_dims", f"SELECT round(avg(x0), 1) + 0e0 AS c0, round(count(*) / sum(count(*)) OVER (), 1) AS weight FROM ({_POINTS}) p GROUP BY m0")
def ckm_dims(spark, sf_dir):
    """Centroids of one dimension from a sketch of two, the other uniform on its box."""
    z, fmap = _learned(_points(spark, sf_dir), ["x0", "free"], 200, "ARKM", 0.01)
    sol = solvers.kmeans_from_sketch(z, fmap, 4, np.array([[-0.2, 0.0], [1.2, 1.0]]), runs=4, seed=1, dims=[0])
    return _rows(spark, [(_one(c[0]), _one(w)) for w, c in zip(sol.weights, sol.theta, strict=True)], "c0 double, weight double")


@register("sse_of_ckm", f"WITH c AS (SELECT avg(x0) AS a, avg(x1) AS b FROM ({_POINTS}) p GROUP BY m0), d AS (SELECT min((x0 - a) ** 2 + (x1 - b) ** 2) AS d FROM ({_POINTS}) p CROSS JOIN c GROUP BY o_orderkey) SELECT round(sum(d) / count(*), 3) AS sse_per_row FROM d")
def sse_of_ckm(spark, sf_dir):
    """What the learned centroids cost on the rows themselves, against the planted groups' own means."""
    df = _points(spark, sf_dir)
    z, fmap = _learned(df, ["x0", "x1"], 120, "ARKM", 0.01)
    sol = solvers.kmeans_from_sketch(z, fmap, 4, BOUNDS, runs=4, seed=1)
    return _rows(spark, [(_one(mixtures.sse(df, sol.theta, ["x0", "x1"]) / df.count(), 3),)], "sse_per_row double")


# ---------------------------------------------------------------- mixtures from a sketch
_DIAG_SQL = f"SELECT round(avg(x0), 1) + 0e0 AS c0, round(avg(x1), 1) + 0e0 AS c1, round(count(*) / sum(count(*)) OVER (), 1) AS weight, round(stddev_pop(x0), 2) AS s0, round(stddev_pop(x1), 2) AS s1 FROM ({_POINTS}) p GROUP BY m0"
_FULL_SQL = f"SELECT round(avg(x0), 1) + 0e0 AS c0, round(avg(t1), 1) + 0e0 AS c1, round(count(*) / sum(count(*)) OVER (), 1) AS weight, round(stddev_pop(x0), 2) AS s0, round(stddev_pop(t1), 2) AS s1, round(corr(x0, t1), 1) AS rho FROM ({_POINTS}) p GROUP BY m0"


def _mixture(spark: SparkSession, mix: Mixture) -> DataFrame:
    full = any(abs(c[0, 1]) > 1e-9 for c in mix.covs)
    rows = []
    for w, m, c in zip(mix.weights, mix.means, mix.covs, strict=True):
        s = np.sqrt(np.diag(c))
        rows.append((_one(m[0]), _one(m[1]), _one(w), _one(s[0], 2), _one(s[1], 2), *([_one(c[0, 1] / s[0] / s[1])] if full else [])))
    return _rows(spark, rows, "c0 double, c1 double, weight double, s0 double, s1 double" + ", rho double" * full)


def _learn_mixture(second: str, points: str = _POINTS, k: int = 4, sigma: float = 0.004, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _points(spark, sf_dir)
        z, fmap = _learned(spark.sql(points), ["x0", second], 240, "AR", sigma)
        return _mixture(spark, solvers.mixture_from_sketch(z, fmap, k, BOUNDS, runs=3, seed=1, **params)[0])

    return run


#: Two neighbouring groups: splitting begins with one component for all, and stops at a poorer optimum than pursuit
#: where groups are far apart. EM has two of the four groups for the same reason.
_NEAR = f"SELECT m0, m0 + {SPREAD[0]!r}e0 * z0 AS x0, 0.5e0 + {SPREAD[1]!r}e0 * z1 AS x1, 0.5e0 + {TILT!r}e0 * z0 + {SPREAD[1]!r}e0 * z1 AS t1 FROM (SELECT *, CASE WHEN digit < 6 THEN 0.4e0 ELSE 0.6e0 END AS m0 FROM ({_NORMAL}) n) g"
_TWO = "m0 IN (0.1e0, 0.9e0)"
register("clomp_gmm", _DIAG_SQL)(_learn_mixture("x1"))
register("clhs_gmm", _DIAG_SQL.replace(_POINTS, _NEAR))(_learn_mixture("x1", _NEAR, 2, 0.01, method="splitting"))
register("gmm_full", _FULL_SQL)(_learn_mixture("t1", cov="full"))
register("clhs_full", _FULL_SQL.replace(_POINTS, _NEAR))(_learn_mixture("t1", _NEAR, 2, 0.01, cov="full", method="splitting"))


@register("em_gmm", _FULL_SQL.replace("GROUP BY", f"WHERE {_TWO} GROUP BY"))
def em_gmm(spark, sf_dir):
    return _mixture(spark, mixtures.em(_points(spark, sf_dir).filter(_TWO), 2, ["x0", "t1"], runs=4, seed=1)[0])


@register("pursuit_trace", "SELECT * FROM (VALUES ('atoms', 4e0), ('rounds', 8e0), ('cost falls', 1e0), ('cost is that of the solution', 1e0), ('sketch of the solution', 1e0), ('start is kept', 1e0), ('weights', 1e0)) v(what, value)")
def pursuit_trace(spark, sf_dir):
    """A solver's state: rounds, the fall of its cost after the last atom is in, and its solution's sketch."""
    z, fmap = _learned(_points(spark, sf_dir), ["x0", "x1"], 120, "ARKM", 0.01)
    solver = solvers.Pursuit(solvers.Points(fmap, BOUNDS), z, 4)
    sol = solver.fit_best(4, seed=1)
    again = solver.fit(0, iterations=0, start=sol)
    own = solver.atoms.sketch(sol.theta) @ sol.alpha
    rows = [
        ("atoms", len(sol.theta)), ("rounds", len(sol.history)), ("cost falls", sol.history[-1] <= sol.history[0] and sol.cost <= sol.history[-1] + 1e-9), ("cost is that of the solution", abs((np.abs(own - z) ** 2).sum() - sol.cost) < 1e-9),
        ("sketch of the solution", np.allclose(own, (fmap(sol.theta).T * sol.alpha).sum(1))), ("start is kept", again.cost <= sol.cost + 1e-9), ("weights", sol.weights.sum()),
    ]
    return _rows(spark, [(k, _one(float(v), 6)) for k, v in rows], "what string, value double")


@register("mixture_split", "SELECT * FROM (VALUES (0, 0.25e0, 0.0e0, 3.0e0), (1, 0.25e0, 1.0e0, 1.5e0), (2, 0.25e0, 0.0e0, -1.0e0), (3, 0.25e0, 1.0e0, 0.5e0)) v(k, weight, mu0, mu1)")
def mixture_split(spark, sf_dir):
    """Components with deviations 2 and 0.5 along the second axis go that far either way."""
    mix = solvers.split_mixture(Mixture(np.array([0.5, 0.5]), np.array([[0.0, 1.0], [1.0, 1.0]]), np.array([np.diag([1.0, 4.0]), np.diag([0.01, 0.25])])))
    means = mix.means.copy()
    for k in (0, 1):  # which half goes up depends on the sign of an eigenvector
        if means[k][1] < means[k + 2][1]:
            means[[k, k + 2]] = means[[k + 2, k]]
    return _rows(spark, [(k, _one(w, 6), _one(m[0], 6), _one(m[1], 6)) for k, (w, m) in enumerate(zip(mix.weights, means, strict=True))], "k int, weight double, mu0 double, mu1 double")


# ---------------------------------------------------------------- optimisers
_LSQ = [(3.0, 1.0), (1.0, -2.0), (-2.0, 1.0), (-1.0, -1.0)]


@register(
    "nnls",
    f"WITH b(i, a, c) AS (VALUES {', '.join(f'({i}, {a!r}e0, {c!r}e0)' for i, (a, c) in enumerate(_LSQ))}) "
    # minimise (x + y - a)^2 + (x - y)^2 / 4 + (y - c)^2 over x, y >= 0: the free solution, or the better edge
    "SELECT i, round(CASE WHEN x >= 0 AND y >= 0 THEN x WHEN y < 0 THEN greatest(a / 1.25e0, 0) ELSE 0 END, 6) + 0e0 AS x, round(CASE WHEN x >= 0 AND y >= 0 THEN y WHEN y < 0 THEN 0 ELSE greatest((a + c) / 2.25e0, 0) END, 6) + 0e0 AS y "
    "FROM (SELECT *, (2.25e0 * a - 0.75e0 * (a + c)) / (1.25e0 * 2.25e0 - 0.75e0 * 0.75e0) AS x, (1.25e0 * (a + c) - 0.75e0 * a) / (1.25e0 * 2.25e0 - 0.75e0 * 0.75e0) AS y FROM b) s",
)
def nnls(spark, sf_dir):
    a = np.array([[1.0, 1.0], [0.5, -0.5], [0.0, 1.0]])
    return _rows(spark, [(i, *(_one(v, 6) for v in optim.nnls(a, np.array([p, 0.0, q])))) for i, (p, q) in enumerate(_LSQ)], "i int, x double, y double")


@register("bounded_descent", "SELECT i, round(least(greatest(i * 0.3e0 - 1, -0.5e0), 0.8e0), 4) + 0e0 AS x, round(least(greatest(2 - i * 0.4e0, -0.5e0), 0.8e0), 4) + 0e0 AS y FROM range(10) t(i)")
def bounded_descent(spark, sf_dir):
    """A separable bowl within a box: each coordinate is clamped."""
    out = []
    for i in range(10):
        goal, size = np.array([i * 0.3 - 1, 2 - i * 0.4]), np.array([1.0, 7.0])
        x, _ = optim.minimize_bounded(lambda p, g=goal, s=size: (float((s * (p - g) ** 2).sum()), 2 * s * (p - g)), np.zeros(2), np.full(2, -0.5), np.full(2, 0.8), ftol=1e-14)
        out.append((i, _one(x[0], 4), _one(x[1], 4)))
    return _rows(spark, out, "i long, x double, y double")


def _error(f, g, x: np.ndarray) -> float:
    """The largest difference of a derivative from a difference quotient."""
    h = 1e-6
    return max(abs((f(x + h * e) - f(x - h * e)) / (2 * h) - g(x)[i]) for i, e in enumerate(np.eye(len(x))))


@register("atom_derivatives", "SELECT * FROM (VALUES ('points', true), ('diag', true), ('full', true)) v(atoms, holds)")
def atom_derivatives(spark, sf_dir):
    """Derivatives of the correlation with a residual, against difference quotients."""
    fmap = FeatureMap.of("ComplexExponential", frequencies.draw("AR", 2, 30, 0.1, seed=9), frequencies.dither(30, seed=10))
    rng, out = np.random.default_rng(11), []
    g = rng.standard_normal(30) + 1j * rng.standard_normal(30)
    for name, atoms in (("points", solvers.Points(fmap, BOUNDS)), ("diag", solvers.Gaussians(fmap, BOUNDS)), ("full", solvers.Gaussians(fmap, BOUNDS, "full"))):
        f = lambda t, a=atoms: float((a.sketch(t[None])[:, 0].conj() @ g).real)
        d = lambda t, a=atoms: a.pull(t[None], a.sketch(t[None]), g[:, None])[0]
        out.append((name, bool(_error(f, d, atoms.start(rng)) < 1e-5)))
    return _rows(spark, out, "atoms string, holds boolean")


# ---------------------------------------------------------------- scale
@register("estimate_sigma", f"SELECT round(sqrt((var_pop(z0) + var_pop(z1)) / 2) / 10, 2) AS deviation FROM ({_POINTS}) p")
def estimate_sigma(spark, sf_dir):
    """The scale of one round cloud, whose deviation is a tenth."""
    df = _points(spark, sf_dir).selectExpr("z0 / 10 + 0.5 AS a", "z1 / 10 + 0.5 AS b")
    cov = scale.estimate_scale(df, ["a", "b"], 200, sample=1500, seed=2)
    return _rows(spark, [(_one(math.sqrt(cov[0, 0]), 2),)], "deviation double")


@register("scale_of_envelope", "SELECT * FROM (VALUES (0, 0.3e0, 0.5e0), (1, 0.7e0, 4.0e0)) v(k, weight, variance)")
def scale_of_envelope(spark, sf_dir):
    """Weights and variances back from the moduli that they give, by block extremes and bounded least squares."""
    r = np.linspace(0.05, 4, 100)
    size = 0.3 * np.exp(-(r**2) * 0.5 / 2) + 0.7 * np.exp(-(r**2) * 4 / 2)
    w, s = scale.fit_variances(*scale.block_extremes(r, size, 50), 2, np.array([0.5, 0.5]), np.array([0.3, 2.0]))
    order = np.argsort(s)
    return _rows(spark, [(k, _one(w[i], 2), _one(s[i], 1)) for k, i in enumerate(order)], "k int, weight double, variance double")


# ---------------------------------------------------------------- histograms
#: A density of four steps over [0, 1] with these shares.
_STEPPED = f"SELECT CASE WHEN u0 < 0.1e0 THEN u0 * 2.5e0 WHEN u0 < 0.5e0 THEN 0.25e0 + (u0 - 0.1e0) / 1.6e0 WHEN u0 < 0.7e0 THEN 0.5e0 + (u0 - 0.5e0) * 1.25e0 ELSE 0.75e0 + (u0 - 0.7e0) / 1.2e0 END AS x FROM ({_DEVIATES}) d"
_HIST_SQL = f"SELECT CAST(least(floor(x * 4), 3) AS INTEGER) AS bin, round(count(*) / sum(count(*)) OVER (), 1) + 0e0 AS p FROM ({_STEPPED}) h GROUP BY bin"


def _histogram(f, **params):
    """From a sketch, against the counted one, whose shares are 0.1, 0.4, 0.2 and 0.3."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
        fmap = FeatureMap.of("ComplexExponential", frequencies.draw("Gaussian", 1, 120, 0.002, seed=52))
        z, _ = to_vector(sketch(spark.sql(_STEPPED), fmap, ["x"]))
        return _rows(spark, [(b, _one(p)) for b, p in enumerate(f(z, fmap, np.array([[0.0, 1.0]]), 0, bins=4, **params))], "bin int, p double")

    return run


register("hist_mmd", _HIST_SQL)(_histogram(histogram.histogram_mmd))
register("hist_m2m", _HIST_SQL)(_histogram(histogram.histogram_m2m, ridge=1e-4))


# ---------------------------------------------------------------- laws
def _integral(power: int, p: str, top: str, n: int = 4000) -> str:
    """The moment of a radius's density by a sum over a grid."""
    return f"(SELECT sum(r ** {power} * ({p})) / sum({p}) FROM (SELECT i * {top} / {n} AS r FROM range(1, {n}) t(i)) g)"


_AR, _KM = "sqrt(r * r + r ** 4 / 4) * exp(-r * r / 2)", "r * exp(-r * r / 2)"
_DOG = "greatest(exp(-r * r / 8) - exp(-r * r / 2), 0)"


@register(
    "law_moments",
    "SELECT law, round(mean, 1) + 0e0 AS mean_radius, round(square, 1) + 0e0 AS mean_square, 0e0 AS drift FROM (VALUES "
    f"('gaussian', sqrt(pi() / 2), 2e0), ('folded', sqrt(2 / pi()), 1e0), ('adapted', {_integral(1, _AR, '5e0')}, {_integral(2, _AR, '5e0')}), ('kmeans', {_integral(1, _KM, '5e0')}, {_integral(2, _KM, '5e0')}), "
    f"('difference', {_integral(1, _DOG, '8e0')}, {_integral(2, _DOG, '8e0')})) v(law, mean, square)",
)
def law_moments(spark, sf_dir):
    """Mean radius, mean square and mean direction of 400,000 frequencies of each law in two dimensions."""
    n = 400_000
    draws = {
        "gaussian": frequencies.draw("G", 2, n, seed=1), "folded": frequencies.draw("FG", 2, n, seed=2), "adapted": frequencies.draw("AR", 2, n, seed=3), "kmeans": frequencies.draw("ARKM", 2, n, seed=4),
        "difference": frequencies.of_gaussian_difference(2, n, 2.0, 1.0, seed=5),
    }
    return _rows(spark, [(k, _one(np.linalg.norm(w, axis=0).mean()), _one((w**2).sum(0).mean()), _one(np.abs(w.mean(1)).max())) for k, w in draws.items()], "law string, mean_radius double, mean_square double, drift double")


@register("law_shapes", "SELECT * FROM (VALUES ('scaled', 0.25e0), ('covariance 00', 0.6e0), ('covariance 01', -0.5e0), ('of a mixture', 0.5e0), ('multiples', 1.0e0), ('one dimension', 1.0e0), ('offsets', 3.14e0), ('offsets within', 1.5e0)) v(what, value)")
def law_shapes(spark, sf_dir):
    """The dispatcher: scales, covariances, mixtures and integer dimensions; and the offsets of a dither."""
    n = 200_000
    sigma = np.array([[2.0, 0.8], [0.8, 1.0]])
    w, c = frequencies.draw("Gaussian", 2, n, sigma, seed=6), frequencies.draw("FG", 3, 5000, 1.0, [0, 4, 3], seed=7)
    mixed = frequencies.draw("gaussian", 1, n, (np.array([0.5, 0.5]), np.array([1e-6, 1.0])), seed=8)
    steps = np.stack([c[1] * 4 / (2 * np.pi), c[2] * 3 / (2 * np.pi)])
    second = w @ w.T / n - np.linalg.inv(sigma)
    rows = [
        ("scaled", _one((frequencies.draw("g", 1, n, 4.0, seed=9) ** 2).mean(), 2)), ("covariance 00", _one(second[0, 0] + 0.6)), ("covariance 01", _one(second[0, 1] - 0.5)), ("of a mixture", _one((np.abs(mixed) > 20).mean())),
        ("multiples", float(np.allclose(steps, np.round(steps)))), ("one dimension", float(((c[1:] != 0).sum(0) <= 1).all())), ("offsets", _one(frequencies.dither(n, seed=10).mean(), 2)), ("offsets within", _one(frequencies.dither(n, (1.0, 2.0), seed=11).mean(), 1)),
    ]
    return _rows(spark, rows, "what string, value double")


@register("pdf_one_sided", "SELECT r, round(exp(-r * r / 8), 6) + 0e0 AS upper_only, round(greatest(exp(-r * r / 8) - exp(-r * r / 2), 0), 6) + 0e0 AS scalars FROM (SELECT i / 40e0 AS r FROM range(201) t(i)) g")
def pdf_one_sided(spark, sf_dir):
    """Sides of a difference of Gaussians as single deviations, or left out."""
    r = F.col("id") / 40.0
    return spark.range(201).select(r.alias("r"), _r(density.difference_of_gaussians(r, 2.0, None)).alias("upper_only"), _r(density.difference_of_gaussians(r, 2.0, 1.0)).alias("scalars"))


# ---------------------------------------------------------------- generated data
_GENERATED = Mixture(np.array([0.5, 0.3, 0.2]), np.array([[0.0, 3.0], [4.0, 0.0], [-5.0, -5.0]]), np.array([[[1.0, 0.6], [0.6, 1.0]], [[0.25, 0.0], [0.0, 4.0]], [[1.0, -0.9], [-0.9, 1.0]]]))


@register("mixture_rows", "SELECT * FROM (VALUES (0, 0.5e0, 0.0e0, 3.0e0, 1.0e0, 1.0e0, 0.6e0), (1, 0.3e0, 4.0e0, 0.0e0, 0.5e0, 2.0e0, 0.0e0), (2, 0.2e0, -5.0e0, -5.0e0, 1.0e0, 1.0e0, -0.9e0)) v(y, weight, mu0, mu1, s0, s1, rho)")
def mixture_rows(spark, sf_dir):
    """Moments of 200,000 rows of a mixture, by label."""
    df = datasets.sample_mixture(spark, _GENERATED, 200_000, seed=3).selectExpr("y", "x[0] AS a", "x[1] AS b")
    r = lambda c: F.round(c, 1) + F.lit(0.0)
    return df.groupBy("y").agg(r(F.count("*") / 200_000).alias("weight"), r(F.avg("a")).alias("mu0"), r(F.avg("b")).alias("mu1"), r(F.stddev("a")).alias("s0"), r(F.stddev("b")).alias("s1"), r(F.corr("a", "b")).alias("rho"))


@register("mixture_parameters", "SELECT * FROM (VALUES ('balanced', true), ('apart', true), ('definite', true), ('orders', true), ('turned', true)) v(what, holds)")
def mixture_parameters(spark, sf_dir):
    """What drawn parameters promise: equal weights, least distances, definite covariances of given orders, turned or not."""
    mix = datasets.draw_mixture(3, 6, 1000, grid_aligned=False, seed=4, separation_min=5.0, variability_between=1.0, variability_within=1.0)
    flat = datasets.draw_mixture(3, 6, 1000, balanced=0.5, seed=4)
    lam = np.linalg.eigvalsh(mix.covs)
    gaps = np.linalg.norm(mix.means[:, None] - mix.means, axis=2)[np.triu_indices(6, 1)]
    rows = [("balanced", np.allclose(mix.weights, 1 / 6) and flat.weights.std() > 0), ("apart", gaps.min() > 5), ("definite", lam.min() > 0), ("orders", lam.min() >= 1 and lam.max() <= 100), ("turned", abs(mix.covs[:, 0, 1]).max() > 0.01 and np.allclose(flat.covs, np.eye(3)))]
    return _rows(spark, [(k, bool(v)) for k, v in rows], "what string, holds boolean")


@register("generated_shapes", "SELECT * FROM (VALUES ('rings', 3000, 1e0), ('ring sizes', 3, 1000e0), ('sparse', 3000, 1e0), ('spiral', 3000, 1e0), ('spiral density', 3000, 1e0)) v(what, n, value)")
def generated_shapes(spark, sf_dir):
    """Rings keep a radius each, sparse rows their number of entries and ball, the spiral its curve and density."""
    rings = datasets.circles(spark, 3, 3000, seed=2).select("y", F.hypot(F.col("x")[0], F.col("x")[1]).alias("r")).groupBy("y").agg(F.count("*").alias("n"), F.stddev("r").alias("s")).collect()
    sparse = datasets.k_sparse(spark, 10, 3, 3000, seed=4).select(F.size(F.filter("x", lambda v: v != 0)).alias("k"), F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("r"))
    rows, pdf = datasets.spiral(spark, 3000, density=True, seed=3)
    a, b = F.col("x")[0], F.col("x")[1]
    turn = F.pmod(F.atan2(b, a) / (2 * math.pi), F.lit(1.0))
    near = rows.select(F.abs(F.hypot(a, b) - 0.3 - 1.2 * turn).alias("off"), pdf(a, b).alias("p"))
    off = near.agg(F.avg((F.least("off", F.abs(F.col("off") - 1.2)) < 0.06).cast("double")), F.avg((F.col("p") > 0).cast("double"))).first()
    ok = sparse.agg(F.avg(((F.col("k") == 3) & (F.col("r") <= 1)).cast("double"))).first()[0]
    out = [("rings", sum(r["n"] for r in rings), float(all(abs(r["s"] - 0.08) < 0.01 for r in rings))), ("ring sizes", len(rings), float(min(r["n"] for r in rings))), ("sparse", sparse.count(), _one(ok, 2)), ("spiral", rows.count(), _one(off[0], 2)), ("spiral density", rows.count(), _one(off[1], 2))]
    return _rows(spark, out, "what string, n int, value double")


# ---------------------------------------------------------------- privacy
_SETTINGS = [(0.5, 1e-5, 1.0), (1.0, 1e-6, 2.0), (3.0, 1e-4, 0.5), (0.1, 1e-3, 10.0)]
_PHI = "(0.5e0 + {x} / 4000 * (SELECT sum(exp(-0.5e0 * pow({x} * (i + 0.5e0) / 4000, 2))) FROM range(4000) t(i)) / sqrt(2 * pi()))"


@register(
    "gaussian_calibration",
    f"WITH s(epsilon, delta, sens) AS (VALUES {', '.join(f'({e!r}e0, {d!r}, {s!r}e0)' for e, d, s in _SETTINGS)}), "
    # bisect the exact delta of Gaussian noise, forty times, from a bracket around the classical scale
    f"b AS (SELECT epsilon, delta, sens, sens / 100 AS lo, sens * 200 AS hi FROM s), "
    + ", ".join(
        f"m{k} AS (SELECT *, (lo + hi) / 2 AS mid, sens / (lo + hi) - epsilon * (lo + hi) / 2 / sens AS p, -sens / (lo + hi) - epsilon * (lo + hi) / 2 / sens AS q FROM {'b' if not k else f'b{k - 1}'}), "
        f"b{k} AS (SELECT epsilon, delta, sens, CASE WHEN {_PHI.format(x='p')} - exp(epsilon) * {_PHI.format(x='q')} > delta THEN mid ELSE lo END AS lo, CASE WHEN {_PHI.format(x='p')} - exp(epsilon) * {_PHI.format(x='q')} > delta THEN hi ELSE mid END AS hi FROM m{k})"
        for k in range(24)
    )
    + " SELECT epsilon, delta, round(hi / sens, 2) AS scale FROM b23",
)
def gaussian_calibration(spark, sf_dir):
    """The least noise scale for epsilon and delta, against a bisection of the exact formula in SQL."""
    return _rows(spark, [(e, d, _one(privacy.gaussian_scale(e, d, s) / s, 2)) for e, d, s in _SETTINGS], "epsilon double, delta double, scale double")


_NOISES = [("laplace", 0.5, 0.0, "UDP", True), ("gauss", 0.5, 1e-7, "UDP", True), ("replace laplace", 0.5, 0.0, "BDP", True), ("replace gauss", 0.5, 1e-7, "BDP", False)]


@register("dp_noise", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 0e0, 1e0, {str(d == 'UDP').lower()})" for k, _, _, d, _ in _NOISES) + ") v(mechanism, mean, deviation, private_n)")
def dp_noise(spark, sf_dir):
    """Seeded noise of each mechanism in units of the deviation that its scale promises, over 4000 numbers of 20 seeds."""
    m, n, out = 4000, 1000, []
    fmap = FeatureMap.of("ComplexExponential", np.ones((1, m)))
    for name, eps, delta, dp, analytic in _NOISES:
        udp = dp == "UDP"
        own = eps * 2 * m / (2 * m + 1) if udp else eps
        s = privacy.sensitivity(fmap, 1, dp, 2 if delta else 1)
        sd = math.sqrt(2) * s / own if not delta else privacy.gaussian_scale(own, delta, s) if analytic else math.sqrt(2 * math.log(1.25 / delta)) * s / own
        noise, given = [], []
        for seed in range(20):
            z, k = privacy.private_parts(np.zeros(m), n, fmap, eps, delta, dp, analytic, seed=seed)
            noise += [*(z.real * k / sd), *(z.imag * k / sd)]
            given.append(k)
        out.append((name, _one(np.mean(noise), 1), _one(np.std(noise), 1), len(set(given)) > 1))
    return _rows(spark, out, "mechanism string, mean double, deviation double, private_n boolean")


# ---------------------------------------------------------------- divergences and plots
_P, _Q = Mixture(np.ones(1), np.array([[0.3, 0.3]]), np.array([np.diag([0.05, 0.04])])), Mixture(np.ones(1), np.array([[0.5, 0.1]]), np.array([np.diag([0.1, 0.05])]))


@register(
    "symm_kl",
    "WITH g(a0, a1, s0, s1, b0, b1, t0, t1) AS (VALUES (0.3e0, 0.3e0, 0.05e0, 0.04e0, 0.5e0, 0.1e0, 0.1e0, 0.05e0)) "
    "SELECT round((s0 / t0 + s1 / t1 + (a0 - b0) ** 2 / t0 + (a1 - b1) ** 2 / t1 - 2 + t0 / s0 + t1 / s1 + (a0 - b0) ** 2 / s0 + (a1 - b1) ** 2 / s1 - 2) / 4, 1) AS kl, 0e0 AS self FROM g",
)
def symm_kl(spark, sf_dir):
    """Of two Gaussians, where the divergence has a closed form, and of a mixture and itself."""
    return _rows(spark, [(_one(mixtures.symmetric_kl(spark, _P, _Q)), _one(mixtures.symmetric_kl(spark, MIX2, MIX2)))], "kl double, self double")


@register(
    "mixture_ellipses",
    f"WITH g(k, weight, x, y, a, b, c) AS (VALUES {', '.join(f'({k}, {float(MIX2.weights[k])!r}e0, {float(MIX2.means[k][0])!r}e0, {float(MIX2.means[k][1])!r}e0, {float(MIX2.covs[k][0, 0])!r}e0, {float(MIX2.covs[k][0, 1])!r}e0, {float(MIX2.covs[k][1, 1])!r}e0)' for k in range(2))}), "
    "e AS (SELECT *, (a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b) AS l2, atan2(2 * b, a - c) / 2 * 180 / pi() AS t FROM g) "
    "SELECT k, weight, x, y, round(2 * sqrt(-2 * ln(0.05e0) * l1), 6) AS width, round(2 * sqrt(-2 * ln(0.05e0) * l2), 6) AS height, round((t + 90) - 180 * floor((t + 90) / 180) - 90, 4) AS angle FROM e",
)
def mixture_ellipses(spark, sf_dir):
    e = mixtures.ellipses(spark, MIX2)
    return e.select("k", "weight", "x", "y", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), F.round("angle", 4).alias("angle"))


# ---------------------------------------------------------------- maps of one's own, derivatives, windows
@register("sketch_user_wave", _sketch_sql(waves.Wave("user", np.cos, ("(cos({t}) * cos({t}))", "(sin({t}) * 5e-1)")), XI))
def sketch_user_wave(spark, sf_dir):
    return _rounded(sketch(_lineitem(spark, sf_dir), FeatureMap.of(lambda t: np.cos(t) ** 2 + 0.5j * np.sin(t), OMEGA, XI), X))


@register("sketch_of_callable", f"SELECT j, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im FROM (SELECT unnest([0, 1]) AS j, unnest([avg(sin(x0) * x1), avg(sqrt(abs(x2 - x3)))]) AS re, unnest([avg(exp(x0) * x3), 0e0]) AS im FROM (SELECT {_FEATURES} FROM lineitem) v) s")
def sketch_of_callable(spark, sf_dir):
    """The mean of a function of whole rows, many at a time."""
    phi = lambda x: np.stack([np.sin(x[:, 0]) * x[:, 1] + 1j * np.exp(x[:, 0]) * x[:, 3], np.sqrt(np.abs(x[:, 2] - x[:, 3]))], 1)
    z = sketch_callable(_lineitem(spark, sf_dir), phi, X, rows=True)
    return _rows(spark, [(j, _one(v.real, 6), _one(v.imag, 6)) for j, v in enumerate(z)], "j int, re double, im double")


_AT = (0.3, 0.6, 0.2, 0.9)


@register("feature_gradient", f"WITH {_freq_sql(OMEGA, XI)}, t AS (SELECT *, {' + '.join(f'{v!r}e0 * w{i}' for i, v in enumerate(_AT))} + xi AS t FROM freq) SELECT j, {', '.join(f'round(-w{i} * sin(t), 6) + 0e0 AS re{i}, round(w{i} * cos(t), 6) + 0e0 AS im{i}' for i in range(4))} FROM t")
def feature_gradient(spark, sf_dir):
    g = FeatureMap.of("ComplexExponential", OMEGA, XI).grad(np.array(_AT))
    return _rows(spark, [(j, *(_one(v, 6) for i in range(4) for v in (g[i, j].real, g[i, j].imag))) for j in range(g.shape[1])], "j int, " + ", ".join(f"re{i} double, im{i} double" for i in range(4)))


_RE, _IM = _parts(waves.complex_exponential())


@register(
    "sketch_weighted_rollup",
    f"WITH {_freq_sql(OMEGA, XI)}, v AS (SELECT {_FEATURES}, l_returnflag, l_quantity / 1e6 AS weight FROM lineitem), t AS (SELECT v.*, j, {_PHASE} AS t FROM v CROSS JOIN freq) "
    f"SELECT l_returnflag, CAST(GROUPING(l_returnflag) AS BIGINT) AS level, j, round(sum(weight * {_RE}), 4) + 0e0 AS re, round(sum(weight * {_IM}), 4) + 0e0 AS im, count(*) AS n, round(sum(weight), 4) AS w FROM t GROUP BY GROUPING SETS ((l_returnflag, j), (j))",
)
def sketch_weighted_rollup(spark, sf_dir):
    """Two weighted parts merged by group, then rolled up: sums, rows, weights, and which rows are totals."""
    df = _lineitem(spark, sf_dir, "l_returnflag", "l_orderkey", (F.col("l_quantity") / 1e6).alias("weight"))
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    parts = [sketch(df.filter(F.col("l_orderkey") % 2 == r), fmap, X, weight="weight", by=["l_returnflag"]) for r in (0, 1)]
    out = rollup(merge(parts, ["l_returnflag"]), ["l_returnflag"])
    return out.select("l_returnflag", "level", "j", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"), "n", F.round("w", 4).alias("w"))


@register(
    "sketch_odd_vectors",
    "WITH f(j, a, b) AS (VALUES (0, 1.0e0, 0.5e0), (1, -0.5e0, 2.0e0)), t AS (SELECT j, a * (o_orderkey % 7) / 7e0 + b * (o_orderkey % 11) / 11e0 AS t FROM orders CROSS JOIN f WHERE o_orderkey % 5 < 1) SELECT j, round(avg(cos(t)), 6) + 0e0 AS re, round(avg(sin(t)), 6) + 0e0 AS im, count(*) AS n FROM t GROUP BY j",
)
def sketch_odd_vectors(spark, sf_dir):
    """Vectors of another length, with infinities, NaN or nulls, are left out; a fifth of the rows is whole."""
    x, y, k = F.col("o_orderkey") % 7 / 7.0, F.col("o_orderkey") % 11 / 11.0, F.col("o_orderkey") % 5
    v = F.when(k == 0, F.array(x, y)).when(k == 1, F.array(x, y, x)).when(k == 2, F.array(x, F.lit(float("inf")))).when(k == 3, F.array(F.lit(float("nan")), y)).otherwise(F.array(x, F.lit(None).cast("double")))
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(v.alias("v"))
    return _rounded(sketch(df, FeatureMap.of("ComplexExponential", np.array([[1.0, -0.5], [0.5, 2.0]])), vector="v"))


@register(
    "sketch_sessions",
    "WITH f(j, a) AS (VALUES (0, 1.0e0), (1, 3.0e0)), e AS (SELECT user_id, ts, value / 100e0 AS x, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) "
    'SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, j, round(sum(x * cos(a * x)), 6) + 0e0 AS re, round(sum(x * sin(a * x)), 6) + 0e0 AS im, count(*) AS n FROM s CROSS JOIN f GROUP BY user_id, k, j',
)
def sketch_sessions(spark, sf_dir):
    """Weighted sketches of vectors over each user's sessions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", F.array(F.col("value") / 100.0).alias("v"), (F.col("value") / 100.0).alias("x"))
    return _rounded(session_sketch(e, FeatureMap.of("ComplexExponential", np.array([[1.0, 3.0]])), None, "ts", "12 hours", ["user_id"], vector="v", weight="x"), "start", "end", "user_id")
