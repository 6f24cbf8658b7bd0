"""The library's registered queries and their DuckDB SQL.

Features are columns scaled by literals, frequencies are literals of six decimals, so both engines compute from the
same numbers. Results are rounded to six decimals; adding 0.0 turns a negative zero into zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import density, waves
from tessera.operators import atoms, histogram, mixtures, privacy, scale
from tessera.operators.feature_map import FeatureMap
from tessera.operators.sketch import from_vector, merge, rollup, sketch, to_vector
from tessera.sources import datasets, frequencies
from tessera.sources.datasets import Mixture
from tessera.streaming.sketch import windowed_sketch

Query = Callable[[SparkSession, str], DataFrame]

X = ["x0", "x1", "x2", "x3"]
SCALED = {"x0": "l_quantity / 50e0", "x1": "l_extendedprice / 100000e0", "x2": "l_discount * 10e0", "x3": "l_tax * 12.5e0"}
M = 16
_six = lambda x: np.round(x, 6)
OMEGA = _six(frequencies.draw("FoldedGaussian", 4, M, 0.1, seed=42))
XI = _six(frequencies.dither(M, seed=43))
OMEGA_E = _six(frequencies.draw("Gaussian", 64, 8, 0.5, seed=44))
XI_E = _six(frequencies.dither(8, seed=45))
MIX = Mixture(np.array([0.5, 0.3, 0.2]), np.array([[0.2, 0.3, 0.5, 0.5], [0.6, 0.4, 0.2, 0.8], [0.9, 0.8, 0.7, 0.1]]), np.stack([np.diag(v) for v in ([0.02, 0.03, 0.05, 0.04], [0.01, 0.02, 0.03, 0.05], [0.04, 0.01, 0.02, 0.03])]))
MIX2 = Mixture(np.array([0.6, 0.4]), np.array([[0.3, 0.3], [0.7, 0.6]]), np.array([[[0.05, 0.01], [0.01, 0.04]], [[0.03, -0.01], [-0.01, 0.06]]]))
BOX = np.array([[0.02, 1.0], [0.0, 0.9], [0.0, 1.0], [0.1, 0.8]])
SERIES = [0.1 + 0.2j, -0.3 + 0.1j, 0.5, 0.2 - 0.4j, 0.05 + 0.1j]
UPPER, LOWER = ([0.7, 0.3], [1.0, 2.0]), ([0.5], [0.8])
CENTROIDS = _six(np.random.default_rng(46).standard_normal((5, 64)) / 8)


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None = None


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        REGISTRY[name] = Registered(f, sql)
        return f

    return put


# ---------------------------------------------------------------- helpers
def _lineitem(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(*[F.expr(e).alias(c) for c, e in SCALED.items()], *more)


def _r(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(s: DataFrame, *keys: str) -> DataFrame:
    return s.select(*keys, "j", _r("re").alias("re"), _r("im").alias("im"), "n")


def _freq_sql(omega: np.ndarray, xi: np.ndarray) -> str:
    rows = ", ".join("(" + ", ".join([str(j), *(f"{float(v)!r}::DOUBLE" for v in omega[:, j]), f"{float(xi[j])!r}::DOUBLE"]) + ")" for j in range(omega.shape[1]))
    return f"freq(j, {', '.join(f'w{i}' for i in range(len(omega)))}, xi) AS (VALUES {rows})"


_FEATURES = ", ".join(f"{e} AS {c}" for c, e in SCALED.items())
_PHASE = " + ".join([f"x{i} * w{i}" for i in range(4)] + ["xi"])


def _parts(f: waves.Wave, c_norm: float = 1.0, t: str = "t") -> tuple[str, str]:
    p = [f"{c_norm!r} * {s.format(t=t)}" for s in f.sql]
    return p[0], p[1] if len(p) > 1 else "0e0"


def _sketch_sql(f: waves.Wave, xi: np.ndarray, c_norm: float = 1.0, keys: str = "", weight: str = "", where: str = "") -> str:
    re, im = _parts(f, c_norm)
    k = f"{keys}, " if keys else ""
    mean = (lambda e: f"sum({weight} * {e})") if weight else (lambda e: f"avg({e})")
    return f"""
WITH {_freq_sql(OMEGA, xi)}, v AS (SELECT {_FEATURES}, l_returnflag, l_quantity, l_orderkey FROM lineitem {where}), t AS (SELECT v.*, j, {_PHASE} AS t FROM v CROSS JOIN freq)
SELECT {k}j, round({mean(re)}, 6) + 0e0 AS re, round({mean(im)}, 6) + 0e0 AS im, count(*) AS n FROM t GROUP BY {k}j"""


# ---------------------------------------------------------------- sketches of data
_WAVES = {
    "fourier": waves.complex_exponential(), "cosine": waves.cosine(), "uq": waves.universal_quantization(), "uq_complex": waves.universal_quantization_complex(), "uq_uncentred": waves.universal_quantization(centred=False),
    "sawtooth": waves.sawtooth(), "sawtooth_complex": waves.sawtooth_complex(), "sawtooth_uncentred": waves.sawtooth(centred=False), "triangle": waves.triangle(), "fourier_series": waves.fourier_series(SERIES),
}
for _name, _wave in _WAVES.items():
    # quantised maps jump at cell edges; the dither keeps data off them
    _xi = np.zeros(M) if _name in ("fourier", "cosine", "fourier_series") else XI

    def _run(spark: SparkSession, sf_dir: str, f=_wave, xi=_xi) -> DataFrame:
        return _rounded(sketch(_lineitem(spark, sf_dir), FeatureMap.of(f, OMEGA, xi), X))

    register(f"sketch_{_name}", _sketch_sql(_wave, _xi))(_run)

    def _run_jvm(spark: SparkSession, sf_dir: str, f=_wave, xi=_xi) -> DataFrame:
        return _rounded(sketch(_lineitem(spark, sf_dir), FeatureMap.of(f, OMEGA, xi), X, backend="catalyst"))

    if _name in ("fourier", "uq_complex", "triangle"):
        register(f"sketch_{_name}_catalyst", _sketch_sql(_wave, _xi))(_run_jvm)

_EXP = waves.complex_exponential()


@register("sketch_dithered", _sketch_sql(_EXP, XI))
def sketch_dithered(spark, sf_dir):
    return _rounded(sketch(_lineitem(spark, sf_dir), FeatureMap.of("ComplexExponential", OMEGA, XI), X))


@register("sketch_cnorm_unit", _sketch_sql(_EXP, XI, 1 / math.sqrt(M)))
def sketch_cnorm_unit(spark, sf_dir):
    return _rounded(sketch(_lineitem(spark, sf_dir), FeatureMap.of("ComplexExponential", OMEGA, XI, "unit"), X))


@register("sketch_weighted", _sketch_sql(_EXP, XI, weight="l_quantity / 1e6").replace("6) + 0e0", "4) + 0e0"))
def sketch_weighted(spark, sf_dir):
    df = _lineitem(spark, sf_dir, (F.col("l_quantity") / 1e6).alias("w"))
    s = sketch(df, FeatureMap.of("ComplexExponential", OMEGA, XI), X, weight="w")
    return s.select("j", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"), "n")


@register("sketch_by_group", _sketch_sql(_EXP, XI, keys="l_returnflag"))
def sketch_by_group(spark, sf_dir):
    return _rounded(sketch(_lineitem(spark, sf_dir, "l_returnflag"), FeatureMap.of("ComplexExponential", OMEGA, XI), X, by=["l_returnflag"]), "l_returnflag")


@register("sketch_rollup", _sketch_sql(_EXP, XI, keys="l_returnflag").replace("GROUP BY l_returnflag, j", "GROUP BY GROUPING SETS ((l_returnflag, j), (j))").replace("SELECT l_returnflag, j,", "SELECT l_returnflag, CAST(GROUPING(l_returnflag) AS BIGINT) AS level, j,"))
def sketch_rollup(spark, sf_dir):
    groups = sketch(_lineitem(spark, sf_dir, "l_returnflag"), FeatureMap.of("ComplexExponential", OMEGA, XI), X, by=["l_returnflag"])
    return _rounded(rollup(groups, ["l_returnflag"]), "l_returnflag", "level")


@register("sketch_merge", _sketch_sql(_EXP, XI))
def sketch_merge(spark, sf_dir):
    df, fmap = _lineitem(spark, sf_dir, "l_orderkey"), FeatureMap.of("ComplexExponential", OMEGA, XI)
    return _rounded(merge([sketch(df.filter(F.col("l_orderkey") % 2 == r), fmap, X) for r in (0, 1)]))


_RE_E, _IM_E = _parts(waves.universal_quantization_complex())


@register(
    "sketch_embeddings",
    f"""
WITH freq(j, w, xi) AS (VALUES {", ".join(f"({j}, {OMEGA_E[:, j].tolist()}::DOUBLE[], {float(XI_E[j])!r}::DOUBLE)" for j in range(8))}),
t AS (SELECT j, list_inner_product(embedding::DOUBLE[], w) + xi AS t FROM embeddings CROSS JOIN freq)
SELECT j, round(avg({_RE_E}), 6) + 0e0 AS re, round(avg({_IM_E}), 6) + 0e0 AS im, count(*) AS n FROM t GROUP BY j""",
)
def sketch_embeddings(spark, sf_dir):
    return _rounded(sketch(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), FeatureMap.of("universalQuantization_complex", OMEGA_E, XI_E), vector="embedding"))


@register("feature_projection", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({p}, 6) + 0e0 AS f{j}_{s}' for j in range(2) for s, p in zip(('re', 'im'), _parts(_EXP, 1.0, '(' + ' + '.join([f'{float(OMEGA[i, j])!r} * x{i}' for i in range(4)] + [repr(float(XI[j]))]) + ')'), strict=True))} FROM (SELECT {_FEATURES}, l_orderkey, l_linenumber FROM lineitem)")
def feature_projection(spark, sf_dir):
    df = FeatureMap.of("ComplexExponential", OMEGA[:, :2], XI[:2]).features(_lineitem(spark, sf_dir, "l_orderkey", "l_linenumber"), X)
    return df.select("l_orderkey", "l_linenumber", *[_r(f"f{j}_{s}").alias(f"f{j}_{s}") for j in range(2) for s in ("re", "im")])


_W2 = _six(frequencies.draw("Gaussian", 2, 6, 1.0, seed=47))
_XI2 = _six(frequencies.dither(6, seed=48))


@register(
    "sketch_window",
    f"""
WITH {_freq_sql(_W2, _XI2)}, t AS (SELECT date_trunc('day', ts) AS d, j, (value / 100e0) * w0 + (user_id % 100 / 100e0) * w1 + xi AS t FROM events CROSS JOIN freq)
SELECT d AS start, d + INTERVAL 1 DAY AS "end", j, round(avg(cos(t)), 6) + 0e0 AS re, round(avg(sin(t)), 6) + 0e0 AS im, count(*) AS n FROM t GROUP BY d, j""",
)
def sketch_window(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", (F.col("value") / 100.0).alias("a"), (F.col("user_id") % 100 / 100.0).alias("b"))
    return _rounded(windowed_sketch(e, FeatureMap.of("ComplexExponential", _W2, _XI2), ["a", "b"], "ts", "1 day"), "start", "end")


# ---------------------------------------------------------------- sketches of models
def _gauss_sql(mix: Mixture) -> str:
    re, im = [], []
    for k in range(mix.k):
        phase = " + ".join(f"{float(v)!r} * w{i}" for i, v in enumerate(mix.means[k])) + " + xi"
        quad = " + ".join(f"{float(mix.covs[k][a, a])!r} * w{a} * w{a}" for a in range(4))
        for out, f in ((re, "cos"), (im, "sin")):
            out.append(f"{float(mix.weights[k])!r} * exp(-({quad}) / 2e0) * {f}({phase})")
    return f"WITH {_freq_sql(OMEGA, XI)} SELECT j, round({' + '.join(re)}, 6) + 0e0 AS re, round({' + '.join(im)}, 6) + 0e0 AS im FROM freq"


_ONE = Mixture(np.ones(1), MIX.means[:1], MIX.covs[:1])


def _model(s: DataFrame) -> DataFrame:
    return s.select("j", _r("re").alias("re"), _r("im").alias("im"))


@register("gaussian_sketch", _gauss_sql(_ONE))
def gaussian_sketch(spark, sf_dir):
    return _model(atoms.mixture_sketch_table(spark, _ONE, FeatureMap.of("ComplexExponential", OMEGA, XI)))


@register("gmm_sketch", _gauss_sql(MIX))
def gmm_sketch(spark, sf_dir):
    return _model(atoms.mixture_sketch_table(spark, MIX, FeatureMap.of("ComplexExponential", OMEGA, XI)))


def _box_sql(omega: np.ndarray, box: np.ndarray, categories: list[int]) -> str:
    phase, size = ["xi"], ["1e0"]
    for i, c in enumerate(categories):
        lo, hi = map(float, box[i])
        phase.append(f"w{i} * {(lo + hi) / 2!r}")
        if c:
            n = hi - lo + 1
            size.append(f"CASE WHEN abs(sin(w{i} / 2)) < 1e-12 THEN cos(w{i} * {(n - 1) / 2!r}) ELSE sin(w{i} * {n / 2!r}) / (sin(w{i} / 2) * {n!r}) END")
        else:
            size.append(f"CASE WHEN abs(w{i}) < 1e-12 THEN 1e0 ELSE sin(w{i} * {(hi - lo) / 2!r}) / (w{i} * {(hi - lo) / 2!r}) END")
    p, s = " + ".join(phase), " * ".join(size)
    return f"WITH {_freq_sql(omega, XI)} SELECT j, round({s} * cos({p}), 6) + 0e0 AS re, round({s} * sin({p}), 6) + 0e0 AS im FROM freq"


@register("box_sketch", _box_sql(OMEGA, BOX, [0, 0, 0, 0]))
def box_sketch(spark, sf_dir):
    return _model(atoms.box_sketch_table(spark, BOX, FeatureMap.of("ComplexExponential", OMEGA, XI)))


_CATS = [0, 0, 0, 7]
OMEGA_I = _six(frequencies.draw("Gaussian", 4, M, 1.0, _CATS, seed=49))
BOX_I = np.array([[0.02, 1.0], [0.0, 0.9], [0.0, 1.0], [0, 6]])


@register("box_sketch_integer", _box_sql(OMEGA_I, BOX_I, _CATS))
def box_sketch_integer(spark, sf_dir):
    return _model(atoms.box_sketch_table(spark, BOX_I, FeatureMap.of("ComplexExponential", OMEGA_I, XI), _CATS))


# ---------------------------------------------------------------- laws and scales
_GRID = "(SELECT i / 400e0 AS r FROM range(2001) t(i))"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(2001).select((F.col("id") / 400.0).alias("r"))


@register("pdf_adapted_radius", f"SELECT r, round(sqrt(r * r + r * r * r * r / 4) * exp(-r * r / 2), 6) + 0e0 AS ar, round(r * exp(-r * r / 2), 6) + 0e0 AS ar_kmeans FROM {_GRID}")
def pdf_adapted_radius(spark, sf_dir):
    return _grid(spark).select("r", _r(density.adapted_radius(F.col("r"))).alias("ar"), _r(density.adapted_radius(F.col("r"), kmeans=True)).alias("ar_kmeans"))


@register("pdf_diff_gaussians", f"SELECT r, round(greatest(0e0, 0.7 * exp(-r * r / 2) + 0.3 * exp(-r * r / 8) - 0.5 * exp(-r * r / 1.28)), 6) + 0e0 AS p FROM {_GRID}")
def pdf_diff_gaussians(spark, sf_dir):
    return _grid(spark).select("r", _r(density.difference_of_gaussians(F.col("r"), UPPER, LOWER)).alias("p"))


@register(
    "icdf_sample",
    f"""
WITH g AS (SELECT r, sqrt(r * r + r * r * r * r / 4) * exp(-r * r / 2) AS p FROM {_GRID}), c AS (SELECT r, sum(p) OVER (ORDER BY r) / sum(p) OVER () AS c FROM g),
s AS (SELECT r, c, lead(r) OVER (ORDER BY r) AS r2, lead(c) OVER (ORDER BY r) AS c2 FROM c), u AS (SELECT i AS id, (i + 0.5e0) / 200e0 AS u FROM range(200) t(i))
SELECT id, round(r + (u - c) / (c2 - c) * (r2 - r), 6) + 0e0 AS x FROM u JOIN s ON u >= c AND u < c2""",
)
def icdf_sample(spark, sf_dir):
    r = np.arange(2001) / 400.0
    x = density.inverse_cdf(density.adapted_radius(r), r, (np.arange(200) + 0.5) / 200)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").select("id", _r("x").alias("x"))


_BLOCK_SQL = f"""
WITH {_freq_sql(OMEGA, XI)}, v AS (SELECT {_FEATURES} FROM lineitem), t AS (SELECT j, w0, w1, w2, w3, {_PHASE} AS t FROM v CROSS JOIN freq),
s AS (SELECT j, round(sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3), 6) AS r, round(sqrt(avg(cos(t)) ** 2 + avg(sin(t)) ** 2), 6) + 0e0 AS size FROM t GROUP BY j, w0, w1, w2, w3),
b AS (SELECT *, CAST((row_number() OVER (ORDER BY r, j) - 1) // 4 AS INTEGER) AS block FROM s)
SELECT block, arg_max(j, size) AS j, arg_max(r, size) AS r, max(size) AS size FROM b GROUP BY block"""


@register("freq_block_max", _BLOCK_SQL)
def freq_block_max(spark, sf_dir):
    s = sketch(_lineitem(spark, sf_dir), FeatureMap.of("ComplexExponential", OMEGA, XI), X)
    f = frequencies.table(spark, OMEGA, XI).select("j", F.round(F.sqrt(F.aggregate("omega", F.lit(0.0), lambda a, v: a + v * v)), 6).alias("r"))
    radii = s.join(f, "j").select("j", "r", _r(F.hypot("re", "im")).alias("size"))
    return scale.block_extremes_table(radii, 4, M).select("block", "j", "r", "size")


# ---------------------------------------------------------------- privacy
def _sensitivity_rows() -> list[tuple]:
    maps = ("complexexponential", "universalquantization_complex")
    return [(name, dp, norm, compat, privacy.sensitivity((80, name, 0.5), 10, dp, norm, compat)) for name in maps for dp in ("UDP", "BDP") for norm in (1, 2) for compat in (False, True)]


@register(
    "sensitivity_table",
    """
WITH maps(map, l1, l2) AS (VALUES ('complexexponential', sqrt(2e0), 1e0), ('universalquantization_complex', 2e0, sqrt(2e0))), dps(dp) AS (VALUES ('UDP'), ('BDP')), norms(norm) AS (VALUES (1), (2)), modes(compat) AS (VALUES (false), (true))
SELECT map, dp, norm, compat, round(0.5 / 10 * CASE norm WHEN 1 THEN 80 * l1 ELSE sqrt(80e0) * l2 END * CASE WHEN dp = 'UDP' THEN 1 WHEN compat AND norm = 2 THEN sqrt(2e0) ELSE 2 END, 6) AS value
FROM maps CROSS JOIN dps CROSS JOIN norms CROSS JOIN modes""",
)
def sensitivity_table(spark, sf_dir):
    return spark.createDataFrame(_sensitivity_rows(), "map string, dp string, norm int, compat boolean, value double").select("map", "dp", "norm", "compat", F.round("value", 6).alias("value"))


def _private(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    z, n = to_vector(sketch(_lineitem(spark, sf_dir), fmap, X))
    noisy, given = privacy.private_parts(z, n, fmap, seed=1, **params)
    return _rounded(from_vector(spark, noisy, round(given)))  # under add/remove the noisy n: the exact one is private


register("dp_sketch_eps_inf", _sketch_sql(_EXP, XI))(lambda spark, sf_dir: _private(spark, sf_dir, epsilon=math.inf))
register("dp_sketch_laplace")(lambda spark, sf_dir: _private(spark, sf_dir, epsilon=0.5))
register("dp_sketch_gauss")(lambda spark, sf_dir: _private(spark, sf_dir, epsilon=0.5, delta=1e-7))
register("dp_sketch_replace")(lambda spark, sf_dir: _private(spark, sf_dir, epsilon=0.5, delta=1e-7, dp="BDP", analytic=False))


# ---------------------------------------------------------------- datasets
def _norm_sql(norm: str) -> str:
    size = "sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3)" if norm == "l_2-unit-ball" else "greatest(abs(x0), abs(x1), abs(x2), abs(x3))"
    return f"WITH v AS (SELECT l_orderkey, l_linenumber, {_FEATURES} FROM lineitem), s AS (SELECT max({size}) + 1e-6 AS s FROM v) SELECT l_orderkey, l_linenumber, {', '.join(f'round(x{i} / s, 6) + 0e0 AS y{i}' for i in range(4))} FROM v CROSS JOIN s"


def _normalized(spark: SparkSession, sf_dir: str, norm: str) -> DataFrame:
    df, _, _ = datasets.normalize(_lineitem(spark, sf_dir, "l_orderkey", "l_linenumber").withColumn("x", F.array(*X)), "x", norm)
    return df.select("l_orderkey", "l_linenumber", *[_r(F.col("x")[i]).alias(f"y{i}") for i in range(4)])


register("normalize_l2", _norm_sql("l_2-unit-ball"))(lambda spark, sf_dir: _normalized(spark, sf_dir, "l_2-unit-ball"))
register("normalize_linf", _norm_sql("l_inf-unit-ball"))(lambda spark, sf_dir: _normalized(spark, sf_dir, "l_inf-unit-ball"))
register("generate_gmm")(lambda spark, sf_dir: datasets.gmm(spark, 2, 4, 20_000, "labels", "l_inf-unit-ball", seed=1, balanced=False))
register("generate_circles")(lambda spark, sf_dir: datasets.circles(spark, 3, 3_000, "l_2-unit-ball", seed=2))
register("generate_ksparse")(lambda spark, sf_dir: datasets.k_sparse(spark, 10, 3, 3_000, seed=4))


@register("generate_spiral")
def generate_spiral(spark, sf_dir):
    rows, pdf = datasets.spiral(spark, 3_000, "l_inf-unit-ball", density=True, seed=3)
    return rows.withColumn("density", pdf(F.col("x")[0], F.col("x")[1]))


# ---------------------------------------------------------------- baselines and metrics
_CENTROIDS_SQL = f"c(k, c) AS (VALUES {', '.join(f'({k}, {c.tolist()}::DOUBLE[])' for k, c in enumerate(CENTROIDS))})"


@register("kmeans_assign", f"WITH {_CENTROIDS_SQL}, d AS (SELECT vec_id, k, list_distance(embedding::DOUBLE[], c) ** 2 AS d FROM embeddings CROSS JOIN c) SELECT vec_id, arg_min(k, d) AS cluster, round(min(d), 6) + 0e0 AS distance2 FROM d GROUP BY vec_id")
def kmeans_assign(spark, sf_dir):
    df = mixtures.assign(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), CENTROIDS, vector="embedding")
    return df.select("vec_id", "cluster", _r("distance2").alias("distance2"))


@register("sse", f"WITH {_CENTROIDS_SQL}, d AS (SELECT vec_id, min(list_distance(embedding::DOUBLE[], c) ** 2) AS d FROM embeddings CROSS JOIN c GROUP BY vec_id) SELECT round(sum(d) / count(*), 6) AS sse_per_row, count(*) AS n FROM d")
def sse(spark, sf_dir):
    df = mixtures.assign(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), CENTROIDS, vector="embedding")
    return df.agg(F.round(F.sum("distance2") / F.count("*"), 6).alias("sse_per_row"), F.count("*").alias("n"))


_PART = {"p0": "p_size / 50e0", "p1": "(p_retailprice - 900) / 100e0"}
_PART_SQL = "(SELECT p_partkey, p_size / 50e0 AS p0, (p_retailprice - 900) / 100e0 AS p1 FROM part)"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *[F.expr(e).alias(c) for c, e in _PART.items()])


_TERMS = [f"{math.log(float(MIX2.weights[k]))!r} + {density.log_normal_column(['p0', 'p1'], MIX2.means[k], MIX2.covs[k])}" for k in range(2)]
_RESP = f"(SELECT *, exp(t0) / (exp(t0) + exp(t1)) AS r0, exp(t1) / (exp(t0) + exp(t1)) AS r1, ln(exp(t0) + exp(t1)) AS loglik FROM (SELECT *, {_TERMS[0]} AS t0, {_TERMS[1]} AS t1 FROM {_PART_SQL}))"


@register("gmm_loglik", f"SELECT round(avg(loglik), 6) AS loglik, count(*) AS n FROM {_RESP}")
def gmm_loglik(spark, sf_dir):
    return _part(spark, sf_dir).agg(F.round(F.avg(mixtures.log_density(MIX2, ["p0", "p1"])), 6).alias("loglik"), F.count("*").alias("n"))


@register("gmm_responsibilities", f"SELECT p_partkey, round(r0, 6) + 0e0 AS r0, round(r1, 6) + 0e0 AS r1, round(loglik, 6) + 0e0 AS loglik FROM {_RESP}")
def gmm_responsibilities(spark, sf_dir):
    return mixtures.responsibilities(_part(spark, sf_dir), MIX2, ["p0", "p1"]).select("p_partkey", *[_r(c).alias(c) for c in ("r0", "r1", "loglik")])


_EM = [f"round(sum(r{k}) / count(*), 6) AS w{k}, " + ", ".join([f"round(sum(r{k} * p{i}) / sum(r{k}), 6) AS mu{k}_{i}" for i in (0, 1)] + [f"round(sum(r{k} * p{i} * p{j}) / sum(r{k}) - sum(r{k} * p{i}) / sum(r{k}) * (sum(r{k} * p{j}) / sum(r{k})), 6) + 0e0 AS cov{k}_{i}_{j}" for i, j in ((0, 0), (1, 0), (1, 1))]) for k in (0, 1)]


@register("em_step", f"SELECT {', '.join(_EM)}, round(avg(loglik), 6) AS loglik FROM {_RESP}")
def em_step(spark, sf_dir):
    mix, loglik = mixtures.em_step(_part(spark, sf_dir), MIX2, ["p0", "p1"], ridge=0.0)
    row = {"loglik": loglik}
    for k in (0, 1):
        row |= {f"w{k}": mix.weights[k]} | {f"mu{k}_{i}": mix.means[k, i] for i in (0, 1)} | {f"cov{k}_{i}_{j}": mix.covs[k, i, j] for i, j in ((0, 0), (1, 0), (1, 1))}
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in row.values())], ", ".join(f"{c} double" for c in row))


@register("simplex_projection", """
WITH h AS (SELECT n_regionkey, n_nationkey, (n_nationkey * 7 % 11) / 10e0 - 0.2e0 AS h FROM nation),
c AS (SELECT *, row_number() OVER o AS r, (1 - sum(h) OVER (o ROWS UNBOUNDED PRECEDING)) / row_number() OVER o AS s FROM h WINDOW o AS (PARTITION BY n_regionkey ORDER BY h DESC, n_nationkey)),
k AS (SELECT n_regionkey, arg_max(s, r) AS s FROM c WHERE h + s > 0 GROUP BY n_regionkey)
SELECT n_regionkey, n_nationkey, round(greatest(0e0, h + k.s), 6) + 0e0 AS p FROM c JOIN k USING (n_regionkey)""")
def simplex_projection(spark, sf_dir):
    h = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * 7 % 11 / 10.0 - 0.2).alias("h"))
    return histogram.project_table(h, ["n_regionkey"], "n_nationkey", "h").select("n_regionkey", "n_nationkey", _r("p").alias("p"))


@register("hist_direct", "WITH b AS (SELECT CAST(least(greatest(floor((l_quantity - 0.5) / 5), 0), 9) AS INTEGER) AS bin FROM lineitem) SELECT bin, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM b GROUP BY bin")
def hist_direct(spark, sf_dir):
    h = histogram.direct(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", 0.5, 50.5, 10)
    return h.select("bin", F.round("p", 6).alias("p"))


def _registry() -> dict[str, Registered]:
    from tessera import planted  # noqa: F401  registers the queries of learning

    return REGISTRY


def queries() -> dict[str, Query]:
    return {name: r.run for name, r in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: r.sql for name, r in _registry().items() if r.sql}
