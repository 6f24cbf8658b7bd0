import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import density, waves
from tessera.operators import atoms, histogram, mixtures, privacy, scale, solvers
from tessera.operators.feature_map import FeatureMap
from tessera.operators.sketch import merge, rollup, sketch, sketch_callable, to_vector
from tessera.plans import optim
from tessera.sources import datasets, frequencies
from tessera.sources.datasets import Mixture
from tessera.streaming.sketch import windowed_sketch

RNG = np.random.default_rng(0)
DATA = RNG.uniform(-1, 1, (300, 2))
OMEGA, XI = RNG.normal(0, 2, (2, 12)), RNG.uniform(0, 6, 12)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, float(a), float(b), "uv"[i % 2], 0.5 + i % 3) for i, (a, b) in enumerate(DATA)], "id long, a double, b double, g string, w double").repartition(3)


def vec(s):
    return to_vector(s)[0]


@pytest.mark.parametrize("f", [*waves.WAVES, waves.fourier_series([0.1, 0.2j, 0.5, -0.3, 0.1]), waves.universal_quantization(1.0, False), waves.complex_exponential(3.0)])
@pytest.mark.parametrize("backend", ["arrow", "catalyst"])
def test_backends_agree_with_numpy(frame, f, backend):
    fmap = FeatureMap.of(f, OMEGA, XI, "unit")
    assert np.allclose(vec(sketch(frame, fmap, ["a", "b"], backend=backend)), fmap(DATA).mean(0), atol=1e-12)


def test_waves_have_their_shapes():
    t = np.linspace(-15, 15, 1001)
    assert np.allclose(waves.universal_quantization().call(t), ((t // np.pi) % 2) * 2 - 1)
    assert np.allclose(waves.sawtooth(2.0).call(t), (t % 2) / 2 * 2 - 1)
    assert np.allclose(waves.triangle(1.0).call(np.array([0, 0.5, 1, 1.5, 2, -0.5])), [-1, 0, 1, 0, -1, 0])
    with pytest.raises(NotImplementedError):
        waves.wave("no such")
    with pytest.raises(ValueError):
        waves.wave(3)


def test_feature_map_checks_and_derivatives():
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    x, e = np.array([0.3, -0.2]), 1e-6
    for i in range(2):
        d = np.zeros(2)
        d[i] = e
        assert np.allclose((fmap(x + d) - fmap(x - d)) / (2 * e), fmap.grad(x)[i], atol=1e-7)
    for bad in (lambda: FeatureMap.of("cosine", OMEGA[0]), lambda: FeatureMap.of("cosine", OMEGA, XI[:3])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        FeatureMap.of("cosine", OMEGA, c_norm="other")
    with pytest.raises(TypeError):
        FeatureMap.of("sawtooth", OMEGA).grad(x)


def test_weights_groups_merging_and_rollup(frame):
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    w = 0.5 + np.arange(300) % 3
    assert np.allclose(vec(sketch(frame, fmap, ["a", "b"], weight="w")), w @ fmap(DATA))
    even = fmap(DATA[::2]).mean(0)
    groups = sketch(frame, fmap, ["a", "b"], by=["g"])
    assert np.allclose(vec(groups.filter("g = 'u'")), even)
    rolled = rollup(groups, ["g"])
    assert {(r.g, r.level) for r in rolled.collect()} == {(g.g, 0) for g in groups.collect()} | {(None, 1)}
    assert np.allclose(vec(rolled.filter("g is null")), fmap(DATA).mean(0)) and np.allclose(vec(rolled.filter("g = 'u'")), even)
    parts = [sketch(frame.filter(F.col("id") % 3 == r), fmap, ["a", "b"]) for r in range(3)]
    assert np.allclose(vec(merge(parts)), fmap(DATA).mean(0))
    v = frame.select(F.array("a", "b").alias("v"))
    for backend in ("arrow", "catalyst"):
        assert np.allclose(vec(sketch(v, fmap, vector="v", backend=backend)), fmap(DATA).mean(0))
    assert np.allclose(sketch_callable(frame, lambda x: np.array([x.sum(), 1j * x[0]]), ["a", "b"]), [DATA.sum(1).mean(), 1j * DATA[:, 0].mean()])


def test_nulls_and_empty_data(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 0.0)], "a double, b double")
    fmap = FeatureMap.of("cosine", OMEGA)
    z, n = to_vector(sketch(df, fmap, ["a", "b"]))
    assert n == 1 and np.allclose(z, fmap(np.array([1.0, 2.0])))
    with pytest.raises(Exception, match="null or not finite"):
        sketch(df, fmap, ["a", "b"], nulls="error").collect()
    with pytest.raises(ValueError, match="empty"):
        to_vector(sketch(df.filter("a > 5"), fmap, ["a", "b"]))


def test_plan_reads_only_feature_columns(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "t"))
    plan = sketch(spark.read.parquet(str(tmp_path / "t")), FeatureMap.of("cosine", OMEGA), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:double,b:double>" in plan


def test_laws():
    sigma = np.array([[2.0, 0.8], [0.8, 1.0]])
    w = frequencies.draw("g", 2, 200_000, sigma, seed=1)
    assert np.allclose(w @ w.T / 200_000, np.linalg.inv(sigma), atol=0.02)
    for name in ("FG", "ArKm", "adaptedradius"):
        assert frequencies.draw(name, 3, 50, 2.0, seed=2).shape == (3, 50)
    r = np.linalg.norm(frequencies.draw("AR", 2, 100_000, seed=3), axis=0)
    grid = np.linspace(0, 5, 2001)
    p = density.adapted_radius(grid)
    assert abs(r.mean() - (p * grid).sum() / p.sum()) < 0.01
    mixed = frequencies.draw("g", 2, 2000, (np.array([0.5, 0.5]), np.array([1e-4, 1.0])), seed=4)
    assert 700 < (np.linalg.norm(mixed, axis=0) > 10).sum() < 1300
    cats = frequencies.draw("g", 3, 500, 1.0, [0, 4, 3], seed=5)
    assert (((cats[1] != 0).astype(int) + (cats[2] != 0)) <= 1).all() and np.allclose(cats[1] * 4 / (2 * np.pi) % 1 % 1, 0, atol=1e-9)
    assert frequencies.of_gaussian_difference(2, 10, ([1.0], [1.0]), ([0.5], [0.5]), seed=6).shape == (2, 10)
    for bad in (lambda: frequencies.draw("none", 2, 3), lambda: frequencies.draw("g", 2, 3, -1.0), lambda: frequencies.draw("g", 2, 3, np.eye(3))):
        with pytest.raises(ValueError):
            bad()
    assert np.array_equal(frequencies.draw("g", 2, 5, seed=9), frequencies.draw("g", 2, 5, seed=9))


def test_density_helpers():
    assert abs(density.chi2_quantile(0.95, 2) - 5.991464547107979) < 1e-9 and abs(density.chi2_quantile(0.5, 5) - 4.351460191095526) < 1e-8
    with pytest.warns(UserWarning):
        density.difference_of_gaussians(np.linspace(0, 1, 3), ([0.1], [1.0]), ([1.0], [1.0]))


def test_sketches_of_models(spark):
    fmap = FeatureMap.of("ComplexExponential", OMEGA * 0.3, XI)
    mix = Mixture(np.array([0.3, 0.7]), np.array([[0.0, 1.0], [2.0, -1.0]]), np.array([[[1.0, 0.3], [0.3, 0.5]], [[0.2, 0], [0, 0.4]]]))
    x = np.vstack([RNG.multivariate_normal(mix.means[k], mix.covs[k], int(200_000 * mix.weights[k])) for k in (0, 1)])
    z = atoms.mixture_sketch(mix, fmap)
    assert np.abs(z - fmap(x).mean(0)).max() < 0.02
    t = atoms.mixture_sketch_table(spark, mix, fmap).toPandas()
    assert np.allclose(t.re + 1j * t.im, z)
    assert np.allclose(atoms.mixture_sketch(mix, fmap, weighted=False), sum(atoms.gaussian_sketch(mix.means[k], mix.covs[k], fmap.omega, fmap.xi) for k in (0, 1)))
    box = np.array([[-0.5, 1.0], [0, 4]])
    grid = np.stack(np.meshgrid(np.linspace(-0.5, 1, 4001), np.arange(5)), -1).reshape(-1, 2)
    exact = atoms.box_sketch(box, fmap, [0, 5])
    assert np.abs(fmap(grid).mean(0) - exact).max() < 1e-3
    t = atoms.box_sketch_table(spark, box, fmap, [0, 5]).toPandas()
    assert np.allclose(t.re + 1j * t.im, exact)
    assert np.allclose(atoms.box_sketch(box, fmap, raw=True), atoms.box_sketch(box, fmap) * 1.5 * 4)


def test_sensitivities_and_mechanisms(frame):
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI, 0.5)
    assert math.isclose(privacy.sensitivity(fmap, 10), 12 * math.sqrt(2) * 0.5 / 10)
    assert math.isclose(privacy.sensitivity((12, "universalQuantization_complex", 1.0), 1, "replace", 2, True), 2 * math.sqrt(12))
    for args in ((fmap, 1, "other"), (fmap, 1, "UDP", 3), ((2, "cosine", 1.0),)):
        with pytest.raises(ValueError):
            privacy.sensitivity(*args)
    for eps, delta in ((0.1, 1e-6), (1.0, 1e-3), (5.0, 1e-8)):
        s = privacy.gaussian_scale(eps, delta, 2.0)
        assert math.isclose(privacy.delta_of(s, eps, 2.0), delta, rel_tol=1e-6)
    z, n = to_vector(sketch(frame, fmap, ["a", "b"]))
    assert np.array_equal(privacy.private_sketch(frame, fmap, math.inf, ["a", "b"]), z)
    noisy = np.array([privacy.private_vector(z, n, fmap, 2.0, dp="BDP", seed=s) for s in range(4000)])
    b = privacy.sensitivity(fmap, 1, "BDP") / 2.0 / n
    assert np.abs(noisy.mean(0) - z).max() < 0.1 * b + 6 * b / math.sqrt(4000) * math.sqrt(2) and abs((noisy - z).real.var() / (2 * b * b) - 1) < 0.05
    assert len(privacy.private_vector(z, n, fmap, 0.5, 1e-6, seed=1)) == 12
    with pytest.raises(ValueError):
        privacy.private_vector(z, n, fmap, 2.0, 1e-6, analytic=False)
    with pytest.raises(ValueError):
        privacy.private_vector(z, n, fmap, 2.0, split=1.0)


def test_optimisers():
    f = lambda x: (float(((1 - x[:-1]) ** 2).sum() + 100 * ((x[1:] - x[:-1] ** 2) ** 2).sum()), np.concatenate((-2 * (1 - x[:-1]) - 400 * x[:-1] * (x[1:] - x[:-1] ** 2), [0])) + np.concatenate(([0], 200 * (x[1:] - x[:-1] ** 2))))
    x, v = optim.minimize_bounded(f, np.zeros(4), np.full(4, -2.0), np.full(4, 2.0), ftol=1e-14, most=2000)
    assert v < 1e-8 and np.allclose(x, 1, atol=1e-3)
    x, _ = optim.minimize_bounded(f, np.zeros(4), np.full(4, -2.0), np.full(4, 0.5), ftol=1e-14)
    assert x.max() <= 0.5
    for _ in range(20):
        a, b = RNG.normal(size=(12, 6)), RNG.normal(size=12)
        x = optim.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-8).all() and abs(g @ x) < 1e-8
        y = optim.bounded_lsq(a, b, 0, 0.3)
        g = a.T @ (a @ y - b)
        assert ((g > -1e-4) | (y > 0.3 - 1e-9)).all() and ((g < 1e-4) | (y < 1e-9)).all()
    h = RNG.normal(size=9)
    p = optim.simplex_projection(h)
    assert abs(p.sum() - 1) < 1e-12 and (p >= 0).all() and np.ptp((h - p)[p > 0]) < 1e-12


def test_simplex_projection_of_a_table(spark):
    rows = [(g, k, float(v)) for g in range(3) for k, v in enumerate(RNG.normal(size=5))]
    t = histogram.project_table(spark.createDataFrame(rows, "g int, k int, h double"), ["g"], "k", "h").toPandas()
    for _, part in t.groupby("g"):
        assert np.allclose(part.sort_values("k").p, optim.simplex_projection(part.sort_values("k").h.to_numpy()))


TRUE = np.array([[-0.6, -0.5], [0.6, -0.4], [0.0, 0.7]])
BOUNDS = np.array([[-1.0, -1.0], [1.0, 1.0]])


@pytest.fixture(scope="module")
def clusters():
    return np.vstack([c + 0.07 * RNG.standard_normal((700, 2)) for c in TRUE])


def near(found, wanted=TRUE, tol=0.08):
    return all(np.linalg.norm(found - c, axis=1).min() < tol for c in wanted)


def test_atoms_have_right_derivatives():
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    g = RNG.normal(size=(12, 2)) + 1j * RNG.normal(size=(12, 2))
    for family in (solvers.Points(fmap, BOUNDS), solvers.Gaussians(fmap, BOUNDS), solvers.Gaussians(fmap, BOUNDS, "full")):
        theta = np.array([family.start(np.random.default_rng(s)) for s in (1, 2)])
        got = family.pull(theta, family.sketch(theta), g)
        for k in range(2):
            for i in range(theta.shape[1]):
                d = np.zeros_like(theta)
                d[k, i] = 1e-6
                diff = (family.sketch(theta + d) - family.sketch(theta - d)) / 2e-6
                assert abs((diff.conj() * g).real.sum() - got[k, i]) < 1e-4


def test_learning_from_a_sketch(spark, clusters):
    fmap = FeatureMap.of("ComplexExponential", frequencies.draw("AR", 2, 120, 0.02, seed=1))
    z = fmap(clusters).mean(0)
    sol = solvers.kmeans_from_sketch(z, fmap, 3, BOUNDS, runs=2, seed=3)
    assert near(sol.theta) and np.allclose(sol.weights, 1 / 3, atol=0.05) and abs(sol.weights.sum() - 1) < 1e-12
    costs = [solvers.kmeans_from_sketch(z, fmap, 3, BOUNDS, runs=r, seed=3).cost for r in (1, 3)]
    assert costs[1] <= costs[0]
    # splitting starts from one wide atom, so frequencies have to fit the whole spread, too
    fmap = FeatureMap.of("ComplexExponential", frequencies.draw("AR", 2, 120, 0.1, seed=1))
    z = fmap(clusters).mean(0)
    for cov in ("diag", "full"):
        for method in ("pursuit", "splitting"):
            mix, _ = solvers.mixture_from_sketch(z, fmap, 3, BOUNDS, cov, method, runs=5 if method == "splitting" else 2, seed=1)
            assert near(mix.means, tol=0.15), (cov, method)
            if method == "pursuit":
                assert 0.001 < np.median([np.trace(c) / 2 for c in mix.covs]) < 0.02
    assert near(solvers.mixture_from_sketch(z, fmap, 3, BOUNDS, runs=2, seed=1, start_variance="sketch")[0].means, tol=0.15)
    one, _ = solvers.mixture_from_sketch(z, fmap, 1, BOUNDS, method="splitting")
    assert one.k == 1
    best = solvers.fit_restarts(spark, lambda: solvers.Pursuit(solvers.Points(fmap, BOUNDS), z, 3), 2, seed=3).orderBy("cost").first()
    assert near(np.array(best["theta"]))


def test_quantised_sketches_and_dimension_subsets(clusters):
    xi = frequencies.dither(200, seed=4)
    quantised = FeatureMap.of("universalQuantization_complex", frequencies.draw("ARKM", 2, 200, 0.02, seed=5), xi)
    sol = solvers.kmeans_from_sketch(quantised(clusters).mean(0), quantised.with_wave("ComplexExponential", 4 / math.pi), 3, BOUNDS, runs=2, seed=1)
    assert near(sol.theta, tol=0.12)
    data = np.stack((clusters[:, 0], RNG.uniform(-1, 1, len(clusters))), 1)
    fmap = FeatureMap.of("ComplexExponential", frequencies.draw("AR", 2, 200, 0.05, seed=6))
    sol = solvers.kmeans_from_sketch(fmap(data).mean(0), fmap, 3, BOUNDS, runs=2, seed=1, dims=[0])
    assert sol.theta.shape == (3, 1) and near(sol.theta, TRUE[:, :1], 0.15)


def test_scale_estimates(spark):
    x = 0.3 * RNG.standard_normal((4000, 2))
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    sigma = scale.estimate_scale(df, ["a", "b"], 200, sample=1000, seed=1)
    assert 0.04 < sigma[0, 0] < 0.2 and scale.exact_sample(df, 123).count() == 123
    w, covs = scale.estimate_scale(df, ["a", "b"], 200, k=2, sample=1000, seed=1)
    assert abs(w.sum() - 1) < 1e-9 and covs.shape == (2, 2, 2)
    r, size = RNG.random(40), RNG.random(40)
    t = scale.block_extremes_table(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r, size, strict=True))], "j int, r double, size double"), 5, 40).orderBy("block").toPandas()
    assert np.allclose(t["size"], scale.block_extremes(r, size, 5)[1])
    with pytest.raises(ValueError):
        scale.block_extremes(r[:3], size[:3], 5)


def test_histograms():
    x = np.concatenate((RNG.uniform(0, 0.5, 15_000), RNG.uniform(0.5, 1, 5_000)))[:, None]
    fmap = FeatureMap.of("ComplexExponential", frequencies.draw("g", 1, 80, 0.01, seed=1))
    z, domain = fmap(x).mean(0), np.array([[0.0, 1.0]])
    for f in (histogram.histogram_mmd, histogram.histogram_m2m):
        assert np.abs(f(z, fmap, domain, 0, bins=4) - [0.375, 0.375, 0.125, 0.125]).max() < 0.05
    c = RNG.choice(4, 20_000, p=[0.4, 0.3, 0.2, 0.1])[:, None].astype(float)
    fmap = FeatureMap.of("ComplexExponential", frequencies.draw("g", 1, 60, 1.0, [4], seed=2))
    for f in (histogram.histogram_mmd, histogram.histogram_m2m):
        assert np.abs(f(fmap(c).mean(0), fmap, np.array([[0, 3]]), 0, [4]) - [0.4, 0.3, 0.2, 0.1]).max() < 0.05


def test_metrics_and_em(spark, clusters):
    df = spark.createDataFrame(clusters.tolist(), "a double, b double")
    d = ((clusters[:, None] - TRUE) ** 2).sum(2)
    assert math.isclose(mixtures.sse(df, TRUE, ["a", "b"]), d.min(1).sum(), rel_tol=1e-9)
    got = mixtures.assign(df.withColumn("v", F.array("a", "b")), TRUE, vector="v").toPandas()
    assert math.isclose(got.distance2.sum(), d.min(1).sum(), rel_tol=1e-9)
    mix = Mixture(np.full(3, 1 / 3), TRUE, np.repeat(0.0049 * np.eye(2)[None], 3, 0))
    dens = sum(np.exp(density.log_normal_density(clusters, TRUE[k], mix.covs[k])) for k in range(3)) / 3
    assert math.isclose(mixtures.log_likelihood(df, mix, ["a", "b"]), np.log(dens).mean(), rel_tol=1e-9)
    resp = mixtures.responsibilities(df, mix, ["a", "b"]).agg(F.min(F.col("r0") + F.col("r1") + F.col("r2")), F.max(F.col("r0") + F.col("r1") + F.col("r2"))).first()
    assert abs(resp[0] - 1) < 1e-12 and abs(resp[1] - 1) < 1e-12
    far = spark.createDataFrame([(100.0, 100.0)], "a double, b double")
    assert math.isfinite(mixtures.log_likelihood(far, mix, ["a", "b"])) and math.isfinite(mixtures.log_likelihood(df, Mixture(np.ones(1), TRUE[:1], np.zeros((1, 2, 2))), ["a", "b"]))
    start = Mixture(np.full(3, 1 / 3), TRUE + 0.1, np.repeat(0.1 * np.eye(2)[None], 3, 0))
    last = -math.inf
    for _ in range(6):
        start, ll = mixtures.em_step(df, start, ["a", "b"])
        assert ll >= last - 1e-9
        last = ll
    assert near(start.means)
    assert mixtures.em(df, 3, ["a", "b"], rounds=3)[1] > -5
    assert abs(mixtures.symmetric_kl(spark, mix, mix, 2000)) < 1e-12
    one, two = (Mixture(np.ones(1), np.array([[m, 0.0]]), np.eye(2)[None]) for m in (0.0, 1.0))
    assert abs(mixtures.symmetric_kl(spark, one, two, 60_000) - 0.5) < 0.03
    e = mixtures.ellipses(spark, Mixture(np.ones(1), np.zeros((1, 2)), np.diag([4.0, 1.0])[None])).first()
    assert math.isclose(e["width"] / e["height"], 2) and abs(e["angle"]) < 1e-9


def test_datasets(spark):
    rows, mix = datasets.gmm(spark, 2, 3, 3000, "all", "l_2-unit-ball", seed=1, balanced=0.5, grid_aligned=False, variability_within=1.0)
    p = rows.toPandas()
    x = np.array(p.x.tolist())
    assert len(p) == 3000 and np.linalg.norm(x, axis=1).max() <= 1 and set(p.y) == {0, 1, 2}
    k = p.y.value_counts().idxmax()
    assert np.allclose(x[p.y == k].mean(0), mix.means[k], atol=0.05) and np.allclose(np.cov(x[p.y == k].T), mix.covs[k], rtol=0.35, atol=2e-3)
    c = datasets.circles(spark, 3, 100, seed=2).toPandas()
    assert c.y.value_counts().to_dict() == {0: 33, 1: 33, 2: 34}
    s, pdf = datasets.spiral(spark, 500, "l_inf-unit-ball", True, seed=3)
    grid = spark.range(400 * 400).select((F.col("id") % 400 / 200.0 - 1 + 1 / 400).alias("a"), (F.floor(F.col("id") / 400) / 200.0 - 1 + 1 / 400).alias("b"))
    assert abs(grid.agg(F.sum(pdf(F.col("a"), F.col("b")))).first()[0] / 200**2 - 1) < 0.1 and s.count() == 500
    k = np.array(datasets.k_sparse(spark, 6, 2, 200, 2.0, seed=4).toPandas().x.tolist())
    assert ((k != 0).sum(1) <= 2).all() and np.linalg.norm(k, axis=1).max() <= 2
    with pytest.raises(ValueError):
        datasets.gmm(spark, 2, 3, 10, "other")
    with pytest.raises(ValueError):
        datasets.norm_scale(rows, "x", "l_3")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", float(i % 7) / 7, float(i % 5) / 5) for i in range(90)]
    df = spark.createDataFrame(rows, "ts string, a double, b double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    stream = windowed_sketch(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), fmap, ["a", "b"], "ts", "1 day", late="10 days")
    q = stream.writeStream.format("memory").queryName("sketches").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = ["start", "j"]
    got, want = (t.toPandas().sort_values(key).reset_index(drop=True) for t in (spark.table("sketches"), windowed_sketch(df, fmap, ["a", "b"], "ts", "1 day")))
    assert len(want) == 36 and np.allclose(got[["re", "im", "n"]], want[["re", "im", "n"]])


def test_sessions_end_at_pauses(spark):
    rows = [("u", "2024-01-01 00:00:00", 0.1), ("u", "2024-01-01 00:05:00", 0.2), ("u", "2024-01-01 02:00:00", 0.3), ("v", "2024-01-01 00:05:00", 0.4)]
    df = spark.createDataFrame(rows, "k string, ts string, a double").withColumn("ts", F.to_timestamp("ts"))
    fmap = FeatureMap.of("cosine", OMEGA[:1], XI)
    from tessera.streaming.sketch import session_sketch

    got = session_sketch(df, fmap, ["a"], "ts", "30 minutes", ["k"]).filter("j = 0").orderBy("k", "start").collect()
    assert [(r.k, r.n) for r in got] == [("u", 2), ("u", 1), ("v", 1)]
    assert np.isclose(got[0].re, fmap(np.array([[0.1], [0.2]])).mean(0)[0])


def test_mixture_conversions():
    mix = Mixture(np.array([0.4, 0.6]), TRUE[:2], np.array([[[0.04, 0.01], [0.01, 0.02]], [[0.03, 0.0], [0.0, 0.05]]]))
    two = solvers.split_mixture(mix)
    assert two.k == 4 and np.allclose(two.weights.sum(), 1) and np.allclose(two.means[:2] + two.means[2:], 2 * mix.means)
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    family = solvers.Gaussians(fmap, BOUNDS, "full")
    assert np.allclose(family.sketch(family.parameters(mix)).T, [atoms.gaussian_sketch(mix.means[k], mix.covs[k], OMEGA, XI) for k in (0, 1)])
    z = atoms.mixture_sketch(mix, fmap)
    solver = solvers.Pursuit(family, None, 2)
    with pytest.raises(ValueError):
        solver.fit()
    start = solvers.Solution(mix.weights, family.parameters(mix), 0.0)
    again = family.mixture(solver.with_sketch(2 * z, 0.5).fit(seed=1, iterations=0, start=start))
    assert np.allclose(again.means, mix.means, atol=1e-3) and np.allclose(again.covs, mix.covs, atol=1e-3)
    assert np.linalg.eigvalsh(solvers.feasible(np.array([[1.0, 2.0], [2.0, 1.0]])))[0] > 0


def test_sketches_can_be_kept(spark, frame, tmp_path):
    from tessera.sources import tables

    frame.write.parquet(str(tmp_path / "t"))
    df = tables.read_features(spark, str(tmp_path / "t"), {"x": "a / 2", "y": "b"}, ("g",))
    assert np.allclose(tables.bounds(df, ["x", "y"]), np.stack((DATA.min(0), DATA.max(0))) / [2, 1])
    fmap = FeatureMap.of("sawtooth_complex", OMEGA, XI, "unit")
    s = sketch(df, fmap, ["x", "y"], by=["g"])
    tables.write_sketch(s, fmap, str(tmp_path / "s"))
    back, same = tables.read_sketch(spark, str(tmp_path / "s"))
    assert np.allclose(same(DATA[0]), fmap(DATA[0])) and np.allclose(vec(back.filter("g = 'u'")), fmap(DATA[::2] / [2, 1]).mean(0))
    with pytest.raises(ValueError):
        tables.write_sketch(s, fmap.with_wave(np.cos), str(tmp_path / "u"))


def test_odd_vectors_and_numbers_are_left_out(spark):
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    good = [[1.0, 2.0], [0.5, -1.0]]
    odd = [[1.0], [1.0, 2.0, 3.0], [float("inf"), 0.0], [0.0, float("-inf")], [None, 1.0], [], None]
    df = spark.createDataFrame([(v,) for v in good + odd], "v array<double>")
    for backend in ("arrow", "catalyst"):
        z, n = to_vector(sketch(df, fmap, vector="v", backend=backend))
        assert n == 2 and np.allclose(z, fmap(np.array(good)).mean(0))
    with pytest.raises(Exception, match="another length"):
        sketch(df, fmap, vector="v", nulls="error").collect()
    wide = FeatureMap.of("cosine", np.ones((200, 100)))
    with pytest.raises(ValueError, match="arrow"):
        sketch(df, wide, vector="v", backend="catalyst")


def test_many_groups_are_given_out_in_parts(spark, monkeypatch):
    from tessera.operators import sketch as module

    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    monkeypatch.setattr(module, "HELD", 2000)
    monkeypatch.setattr(module, "CELLS", 7 * fmap.m)
    x = RNG.normal(size=(400, 2))
    rows = [(float(a), float(b), i % 23 if i % 29 else None, 1.0 + i % 3) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, g long, w double")
    got = sketch(df, fmap, ["a", "b"], by=["g"], weight="w").toPandas()
    for g in (None, 0, 22):
        at = [i for i, r in enumerate(rows) if r[2] == g]
        mine = (got[got.g.isna()] if g is None else got[got.g == g]).sort_values("j")
        assert np.allclose(mine.re + 1j * mine.im, np.array([rows[i][3] for i in at]) @ fmap(x[at])) and (mine.n == len(at)).all()


def test_sketches_of_different_kinds_dont_merge(frame):
    fmap = FeatureMap.of("ComplexExponential", OMEGA, XI)
    with pytest.raises(Exception, match="don't merge"):
        merge([sketch(frame, fmap, ["a", "b"]), sketch(frame, fmap, ["a", "b"], weight="w")]).collect()
    z = sketch_callable(frame, lambda x: np.stack([x[:, 0], x.prod(1)], 1), ["a", "b"], rows=True)
    assert np.allclose(z, [DATA[:, 0].mean(), DATA.prod(1).mean()])


def test_unseeded_noise_has_its_scale():
    noise = privacy._Noise()
    a, b = noise.normal(2.0, 20_000), noise.laplace(2.0, 20_000)
    assert abs(a.std() - 2) < 0.1 and abs(np.abs(b).mean() - 2) < 0.1 and abs(b.mean()) < 0.1 and not np.array_equal(a, privacy._Noise().normal(2.0, 20_000))


def test_assignment_of_odd_rows(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([2.0, 1.0], 2), (None, 3), ([1.0], 4), ([float("nan"), 1.0], 5), ([1.0, 0.0], 6)], "v array<double>, i int")
    got = {r.i: (r.cluster, r.distance2) for r in mixtures.assign(df, np.array([[0.0, 0.0], [2.0, 0.0]]), vector="v").collect()}
    assert got == {1: (0, 0.0), 2: (1, 1.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (0, 1.0)}
