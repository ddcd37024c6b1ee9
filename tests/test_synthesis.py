"""Private synthesis: one neighbour relation, one scan for all clusters, tables of any degree, discrete noise, sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions.rand import Noise, laplace_bits, normal_table
from veilspark.operators import marginals, privacy, sampling, synth
from veilspark.operators.generator import GeneratorConfig, Mixture
from veilspark.sources import schema as S

TOY = S.PublicSchema("toy", {"x": (0.0, 100.0)}, {"c": ("a", "b", "d"), "e": ("p", "q")}, "label", "1", key="id")
SIZES = marginals.sizes(TOY)


def rows_of(spark, n, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    data = [(i, float(rng.random()), "abd"[rng.integers(0, 2) + int(y[i])], "pq"[int(y[i])], int(y[i]), int(i % k)) for i in range(n)]
    return spark.createDataFrame(data, "row_id long, x double, c string, e string, target int, cluster_id int")


def coded_of(spark, n, k=3):
    return marginals.encode_rows(rows_of(spark, n, k), TOY, keep=["cluster_id"])


def methods():
    return [
        synth.MarginalMethod(SIZES, 2.0), synth.MarginalMethod(SIZES, 2.0, target_only=False), synth.GeneratorMethod(SIZES, 2.0, config=GeneratorConfig(rounds=3, inner=5)),
        synth.GeneratorMethod(SIZES, 2.0, config=GeneratorConfig(rounds=3, inner=5, target_star=True)), synth.GeneratorMethod(SIZES, 2.0, config=GeneratorConfig(rounds=3, inner=5, degree=3)),
    ]


def tables_of(spark, method, n):
    """cluster -> set -> exact counts."""
    release = synth.Release(0, method, 3, Noise.test(5))
    cells = synth.cluster_cells(coded_of(spark, n).withColumn("release", F.lit(0)), method.sets(), SIZES, [release]).toPandas()
    return {c: {i: h.sort_values("at").n.to_numpy() for i, h in g.groupby("set_id")} for c, g in cells.groupby("cluster_id")}


def noise_of(spark, method, n, monkeypatch):
    """(cluster, set) -> (sigma, noise) of every table that a fit of n rows releases."""
    seen = {}
    real = synth.noisy_table

    def spy(counts, sigma, noise, cluster_id, set_id):
        m = real(counts, sigma, noise, cluster_id, set_id)
        seen[cluster_id, set_id] = sigma, (m - counts).tolist()
        return m

    monkeypatch.setattr(synth, "noisy_table", spy)
    for c, tables in tables_of(spark, method, n).items():
        method.fit(tables, c, Noise.test(5))
    monkeypatch.undo()
    return seen


@pytest.mark.parametrize("i", [0, 2, 3, 4])
def test_no_noise_scale_depends_on_the_rows(spark, i, monkeypatch):
    method = methods()[i]
    few, many = noise_of(spark, method, 100, monkeypatch), noise_of(spark, method, 101, monkeypatch)
    both = few.keys() & many.keys()  # a generator may choose other tables
    assert both and all(few[k] == many[k] for k in both) and {k: v[0] for k, v in few.items()}.keys() >= {(c, s) for c, s in both}
    assert {v[0] for v in few.values()} == {v[0] for v in many.values()} and any(any(v[1]) for v in few.values())


def test_noise_inside_tasks_is_the_columns(spark):
    for noise in (Noise.test(3), Noise.secret()):
        df = spark.range(40).select(noise.discrete_normal(2.5, "cell", 1, F.col("id")).alias("a"), noise.discrete_normal(700.0, "cell", 1, F.col("id")).alias("b"), noise.integer("x", F.col("id")).alias("c"), noise.laplace(F.lit(2.0), "l").alias("d"), noise.uniform("u", 4).alias("e"))
        rows = df.toPandas()
        assert rows.a.tolist() == noise.discrete_normals(2.5, ("cell", 1), range(40)) and rows.b.tolist() == noise.discrete_normals(700.0, ("cell", 1), range(40))
        assert rows.c.tolist() == noise.integers(("x", i) for i in range(40)) and rows.d[0] == pytest.approx(noise.laplace_number(2.0, "l")) and rows.e[0] == noise.number("u", 4)
    keyed = spark.createDataFrame([("3",), ("4",)], "key string").select(Noise(F.col("key")).uniform("u", 1).alias("u")).collect()
    assert [r.u for r in keyed] == [Noise.test(3).number("u", 1), Noise.test(4).number("u", 1)]


def test_scales_are_public():
    a = synth.GeneratorMethod(SIZES, 1.0)
    count, choice, table = a.scales()
    rho, rounds = synth.zcdp(1.0, 1e-5), a.rounds()
    spent = 1 / (2 * count**2) + rounds * (1 / (2 * table**2) + (2 / choice) ** 2 / 8)  # all releases of one fit
    assert spent == pytest.approx(rho)
    sigmas = synth.view_sigmas({("x", "target"): 16, ("c", "target"): 6}, [("x", "target"), ("c", "target")], rho)
    assert sum(1 / (2 * s**2) for s in sigmas.values()) == pytest.approx(rho)
    assert synth.GeneratorMethod(SIZES, math.inf).scales() == (0.0, 0.0, 0.0)


def test_an_added_row_changes_one_cluster(spark):
    """Clusters compose in parallel: tables of neighbours differ in one cluster, by one in one cell of each set."""
    groups = spark.range(3).select(F.col("id").cast("int").alias("cluster_id"))
    method = synth.GeneratorMethod(SIZES, 1.0)
    cells = lambda n: {(r.cluster_id, r.set_id, r["at"]): r.n for r in marginals.marginal_tables(coded_of(spark, n), method.sets(), SIZES, ["cluster_id"], groups).collect()}
    rng_same = rows_of(spark, 101).filter("row_id < 100")  # the same first rows
    few = {(r.cluster_id, r.set_id, r["at"]): r.n for r in marginals.marginal_tables(marginals.encode_rows(rng_same, TOY, keep=["cluster_id"]), method.sets(), SIZES, ["cluster_id"], groups).collect()}
    many = cells(101)
    changed = [(k, many[k] - few[k]) for k in many if many[k] != few[k]]
    assert {k[0] for k, _ in changed} == {100 % 3} and all(d == 1 for _, d in changed) and len(changed) == len(method.sets())


@pytest.mark.parametrize("i", range(5))
def test_all_clusters_from_one_scan_equal_each_alone(spark, i):
    method, coded = methods()[i], coded_of(spark, 300)
    noise = Noise.test(9)
    assert len(tables_of(spark, method, 300)) == 3
    together = synth.cluster_models(coded, method, 3, noise)
    for c in range(3):
        alone = synth.cluster_models(coded.filter(F.col("cluster_id") == c), method, 3, noise)
        assert alone[c] == together[c] is not None
    pools = synth.draw_pools(spark, together, method, 50, noise)
    assert pools.groupBy("cluster_id").count().orderBy("cluster_id").collect() == [(0, 50), (1, 50), (2, 50)]
    one = synth.draw_pools(spark, [None, together[1], None], method, 50, noise)
    key = lambda df: sorted(map(tuple, df.filter("cluster_id = 1").collect()))
    assert key(one) == key(pools)


def test_private_rows_are_scanned_once_whatever_k(spark, tmp_path):
    coded_of(spark, 90).write.parquet(f"{tmp_path}/rows")
    tracker = spark.sparkContext.statusTracker()
    for k in (2, 7):
        coded = spark.read.parquet(f"{tmp_path}/rows").withColumn("cluster_id", F.pmod(F.col("cluster_id"), F.lit(k)))
        cells = marginals.marginal_tables(coded, methods()[0].sets(), SIZES, ["cluster_id"], spark.range(k).select(F.col("id").cast("int").alias("cluster_id")))
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        spark.sparkContext.setJobGroup(f"k{k}", "models")
        assert len(synth.cluster_models(coded, methods()[0], k, Noise.test(1))) == k
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("k7")) <= len(tracker.getJobIdsForGroup("k2")) + 1  # adaptive planning may add a job


def test_answers_of_any_degree():
    m = Mixture({"a": 3, "b": 4, "c": 2}, GeneratorConfig(components=6, latent=5), 1)
    p = m.parts()
    want = np.einsum("ki,kj,kl->ijl", p["a"], p["b"], p["c"]) / 6
    assert np.allclose(m.answer(("a", "b", "c")), want) and np.allclose(m.answer(("c", "a")), want.sum(axis=1).T) and np.allclose(m.answer(("b",)), want.sum(axis=(0, 2)))


@pytest.mark.parametrize("set_", [("a",), ("b", "a"), ("a", "b", "c")])
def test_gradients_are_right(set_):
    """One small step lowers the loss by what the numeric gradient foretells."""
    attributes = {"a": 3, "b": 4, "c": 2}
    m = Mixture(attributes, GeneratorConfig(components=4, latent=3, inner=0), 2)
    goal = np.random.default_rng(3).dirichlet(np.ones(math.prod(attributes[a] for a in set_))).reshape([attributes[a] for a in set_])
    loss = lambda: 0.5 * ((m.answer(set_) - goal) ** 2).sum()
    numeric = {}
    for a, w in m.maps.items():
        numeric[a] = np.zeros_like(w)
        for at in np.ndindex(w.shape):
            w[at] += 1e-6
            up = loss()
            w[at] -= 2e-6
            numeric[a][at] = (up - loss()) / 2e-6
            w[at] += 1e-6
    object.__setattr__(m.config, "inner", 1)
    m.fit({set_: goal})
    for a in attributes:  # after one step, Adam's mean is a tenth of the gradient
        assert np.allclose(m.means[a] / 0.1, numeric[a], atol=1e-8)


def test_generator_learns_three_way_tables(spark):
    """x xor y = z: no pair shows it, a table of three does."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    schema = S.PublicSchema("xor", {}, {"a": ("0", "1"), "b": ("0", "1")}, "label", "1", key="id")
    rows = spark.createDataFrame([(i, str(u), str(v), int(u ^ v)) for i, (u, v) in enumerate(zip(a, b))], "row_id long, a string, b string, target int")
    hit = {}
    for degree in (2, 3):
        pool = synth.generator_synthesize(rows, schema, 20.0, 2000, Noise.test(2), config=GeneratorConfig(degree=degree, rounds=4)).toPandas()
        hit[degree] = ((pool.a != pool.b).astype(int) == pool.target).mean()
    assert hit[3] > 0.9 and hit[2] < 0.7


def test_generator_options():
    attributes, goal = {"a": 6, "b": 6}, {("a", "b"): np.random.default_rng(1).dirichlet(np.ones(36)).reshape(6, 6)}

    def fitted(**options):
        m = Mixture(attributes, GeneratorConfig.of(components=8, **options), 0)
        for r in range(4):
            m.fit(goal, r, 4)
        return m

    plain = fitted(latent=8, max_iters=20)
    assert np.abs(plain.answer(("a", "b")) - goal["a", "b"]).sum() < np.abs(Mixture(attributes, GeneratorConfig(components=8, latent=8), 0).answer(("a", "b")) - goal["a", "b"]).sum() / 3
    slow, few = fitted(latent=8, max_iters=20, eta_min=0.0), fitted(latent=8, max_iters=20, max_idxs=5)
    c = GeneratorConfig.of(lr=0.1, eta_min=0.02, T=4)
    assert [round(c.rate_of(r, 4), 4) for r in range(5)] == [0.1, 0.0883, 0.06, 0.0317, 0.02] and GeneratorConfig(rate=0.1).rate_of(3, 4) == 0.1
    for other in (slow, few):
        assert not np.allclose(other.maps["a"], plain.maps["a"])
    fixed, anew = fitted(latent=8, max_iters=3), fitted(latent=8, max_iters=3, resample=True)
    assert (fixed.z == Mixture(attributes, GeneratorConfig(components=8, latent=8), 0).z).all() and not (anew.z == fixed.z).all()
    drawn = [Mixture.restored(attributes, m.config, m.state()).sample(5000, np.random.default_rng(0)) for m in (fixed, anew)]
    assert all(d.shape == (5000, 2) and d.min() >= 0 and d.max() <= 5 for d in drawn) and not (drawn[0] == drawn[1]).all()
    with pytest.raises(ValueError, match="unknown generator options"):
        GeneratorConfig.of(depth=3)
    with pytest.raises(ValueError, match="twice"):
        GeneratorConfig.of(lr=0.1, rate=0.2)
    for bad in ({"T": 0}, {"alpha": 1.0}, {"max_idxs": 0}, {"degree": 0}):
        with pytest.raises(ValueError):
            GeneratorConfig.of(**bad)


def test_simplex_is_the_nearest_point():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v, total = rng.normal(scale=5, size=(3, 4)), float(rng.uniform(0.1, 20))
        p = synth.simplex(v, total)
        assert p.min() >= 0 and p.sum() == pytest.approx(total)
        for _ in range(20):  # no other point of the simplex is nearer
            q = rng.dirichlet(np.ones(12)).reshape(3, 4) * total
            assert ((v - p) ** 2).sum() <= ((v - q) ** 2).sum() + 1e-9
    assert not synth.simplex(np.ones((2, 2)), 0.0).any()


def test_projection_helps_sparse_tables():
    rng = np.random.default_rng(6)
    true = np.zeros((40, 2))
    true[:3] = 400
    cut, kept = [], []
    for _ in range(30):
        noisy = true + np.rint(rng.normal(scale=25, size=true.shape))
        clipped = np.maximum(noisy, 0)
        fitted = synth.consistent({("a", "t"): noisy}, 2, {("a", "t"): 25.0})["a", "t"]
        cut.append(np.abs(clipped / clipped.sum() - true / true.sum()).sum() / 2)
        kept.append(np.abs(fitted / fitted.sum() - true / true.sum()).sum() / 2)
    assert np.mean(kept) < 0.5 * np.mean(cut)


def test_consistent_tables_agree():
    rng = np.random.default_rng(7)
    tables = {("a", "t"): rng.poisson(50, (5, 2)) + rng.normal(scale=3, size=(5, 2)), ("b", "t"): rng.poisson(80, (3, 2)) + rng.normal(scale=3, size=(3, 2)), ("a", "b"): rng.poisson(30, (5, 3)).astype(float)}
    out = synth.consistent(tables, 20)
    assert all(t.min() >= 0 for t in out.values()) and np.ptp([t.sum() for t in out.values()]) < 1e-6
    assert np.allclose(out["a", "t"].sum(axis=0), out["b", "t"].sum(axis=0), atol=1) and np.allclose(out["a", "t"].sum(axis=1), out["a", "b"].sum(axis=1), atol=1)


def test_views_are_worth_their_noise():
    scores = {("a", "t"): 500.0, ("b", "t"): 400.0, ("a", "b"): 900.0, ("a", "c"): 30.0, ("b", "c"): -5.0, ("c", "t"): 3.0}
    cells = dict.fromkeys(scores, 40)
    star = [("a", "t"), ("b", "t"), ("c", "t")]
    assert synth.choose_views(scores, cells, star, 0.5) == [*star, ("a", "b")]  # the weak pair costs more noise than it shows
    assert synth.choose_views(scores, cells, star, math.inf) == [*star, ("a", "b"), ("a", "c")]
    assert synth.choose_views(scores, cells, star, math.inf, 1) == [*star, ("a", "b")] and synth.choose_views(scores, cells, star, 1e-6) == star
    wide = cells | {("a", "b"): 100_000}
    assert ("a", "b") not in synth.choose_views(scores, wide, star, 0.5)


def test_discrete_noise_has_its_distribution(spark):
    n, sigma, eps = 40_000, 1.7, 0.6
    r = spark.range(n).select(Noise.test(2).discrete_normal(sigma, "n", F.col("id")).alias("g"), Noise.test(2).discrete_laplace(eps, "l", F.col("id")).alias("l"), Noise.secret().discrete_normal(900.0, F.col("id")).alias("w")).toPandas()
    assert all(t == np.int64 for t in r.dtypes)
    ks = np.arange(-40, 41)
    for got, weight in ((r.g, np.exp(-(ks**2) / (2 * sigma**2))), (r.l, np.exp(-eps * np.abs(ks)))):
        want = weight / weight.sum()
        found = np.array([(got == k).mean() for k in ks])
        assert np.abs(found - want).sum() / 2 < 0.02
    assert abs(r.w.std() - 900) < 15 and abs(r.w.mean()) < 20
    assert one(spark.range(1).select(Noise.test(1).discrete_normal(0.0, "z"))) == 0 and one(spark.range(1).select(Noise.test(1).discrete_laplace(math.inf, "z"))) == 0
    with pytest.raises(ValueError):
        Noise.test(1).discrete_laplace(0.0)
    table = normal_table(3.0)
    assert len(table) % 2 == 0 and all(a <= b for a, b in zip(table, table[1:])) and (1 << 60) - table[-1] < 1 << 8
    assert all(a > b for a, b in zip(laplace_bits(0.5), laplace_bits(0.5)[1:]))


def one(df):
    return df.first()[0]


def test_counts_release_integers(spark):
    g = rows_of(spark, 200).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    noisy = g.select("n", privacy.noisy_count(F.col("n"), 0.5, Noise.secret(), "c", F.col("c")).alias("m"))
    assert dict(noisy.dtypes)["m"] == "bigint"
    exact = g.select("n", privacy.noisy_count(F.col("n"), math.inf, Noise.secret(), F.col("c")).alias("m")).collect()
    assert all(r.n == r.m for r in exact)


def test_sampling_is_charged_by_amplification(spark):
    assert privacy.amplified(1.0, 0.5) == pytest.approx(math.log(1 + 0.5 * (math.e - 1))) and privacy.amplified(1.0, 1.0) == 1.0
    for e in (0.1, 1.0, 50.0, 800.0):
        assert privacy.amplified(privacy.affordable(e, 0.3), 0.3) == pytest.approx(e)
    ledger = privacy.BudgetLedger(1.0)
    assert ledger.spend("a", 1.2, 0.5) == 1.2 and ledger.total == privacy.amplified(1.2, 0.5) < 1
    with pytest.raises(privacy.BudgetError):
        ledger.spend("a", 1.0)
    for bad in (0.0, 1.5):
        with pytest.raises(ValueError):
            privacy.amplified(1.0, bad)
        with pytest.raises(ValueError):
            privacy.poisson_sample(rows_of(spark, 3), bad, Noise.test(1))
    rows = rows_of(spark, 4000)
    some = privacy.poisson_sample(rows, 0.25, Noise.secret())
    assert 800 < some.count() < 1200 and privacy.poisson_sample(rows, 1.0, Noise.secret()).count() == 4000
    all_, half = (privacy.dp_group_by(rows, TOY, math.inf, 2, Noise.test(3), ["target"], sample_rate=r).toPandas() for r in (1.0, 0.5))
    assert not np.allclose(all_.x, half.x)
    nothing = privacy.dp_group_by(rows.limit(0), TOY, 1.0, 2, Noise.test(3), ["target"], sample_rate=0.5)
    assert nothing.count() == 2


@pytest.mark.parametrize("shots", [1, 3, 4, 9])
def test_group_by_gives_exactly_the_shots(spark, shots):
    rows = rows_of(spark, 100)
    spec = ["target", "c"]
    assert privacy.dp_group_by(rows, TOY, 4.0, shots, Noise.test(1), spec).count() == shots
    assert privacy.dp_group_by(rows, TOY, 4.0, shots, Noise.test(1), spec, exact_shots=False).count() == 4


def test_cut_by_radix_selection(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CUT_ROWS", 8)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    df = spark.range(3000).select(F.floor(F.col("id") / 3).alias("row_id"))  # every key three times
    for take in (1, 2, 1500, 3000):
        h, k = sampling.cut_at(df, take, 3000, 5, "row_id")
        want = sorted((__import__("hashlib").md5(f"5|{i // 3}".encode()).hexdigest(), i // 3) for i in range(3000))
        assert (h, k) == want[take - 1]
    same = spark.range(50).select(F.lit(7).cast("long").alias("row_id"))
    assert sampling.cut_at(same, 20, 50, 5, "row_id")[1] == 7
    plans = []
    seen = sampling.F.count
    monkeypatch.setattr(sampling.F, "count", lambda c: plans.append(1) or seen(c))
    sampling.cut_at(df, 700, 3000, 5, "row_id")
    assert len(plans) > 2  # several levels, and nothing was sorted for a top k


def test_positions_are_dense_without_a_task_for_a_class(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CELL_ROWS", 20)
    df = spark.range(2000).select(F.col("id").alias("pool_id"), (F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 3).cast("int").alias("cluster_id"))
    h = sampling.order_key(4, "pool", F.col("pool_id"))
    out = sampling.positions(df, ["cluster_id", "target"], h, "pool_id", "at", 2000)
    from pyspark.sql import Window

    want = df.withColumn("want", F.row_number().over(Window.partitionBy("cluster_id", "target").orderBy(h, "pool_id")) - 1)
    joined = out.join(want.select("pool_id", "want"), "pool_id")
    assert joined.count() == 2000 and joined.filter("at <> want").isEmpty() and out.columns == [*df.columns, "at"]
