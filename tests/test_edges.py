"""Edge rows, validation, and statistics of the noise."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import exprs
from veilspark.functions.rand import Noise
from veilspark.operators import cluster, encode, marginals, prep, privacy, prompt, sampling, score, synth
from veilspark.operators.generator import GeneratorConfig, Mixture
from veilspark.plans import experiment
from veilspark.plans.cli import parse_args
from veilspark.sources import schema as S
from veilspark.sources import tables

#: A folder of registered CSV datasets, if one is at hand.
CSV_ROOT = os.environ.get("VEILSPARK_CSV_ROOT", "")
TOY = S.PublicSchema("toy", {"x": (0.0, 100.0)}, {"c": ("a", "b", "d")}, "label", "1", key="id")


def one(df):
    return df.first()[0]


def toy(spark, rows):
    return spark.createDataFrame(rows, "row_id long, x double, c string, target int")


def test_clip_and_bins(spark):
    df = spark.createDataFrame([(0, 120.0), (1, -5.0)], "id int, x double")
    assert [r.v for r in df.select("id", exprs.scale(TOY, "x").alias("v")).orderBy("id").collect()] == [1.0, 0.0]
    bins = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.125, 0.9999, 1.0])], "id int, x double")
    assert [r.x_bin for r in exprs.digitize(bins, ["x"], 8).orderBy("id").collect()] == [0, 1, 7, 7]
    values = np.linspace(0, 1, 2001)
    for n in (7, 8, 10, 16):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, x double")
        found = [r.x_bin for r in exprs.digitize(df, ["x"], n).orderBy("id").collect()]
        assert found == np.digitize(values, np.array(exprs.edges(n))[1:-1]).tolist()


def test_labels(spark):
    df = spark.createDataFrame([("0",), ("1",), ("1.0",)], "label string")
    assert prep.numeric_labels(df, "label", "1")
    assert [r[0] for r in df.select(prep.binarize(F.col("label"), "1", True)).collect()] == [0, 1, 1]
    df = spark.createDataFrame([(" >50k ",), ("<=50K",)], "label string")
    assert not prep.numeric_labels(df, "label", ">50K")
    assert [r[0] for r in df.select(prep.binarize(F.col("label"), ">50K", False)).collect()] == [1, 0]


def test_clean_drops_marks_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("?", 2), (None, 3), ("b", None)], "c string, x int")
    assert [r.c for r in prep.clean(df).collect()] == ["a"]
    assert prep.lower_names(spark.createDataFrame([(1,)], "` A b ` int")).columns == ["a b"]


def test_modes_and_means(spark):
    tie = toy(spark, [(1, 0.5, "a", 1), (2, 0.5, "b", 1)])
    out = privacy.dp_group_by(tie, TOY, math.inf, 2, Noise.test(1), ["target"]).orderBy("key_id").collect()
    assert out[1]["c"] == "a" and out[0]["x"] == 0.5 and out[0]["c"] == "a"  # tie; empty group
    with pytest.raises(privacy.BudgetError):
        privacy.noisy_mean(F.lit(1.0), F.lit(1), 0.0, Noise.test(1))


def test_budget_ledger():
    ledger = privacy.BudgetLedger(1.0)
    ledger.spend("a", 0.6)
    ledger.spend("b", 1.0)
    with pytest.raises(privacy.BudgetError):
        ledger.spend("a", 0.5)
    assert ledger.total == 1.0 and sum(privacy.split_budget(2.0, 0.3)) == pytest.approx(2.0)


def test_noise_statistics(spark):
    n = spark.range(20000).select(Noise.test(3).laplace(2.0, "z", F.col("id")).alias("z"), Noise.secret().normal(1.5, F.col("id")).alias("g"), Noise.test(3).discrete_laplace(1.0, F.col("id")).alias("k"))
    r = n.agg(F.avg("z"), F.stddev("z"), F.avg("g"), F.stddev("g"), F.avg("k")).first()
    assert abs(r[0]) < 0.1 and abs(r[1] - math.sqrt(8)) < 0.15 and abs(r[2]) < 0.06 and abs(r[3] - 1.5) < 0.05 and abs(r[4]) < 0.05
    for scale in (0.0, -1.0, math.inf, math.nan):
        assert one(spark.range(1).select(Noise.test(1).laplace(scale, "a"))) == 0.0


@pytest.mark.parametrize("n,size", [(2, 1), (5, 1), (10, 1), (19, 1), (40, 4)])
def test_split_sizes(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    a, b = sampling.disjoint_split(df, 0.1, 5)
    left, right = {r.row_id for r in a.collect()}, {r.row_id for r in b.collect()}
    assert len(left) == size and not left & right and len(left | right) == n


def test_split_errors(spark):
    with pytest.raises(ValueError):
        sampling.disjoint_split(spark.range(1).withColumnRenamed("id", "row_id"), 0.1, 5)
    with pytest.raises(ValueError):
        sampling.disjoint_split(spark.range(9).withColumnRenamed("id", "row_id"), 1.0, 5)


def test_demos(spark):
    q = spark.createDataFrame([(i,) for i in range(6)], "query_id long")
    pool = spark.createDataFrame([(i, i % 2) for i in range(20)], "pool_id long, target int")
    out = sampling.balanced_demos(q, pool, 5, 1).toPandas()
    assert (out.groupby("query_id").target.sum() == 2).all() and (out.groupby("query_id").size() == 5).all()
    assert not out.duplicated(["query_id", "pool_id"]).any()
    single = sampling.balanced_demos(q, pool.filter("target = 1"), 3, 1).toPandas()
    assert (single.target == 1).all() and (single.groupby("query_id").size() == 3).all()
    short = sampling.balanced_demos(q, pool.filter("target = 0 OR pool_id = 1"), 8, 1).toPandas()
    assert (short.groupby("query_id").target.sum() == 4).all()


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("zz",), (None,)], "c string")
    assert [r[0] for r in df.select(exprs.code(F.col("c"), TOY.domain("c"))).collect()] == [1, 0, 0]
    with pytest.raises(Exception, match="outside its public domain"):
        df.select(exprs.code(F.col("c"), TOY.domain("c"), strict=True)).collect()
    back = df.filter("c = 'b'").select(exprs.decode(exprs.code(F.col("c"), TOY.domain("c")), TOY.domain("c")))
    assert one(back) == "b"


def test_onehot(spark):
    spec = encode.onehot_spec(S.PublicSchema("t", {}, {"c": tuple("abcdefgh")}, "label", "1"), {"c": 2.0})
    assert spec.blocks[0][2] == 0.5
    unknown = spark.createDataFrame([("zz",)], "c string").select(encode.onehot(spec))
    assert sum(one(unknown)) == 0
    zero = encode.onehot_spec(TOY, {"x": 0.0})
    assert encode.decode_center(zero, [0.7, 0, 1, 0]) == {"x": 0.5, "c": "b"}
    with pytest.raises(ValueError):
        encode.decode_center(zero, [1.0])


def test_marginals_sum_to_n(spark):
    rows = toy(spark, [(i, i / 30, "abd"[i % 3], i % 2) for i in range(30)])
    coded = marginals.encode_rows(rows, TOY)
    pairs = marginals.pair_marginals(coded, marginals.all_pairs(["x", "c", "target"]), marginals.sizes(TOY))
    assert {r.n for r in pairs.groupBy("attr_a", "attr_b").agg(F.sum("n").alias("n")).collect()} == {30}


def test_kmeans_and_route(spark):
    rows = toy(spark, [(i, (i % 2) * 0.9, "abd"[i % 2], i % 2) for i in range(200)])
    spec = encode.onehot_spec(TOY)
    centers = cluster.dp_kmeans(rows, spec, 2, math.inf, Noise.test(4))
    assert len(centers) == 2 and cluster.assign(rows, spec, centers).select("cluster_id").distinct().count() == 2
    tie = cluster.assign(rows, spec, [[0.0] * 4, [0.0] * 4])
    assert tie.filter("cluster_id <> 0").isEmpty()
    with pytest.raises(ValueError):
        cluster.nearest(F.array(), [], [])
    with pytest.raises(ValueError):
        cluster.dp_kmeans(rows.limit(0), spec, 2, math.inf, Noise.test(4))


def test_fallback_and_pools(spark):
    pool = synth.centroid_fallback(spark, {"x": 0.4, "c": "b"}, TOY, 3).orderBy("synth_id").collect()
    assert [r.target for r in pool] == [0, 1, 0]
    compat = synth.centroid_fallback(spark, {}, TOY, 1, compat=[0.4, 1.0]).first()
    assert compat.c == "d"
    with pytest.raises(S.SchemaError):
        synth.validate_pool(spark.range(1), TOY)
    rows = toy(spark, [(i, 0.1, "a", i % 2) for i in range(20)])
    spec = encode.onehot_spec(TOY)
    centers = [[0.1, 0.6, 0, 0], [0.9, 0, 0.6, 0]]
    for method in (synth.MarginalMethod(marginals.sizes(TOY), math.inf), synth.GeneratorMethod(marginals.sizes(TOY), math.inf, config=GeneratorConfig(rounds=2, target_star=True))):
        pools, log = synth.cluster_pools(cluster.assign(rows, spec, centers), TOY, centers, spec, 6, method, Noise.test(1))
        assert [x.fallback for x in log] == [False, True]
        assert pools.groupBy("cluster_id").count().orderBy("cluster_id").collect() == [(0, 6), (1, 6)]
    wrong = spark.createDataFrame([(0.1, "a", 2)], "x double, c string, target int")
    with pytest.raises(Exception, match="targets other than 0 and 1"):
        synth.validate_pool(wrong, TOY).collect()


def test_synthesis_follows_the_data(spark):
    rows = toy(spark, [(i, 0.9 if i % 4 else 0.1, "abd"[i % 2], i % 2) for i in range(400)])
    for pool in (synth.marginal_synthesize(rows, TOY, math.inf, 400, Noise.test(1)), synth.generator_synthesize(rows, TOY, math.inf, 400, Noise.test(1))):
        df = synth.validate_pool(pool, TOY).toPandas()
        assert abs(df.target.mean() - 0.5) < 0.15 and ((df.c == "b") == (df.target == 1)).mean() > 0.8


def test_pools_of_any_size_are_drawn_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(synth, "BLOCK_ROWS", 100)
    rows = toy(spark, [(i, i % 50 / 50, "abd"[i % 3], i % 2) for i in range(600)])
    pool = synth.marginal_synthesize(rows, TOY, math.inf, 450, Noise.test(1)).toPandas()
    assert sorted(pool.synth_id) == list(range(450)) and abs(pool.target.mean() - 0.5) < 0.1
    made = synth.generator_synthesize(rows, TOY, math.inf, 3000, Noise.test(1), config=GeneratorConfig(rounds=3)).toPandas()
    assert sorted(made.synth_id) == list(range(3000)) and abs(made.target.mean() - 0.5) < 0.1


def test_private_defaults():
    import inspect

    for f in (experiment.run_experiments, experiment.task_weights, experiment.MarginalBackend, experiment.GeneratorBackend):
        make = inspect.signature(f).parameters["noise"].default
        assert make(1).private and make(1).key != make(1).key
    assert not parse_args(["marginal", "--root", "x"]).test_noise
    assert Noise.test(1, 2.0).key != Noise.test(1, 4.0).key and Noise.test(7).key == "7"
    ledger = experiment.spent(2.0)
    ledger.spend("main", 2.0)
    assert ledger.total == 2.0
    with pytest.raises(privacy.BudgetError):
        ledger.spend("main", 0.1)


def test_every_cluster_gets_noise(spark):
    rows = toy(spark, [(i, 0.1, "a", 1) for i in range(50)])
    spec = encode.onehot_spec(TOY)
    coded = rows.select(encode.onehot(spec).alias("x"))
    out = cluster.step(coded, [[0.1, 0.5, 0, 0], [0.9, 0, 0.5, 0]], spec, 1.0, Noise.test(2), 0)
    assert sorted(r.cluster for r in out.collect()) == [0, 1]


def test_prompts_reach_a_scorer(spark):
    q = spark.createDataFrame([(i, i / 10, "a", i % 2) for i in range(4)], "query_id long, x double, c string, target int")
    demos = q.crossJoin(spark.createDataFrame([(1,), (2,)], "demo_rank int"))
    load = lambda: lambda texts: score.max_label_scores([{" 0": 0.1, "1": float("x" in t), "?": 9.0} for t in texts])
    found = experiment.prompt_scorer(TOY, score.text_scorer(load), max_tokens=6)(q, demos, "query_id").toPandas()
    assert sorted(found.query_id) == [0, 1, 2, 3] and set(found.prediction) <= {0, 1}
    assert score.max_label_scores([{"0": 1.0, " 0": 2.0}]) == [(2.0, float("-inf"))]
    cut = one(spark.range(1).select(prompt.left_truncated(F.lit("a b c\nd Label: "), 3)))
    assert cut == "d Label: " and one(spark.range(1).select(prompt.left_truncated(F.lit("a b"), 3))) == "a b"
    seen = []
    weigher = score.text_weigher(lambda system, text: seen.append(text) or '{"x": 1.0, "c": 0.5,}')
    two = spark.createDataFrame([(0.2, "a", 0), (0.8, "b", 1)], "x double, c string, target int")
    assert weigher(two, TOY) == pytest.approx({"x": 4 / 3, "c": 2 / 3}) and "Class summary (label=1): x=80.00, c=b" in seen[0]


def test_json_repair_and_weights(spark):
    cases = [('{"a": 0.4, }', {"a": "0.4"}), ('text {"a": 1} more', {"a": "1"}), ("[1, 2]", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    assert [r[1] for r in df.select("i", prompt.extract_object(F.col("t"))).orderBy("i").collect()] == [c[1] for c in cases]
    w = score.normalize({"a": 1.0, "b": 3.0})
    assert w == {"a": 0.5, "b": 1.5} and score.normalize({"a": 0.0}) == {"a": 1.0}
    assert score.normalize({"a": 1.0, "b": 3.0}, 0.5) == {"a": 0.75, "b": 1.25}


def test_prompt_modes(spark):
    q = spark.createDataFrame([(1, 0.5, "a", 1)], "query_id int, x double, c string, target int")
    d = q.withColumn("demo_rank", F.lit(1))
    for mode in prompt.MODES:
        p = prompt.prompts(q, d, TOY, mode).first()
        text = one(spark.range(1).select(prompt.scorer_input(F.lit(p.system_message), F.lit(p.user_message), mode)))
        assert "Example 1:" in text and text.endswith(("Label: ", "Answer: "))
    with pytest.raises(ValueError):
        prompt.prompts(q, d, TOY, "xml")
    alone = prompt.prompts(q, d.limit(0), TOY).first().user_message
    assert "Example" not in alone.split("Query")[0].replace("Use the labeled examples", "")
    decoded = S.PublicSchema("t", {}, {"c": ("a",)}, "label", "1", decode_values=True, columns=({"name": "c", "prompt_name": "Colour", "value_labels": {"a": "red"}, "unit": "u"},))
    assert json.loads(one(q.select(prompt.serialize_json(q, decoded)))) == {"Colour": "red u"}
    assert "Value Meanings" in prompt.weighting_prompt(decoded, [])


def test_weight_cache(tmp_path):
    good = {"epsilon": 1.0, "weight_split_seed": 5, "normalized_weights": {"a": 1.0}}
    path = tables.write_cache(tmp_path, "Toy", 1.0, good)
    assert path.name == "toy_eps_1.json" and tables.read_cache(tmp_path, "Toy", 1.0, 5, ["a"]) == {"a": 1.0}
    assert tables.read_cache(tmp_path, "Toy", 2.0, 5, ["a"]) is None
    for payload, args in (({"a": 1.0}, (1.0, 5, ["a"])), (good, (2.0, 5, ["a"])), (good, (1.0, 6, ["a"])), (good, (1.0, 5, ["b"]))):
        with pytest.raises(tables.CacheError):
            tables.check_cache(payload, *args)


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("d", "m", 1.0)], "dataset string, method string, f1 double")
    for _ in range(2):
        tables.append_results(r, r, f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").count() == 2 and spark.read.parquet(f"{tmp_path}/results_retrieval").count() == 2
    tables.append_csv([{"a": 1}], tmp_path / "r.csv")
    tables.append_csv([{"a": 2}], tmp_path / "r.csv")
    assert (tmp_path / "r.csv").read_text().split() == ["a", "1", "2"]


def test_registry_and_arguments(tmp_path):
    with pytest.raises(KeyError):
        tables.dataset_paths("Nope", tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.dataset_paths("Adult", tmp_path)
    with pytest.raises(ValueError):
        experiment.check_arguments(["x"], 0.3, 1e-5, [1.0], [3])
    with pytest.raises(ValueError):
        experiment.check_arguments(["global"], 1.3, 1e-5, [1.0], [3])
    assert parse_args(["marginal", "--root", "x"]).k == [3]
    with pytest.raises(S.SchemaError):
        TOY.bound("nope")
    assert S.compile_columns({}) == ({}, {})


def test_group_spec():
    bank = S.PublicSchema("Bank", {"age": (0, 1)}, {"marital": ("married", "single"), "contact": ("cellular", "t")}, "y", "yes")
    assert exprs.group_spec(bank, 8) == ["target", "marital", "contact"] and exprs.group_domain(bank, "marital") == ["Married", "Not-Married"]
    assert exprs.group_spec(bank, 1) == [] and exprs.group_spec(bank, 5) == exprs.group_spec(bank, 8)


def write_dataset(root, n=300):
    """A small registered CSV dataset: label follows one numeric and one category; some cells are missing."""
    folder = root / "heart"
    folder.mkdir()
    columns = [
        {"name": "Age", "type": "continuous", "min": 28, "max": 77}, {"name": "Max HR/min", "type": "continuous", "min": 60, "max": 202},
        {"name": "Sex", "type": "categorical", "i2s": ["F", "M"]}, {"name": "Slope", "type": "categorical", "i2s": ["Down", "Flat", "Up"], "value_labels": {"Up": "rising"}},
        {"name": "HeartDisease", "type": "categorical", "i2s": [0, 1], "size": 2},
    ]
    (folder / "heart.json").write_text(json.dumps({"columns": columns, "task": "binary_classification", "label": "Result"}))
    rng = np.random.default_rng(0)
    for name, rows in (("train", n), ("test", n // 2)):
        lines = ["Age,Max HR/min,Sex,Slope,HeartDisease"]
        for i in range(rows):
            y = i % 2
            lines.append(f"{rng.integers(28, 78) if i % 50 else 'NA'},{rng.integers(60, 120) if y else rng.integers(120, 203)},{'FM'[i % 3 % 2]},{['Up', 'Down', 'Flat'][y + (i % 7 == 0)] if i % 41 else '?'},{y}")
        (folder / f"{name}.csv").write_text("\n".join(lines))


def test_csv_end_to_end(spark, tmp_path):
    write_dataset(tmp_path)
    ctx = experiment.prepare_dataset(spark, "Heart", tmp_path)
    bad = sum(1 for i in range(300) if not i % 50 or not i % 41)
    assert ctx.train.count() == 300 - bad and ctx.evaluation.count() == 100
    assert ctx.train.select("`Max HR/min`").dtypes[0][1] == "double" and ctx.schema.label == "HeartDisease"
    r = experiment.run_experiments(spark, experiment.MarginalBackend(noise=Noise.test), [ctx], trials=1, ks=(2,), epsilons=(8.0,), n_synth=300, noise=Noise.test, cache_dir=str(tmp_path / "cache"), out=str(tmp_path / "results")).toPandas()
    assert len(r) == 2 and r[r.method == "global"].accuracy.iloc[0] > 0.6
    assert (r.epsilon_spent <= r.epsilon + 1e-9).all() and not ctx.persisted
    assert len(os.listdir(tmp_path / "cache")) == 1 and spark.read.parquet(str(tmp_path / "results_retrieval")).count() == 200


@pytest.mark.skipif(not os.path.isdir(CSV_ROOT), reason="no folder of datasets")
def test_schema_files_load():
    from pathlib import Path

    files = [p for p in Path(CSV_ROOT).rglob("*.json")]
    assert files and all(S.load_schema(p).features for p in files)
