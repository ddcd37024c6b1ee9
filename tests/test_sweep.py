"""A sweep's releases made together equal those made alone, in as many jobs whatever the grid."""

import math

import pytest
from pyspark.sql import functions as F
from test_edges import TOY, toy

from veilspark.functions.rand import Noise
from veilspark.operators import cluster, encode
from veilspark.operators.generator import GeneratorConfig
from veilspark.plans import experiment


def rows_of(spark, n=240):
    return toy(spark, [(i, (i * 37 % n) / n, "abd"[(i % 2) + (i % 5 == 0)], i % 2) for i in range(n)])


@pytest.fixture(scope="module")
def context(spark):
    rows = rows_of(spark)
    return lambda: experiment.DatasetContext(TOY, rows, rows.filter("row_id % 7 = 0").withColumnRenamed("row_id", "query_id"))


BACKENDS = [experiment.MarginalBackend(noise=Noise.test), experiment.GeneratorBackend(config=GeneratorConfig(rounds=2, inner=5), noise=Noise.test)]


def run(spark, context, backend, **options):
    options = {"trials": 1, "ks": (2,), "epsilons": (3.0,), "n_synth": 60, "noise": Noise.test} | options
    out = experiment.run_experiments(spark, backend, [context()], **options).drop("sweep_epsilon")
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("backend", BACKENDS)
def test_a_grid_is_its_cells(spark, context, backend):
    whole = run(spark, context, backend, trials=2, ks=(2, 3), epsilons=(1.0, math.inf))
    alone = run(spark, context, backend, trials=2, methods=("global",), epsilons=(1.0,)) + run(spark, context, backend, trials=2, ks=(3,), methods=("clustered",), epsilons=(math.inf,))
    assert len(whole) == 12 and len(alone) == 4 and set(alone) <= set(whole)


def test_jobs_do_not_grow_with_the_grid(spark, context):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for i, options in enumerate(({"trials": 1, "ks": (2,)}, {"trials": 3, "ks": (2, 3, 4)})):
        spark.sparkContext.setJobGroup(f"sweep{i}", "sweep")
        run(spark, context, BACKENDS[0], **options)
        jobs.append(len(tracker.getJobIdsForGroup(f"sweep{i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 6  # twelve releases in place of two; k-means may take a round or two more


def test_many_k_means_are_each_alone(spark):
    rows = rows_of(spark)
    specs = [encode.onehot_spec(TOY), encode.onehot_spec(TOY, {"x": 1.7, "c": 0.3})]
    many = [cluster.Clustering(i, specs[i % 2], 2 + i % 3, e, Noise.test("km", i)) for i, e in enumerate((0.5, 4.0, math.inf, 2.0, 30.0))]
    found = cluster.dp_kmeans_many(rows, many)
    for c in many:
        alone = cluster.dp_kmeans(rows, c.spec, c.k, c.epsilon, c.noise)
        assert [pytest.approx(v) for v in alone] == found[c.number]
    with pytest.raises(ValueError):
        cluster.dp_kmeans_many(rows.limit(0), many)
    assert len(cluster.dp_kmeans_many(rows, [cluster.Clustering(0, specs[0], 2, 1.0, Noise.secret()), cluster.Clustering(1, specs[0], 2, 1.0, Noise.test(1))])) == 2


def test_routing_by_row_is_routing_by_literals(spark):
    spec = encode.onehot_spec(TOY, {"x": 1.7, "c": 0.3})
    centers = [[0.1, 0.2, 0.1, 0.0], [0.9, 0.0, 0.3, 0.1], [0.9, 0.0, 0.3, 0.1]]
    rows = rows_of(spark)
    table = cluster.centers_table(spark, [cluster.Clustering(0, spec, 3, 1.0, Noise.test(1))], {0: centers})
    by_row = rows.withColumn("base", encode.onehot(cluster.unit(spec))).crossJoin(table).withColumn("c", cluster.nearest_of_row())
    both = by_row.join(cluster.assign(rows, spec, centers).select("row_id", "cluster_id"), "row_id")
    assert both.count() == 240 and both.filter(F.col("c") != F.col("cluster_id")).isEmpty()


def test_results_and_empty_clusters(spark, context, tmp_path):
    ctx = context()
    out = experiment.run_experiments(spark, BACKENDS[0], [ctx], trials=1, ks=(2, 40), epsilons=(math.inf,), n_synth=80, noise=Noise.test, out=f"{tmp_path}/r").toPandas()
    assert len(out) == 3 and not ctx.persisted and (out.sweep_epsilon == math.inf).all()
    assert out[out.K == 40].fallback_clusters.iloc[0] > 0 and out[out.method == "global"].fallback_clusters.iloc[0] == 0
    assert spark.read.parquet(f"{tmp_path}/r").count() == 3 and spark.read.parquet(f"{tmp_path}/r_retrieval").count() == 3 * 35
    nobody = experiment.DatasetContext(TOY, rows_of(spark), rows_of(spark, 4).filter("false").withColumnRenamed("row_id", "query_id"))
    row = experiment.run_experiments(spark, BACKENDS[0], [nobody], trials=1, methods=("global",), epsilons=(2.0,), n_synth=20, noise=Noise.test).collect()[0]
    assert row.tp == row.fn == 0 and row.accuracy == 0.0
