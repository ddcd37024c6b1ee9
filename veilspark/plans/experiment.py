"""Dataset contexts, evaluation, backends and the experiment sweep."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import Noise, infinite
from ..operators import cluster, encode, marginals, prep, privacy, prompt, sampling, score, synth
from ..operators.generator import GeneratorConfig
from ..sources import tables
from ..sources.schema import DECLARED, PublicSchema

SPLIT_SEED, SUMMARY_SEED, EVAL_SEED = 314_159, 271_828, 777
METHODS = ("global", "clustered")


@dataclass
class DatasetContext:
    """Lazy prepared tables of one dataset and its public schema."""

    schema: PublicSchema
    train: DataFrame
    evaluation: DataFrame
    persisted: list[DataFrame] = field(default_factory=list)

    @property
    def feature_cols(self) -> list[str]:
        return self.schema.features

    def keep(self, df: DataFrame) -> DataFrame:
        self.persisted.append(df.persist())
        return self.persisted[-1]

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()


def with_row_id(df: DataFrame, schema: PublicSchema) -> tuple[DataFrame, PublicSchema]:
    """A stable row id for tables without a key: a hash of the row's cells and its copy number."""
    from pyspark.sql import Window

    if schema.key:
        return df, schema
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("__h", h).withColumn("__c", F.row_number().over(Window.partitionBy("__h").orderBy("__h")))
    return keyed.withColumn("row_key", F.xxhash64("__h", "__c")).drop("__h", "__c"), replace(schema, key="row_key")


def prepare_table(df: DataFrame, schema: PublicSchema, test: DataFrame | None = None, per_class: int = 50, seed: int = EVAL_SEED) -> DatasetContext:
    """Context of a train table and a test table (or of one table split by key hash, a fifth to test)."""
    df, keyed = with_row_id(df, schema)
    rows = prep.prepare(df, keyed)
    if test is None:
        test_rows, train = sampling.disjoint_split(rows, 0.2, seed)
    else:
        train = rows
        t, tk = with_row_id(test, schema)
        test_rows = prep.prepare(t, tk)
    evaluation = sampling.balanced(test_rows, per_class, seed).withColumnRenamed("row_id", "query_id")
    return DatasetContext(schema, train, evaluation)


def prepare_dataset(spark: SparkSession, name: str, root: str | Path, per_class: int = 50, seed: int = EVAL_SEED) -> DatasetContext:
    """A registered CSV dataset below ``root``, or a declared table of the Parquet folder ``root``."""
    if name in DECLARED:
        return prepare_table(tables.read_parquet(spark, str(root), name), DECLARED[name], None, per_class, seed)
    paths = tables.dataset_paths(name, root)
    schema = tables.registered_schema(name, root)
    return prepare_table(tables.read_csv(spark, str(paths["train"]), schema), schema, tables.read_csv(spark, str(paths["test"]), schema), per_class, seed)


class Backend(Protocol):
    """A synthesis strategy. Neighbours differ by one added or removed row."""

    name: str
    seed_offset: int
    bins: int
    noise: Callable[..., Noise]

    def method(self, schema: PublicSchema, epsilon: float, seed: int, star: bool) -> synth.Method:
        """How rows of one release are made: of each feature's table with the target only (``star``), or of all tables of the workload."""


@dataclass
class MarginalBackend:
    bins: int = 8
    delta: float = 1e-5
    consistency_rounds: int = 2
    view_rounds: int = 10
    update_rounds: int = 20
    noise: Callable[..., Noise] = Noise.secret
    name: str = "marginal"
    seed_offset: int = 1081

    def method(self, schema, epsilon, seed, star):
        return synth.MarginalMethod(marginals.sizes(schema, self.bins), epsilon, self.delta, self.consistency_rounds, self.view_rounds, self.update_rounds, star)


@dataclass
class GeneratorBackend:
    bins: int = 8
    delta: float = 1e-5
    config: GeneratorConfig = field(default_factory=GeneratorConfig)
    noise: Callable[..., Noise] = Noise.secret
    name: str = "generator"
    seed_offset: int = 808

    def method(self, schema, epsilon, seed, star):
        return synth.GeneratorMethod(marginals.sizes(schema, self.bins), epsilon, self.delta, replace(self.config, target_star=star), seed)


def constant_pool(queries: DataFrame) -> DataFrame:
    """Every query to the one pool."""
    return queries.withColumn("cluster_id", F.lit(0))


def routed_pool(queries: DataFrame, spec: encode.OneHotSpec, centers: Sequence[Sequence[float]], pools: DataFrame, among: Sequence[int] | None = None) -> DataFrame:
    """Every query to the nearest cluster whose pool has rows; ``among`` tells which do, if that is known without looking."""
    return cluster.assign(queries, spec, centers, cluster.filled_clusters(pools) if among is None else among)


def evaluate(routed: DataFrame, pools: DataFrame, schema: PublicSchema, scorer: score.Scorer, shots: int = 8, seed: int = 0, pool_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, per-query predictions) as one job: route, sample demonstrations, score, count."""
    demos = sampling.balanced_demos(routed, pools.withColumnRenamed("synth_id", "pool_id"), shots, seed, by="cluster_id", pool_rows=pool_rows)
    found = scorer(routed, demos, "query_id")
    per_query = routed.select("query_id", F.col("target").alias("true_label"), F.col("cluster_id").alias("selected_cluster")).join(found, "query_id", "left")
    per_query = per_query.withColumn("prediction", F.coalesce("prediction", F.lit(0)))
    return score.metrics(per_query, "true_label"), per_query


def evaluation_prompts(routed: DataFrame, pools: DataFrame, schema: PublicSchema, mode: str = "json", shots: int = 8, seed: int = 0) -> DataFrame:
    """(query_id, prompt): what a language-model scorer would read."""
    demos = sampling.balanced_demos(routed, pools.withColumnRenamed("synth_id", "pool_id"), shots, seed, by="cluster_id")
    p = prompt.prompts(routed, demos, schema, mode)
    return p.select("query_id", prompt.scorer_input(F.col("system_message"), F.col("user_message"), mode).alias("prompt"))


def task_weights(ctx: DatasetContext, weight_rows: DataFrame, epsilon: float, weigher: score.Weigher, cache_dir: str | None = None, noise: Callable[..., Noise] = Noise.secret, fraction: float = 0.1, split_seed: int = SPLIT_SEED, summary_seed: int = SUMMARY_SEED) -> dict[str, float]:
    """Feature weights from the DP class summaries, read through a cache."""
    name = ctx.schema.name
    if cache_dir and (found := tables.read_cache(cache_dir, name, epsilon, split_seed, ctx.feature_cols)):
        return found
    seed = summary_seed + (0 if infinite(epsilon) else round(1000 * epsilon))
    prototypes = privacy.class_prototypes(weight_rows, ctx.schema, epsilon, noise("weights", seed))
    rows = [r.asDict() for r in prototypes.drop("key_id").collect()]  # two rows
    weights = weigher(weight_rows.sparkSession.createDataFrame(rows, prototypes.drop("key_id").schema), ctx.schema)
    if cache_dir:
        tables.write_cache(
            cache_dir, name, epsilon,
            {"dataset": name, "epsilon": epsilon, "weight_sample_fraction": fraction, "weight_split_seed": split_seed, "summary_seed": seed, "scoring_model": getattr(weigher, "__name__", "weigher"), "prompt_version": "offline", "dp_summaries": rows, "normalized_weights": weights},
        )
    return weights


def check_arguments(methods: Sequence[str], cluster_share: float, delta: float, epsilons: Sequence[float], ks: Sequence[int]) -> None:
    if unknown := sorted(set(methods) - set(METHODS)):
        raise ValueError(f"unknown methods {unknown}; known: {METHODS}")
    if not 0 < cluster_share < 1:
        raise ValueError("the cluster share must lie inside (0, 1)")
    if not 0 < delta < 1:
        raise ValueError("delta must lie inside (0, 1)")
    if not epsilons or any(not e > 0 for e in epsilons) or any(k < 1 for k in ks):
        raise ValueError("epsilons and cluster counts must be positive")


def run_experiments(
    spark: SparkSession, backend: Backend, contexts: Sequence[DatasetContext], methods: Sequence[str] = METHODS, trials: int = 10, ks: Sequence[int] = (3,), epsilons: Sequence[float] = (1.0, 2.0, 4.0),
    shots: int = 8, delta: float = 1e-5, cluster_share: float = 0.3, weight_fraction: float = 0.1, weigher: score.Weigher = score.class_gap_weigher, cache_dir: str | None = None, out: str | None = None,
    noise: Callable[..., Noise] = Noise.secret, n_synth: int | None = None, scorer: Callable[[encode.OneHotSpec, PublicSchema], score.Scorer] | None = None, split_seed: int = SPLIT_SEED, summary_seed: int = SUMMARY_SEED, ceiling: float | None = None,
) -> DataFrame:
    """One result row per dataset, method, k, epsilon and trial.

    A dataset's releases are made together: they share the passes of k-means, one scan that counts all tables, one fit
    of all models, and one plan that routes, samples and scores all queries, so Spark's jobs grow with the number of
    datasets and, for feature weights alone, of epsilons, not with methods, cluster counts or trials.
    Global pools do not depend on k and are built once per (dataset, epsilon, trial).
    The reserved weighting part and the main part are disjoint, so their spends compose in parallel; both kinds of
    pools are made of the main part alone. Every row of the results is a release with a ledger of its own, and every
    release has noise of its own: ``noise`` is called with method, k, epsilon and seed, and is secret unless given.
    ``scorer`` makes a scorer of the weighted space and the schema, by default the nearest demonstration.

    Releases about the same rows add up: ``sweep_epsilon`` in the results is what all releases of a dataset cost together
    (feature weights are bought once per epsilon). With a ``ceiling``, a sweep that would cost more does not begin.
    """
    check_arguments(methods, cluster_share, delta, epsilons, ks)
    whole = sweep_cost(methods, trials, ks, epsilons)
    if ceiling is not None and whole > ceiling * (1 + 1e-9):
        raise privacy.BudgetError(f"the sweep would cost {whole} of {ceiling}")
    found, kind = [], None
    for ctx in contexts:
        schema = ctx.schema
        train = ctx.keep(ctx.train)
        n = train.count()
        weight_rows, main = sampling.disjoint_split(train, weight_fraction, split_seed, n=n)
        specs = {eps: encode.onehot_spec(schema, task_weights(ctx, weight_rows, eps, weigher, cache_dir, noise, weight_fraction, split_seed, summary_seed)) for eps in dict.fromkeys(epsilons)}
        grid = sweep_grid(methods, trials, ks, epsilons, cluster_share, backend.seed_offset)
        if not grid:
            continue
        clusterings = [cluster.Clustering(c.number, specs[c.epsilon], c.k, c.eps_cluster, noise("centers", c.k, c.epsilon, c.seed)) for c in grid if c.clustered]
        centers = {c.number: [[0.0] * specs[c.epsilon].width] for c in grid}  # the one pool of a global release
        centers |= cluster.dp_kmeans_many(main, clusterings) if clusterings else {}
        pools, fallbacks = sweep_pools(main, schema, backend, grid, specs, centers, n_synth or n)
        pools = ctx.keep(pools)
        makers = {eps: score.nearest_demo_scorer(spec) if scorer is None else scorer(spec, schema) for eps, spec in specs.items()}
        per_query = ctx.keep(sweep_predictions(ctx, grid, specs, centers, pools, makers, shots, n_synth or n))
        about = []
        for c in grid:
            about.append((
                c.number, schema.name, c.method, c.epsilon, float(delta), c.k, c.seed, backend.name, True, c.eps_cluster, c.eps_synth, c.clustered, fallbacks[c.number], c.ledger().total, float(whole),
                weight_fraction, split_seed, getattr(weigher, "__name__", "weigher"),
            ))
        told = spark.createDataFrame(about, "release int, dataset string, method string, epsilon double, delta double, K int, seed int, base_synthesizer string, uses_dp_summaries boolean, eps_cluster double, eps_synth double, target_centered boolean, fallback_clusters int, epsilon_spent double, sweep_epsilon double, weight_sample_fraction double, weight_split_seed int, weight_source string")
        measured = score.metrics(per_query, "true_label", by=["release"])
        rows = told.join(measured, "release", "left").na.fill(0).drop("release")
        kind, here = rows.schema, [tuple(r) for r in rows.collect()]  # a row a release
        if out:
            keys = told.select("release", "dataset", "method", "epsilon", "K", "seed")
            tables.append_results(spark.createDataFrame(here, kind), keys.join(per_query, "release").drop("release"), out)
        found += here
        ctx.release()
    return spark.createDataFrame(found, kind)


@dataclass(frozen=True)
class GridCell:
    """One release of a sweep."""

    number: int
    method: str
    k: int
    epsilon: float
    trial: int
    seed: int
    eps_cluster: float
    eps_synth: float

    @property
    def clustered(self) -> bool:
        return self.method == "clustered"

    def ledger(self) -> privacy.BudgetLedger:
        """What the release spends: an added row lies in one cluster, so all clusters are charged once."""
        ledger = spent(self.epsilon)
        for e in (self.eps_cluster, self.eps_synth):
            if e > 0:
                ledger.spend("main", e)
        return ledger


def sweep_grid(methods: Sequence[str], trials: int, ks: Sequence[int], epsilons: Sequence[float], cluster_share: float, seed_offset: int) -> list[GridCell]:
    """Every release; global ones do not depend on k."""
    out: list[GridCell] = []
    for eps in map(float, epsilons):
        share = privacy.split_budget(eps, cluster_share)
        for t in range(trials):
            kinds = [("global", 1, 0.0, eps)] * ("global" in methods) + [("clustered", k, *share) for k in ks] * ("clustered" in methods)
            for method, k, own, rest in kinds:
                out.append(GridCell(len(out), method, k, eps, t, 1000 + t + seed_offset, own, rest))
    return out


def sweep_pools(main: DataFrame, schema: PublicSchema, backend: Backend, grid: Sequence[GridCell], specs: Mapping[float, encode.OneHotSpec], centers: Mapping[int, Sequence[Sequence[float]]], total: int) -> tuple[DataFrame, dict[int, int]]:
    """((release, cluster_id, synth_id, prepared columns), clusters that fell back by release) of all releases: one scan counts all tables."""
    spark, attributes = main.sparkSession, marginals.sizes(schema, backend.bins)
    releases = [
        synth.Release(c.number, backend.method(schema, c.eps_synth, c.seed, c.clustered), c.k, backend.noise(backend.name, c.method, c.k, c.epsilon, c.seed)) for c in grid
    ]
    by_kind = {kind: [r for r, c in zip(releases, grid) if c.clustered == kind] for kind in (False, True)}
    any_spec = next(iter(specs.values()))
    coded = marginals.encode_rows(main.withColumn("__base", encode.onehot(cluster.unit(any_spec))), schema, backend.bins, keep=["__base"])
    cells = None
    if by_kind[True]:
        about = [cluster.Clustering(c.number, specs[c.epsilon], c.k, c.eps_cluster, r.noise) for r, c in zip(releases, grid) if c.clustered]
        met = coded.crossJoin(F.broadcast(cluster.centers_table(spark, about, centers)))  # a row a release
        met = met.withColumn("cluster_id", cluster.nearest_of_row("__base")).drop("__base", "scales", "centers")
        cells = synth.cluster_cells(met, by_kind[True][0].method.sets(), attributes, by_kind[True])
    if by_kind[False]:
        numbers = spark.createDataFrame([(r.number, 0) for r in by_kind[False]], "release int, cluster_id int")
        once = marginals.marginal_tables(coded.drop("__base"), by_kind[False][0].method.sets(), attributes).select("set_id", "at", "n")  # all global releases count alike
        whole = once.crossJoin(F.broadcast(numbers)).select("release", "cluster_id", "set_id", "at", "n")
        cells = whole if cells is None else cells.unionByName(whole)
    models = synth.release_models(cells, releases)
    rows_each = {c.number: max(1, total // c.k) for c in grid}
    names = ["release", "cluster_id", "synth_id"]
    pools = synth.decode_rows(synth.draw_releases(spark, models, releases, rows_each), schema, backend.bins, names)
    failed = [at for at, m in models.items() if m is None]
    if empty := [c.number for c in grid if not c.clustered and (c.number, 0) in failed]:
        raise synth.EmptyTables(f"no noisy cell is positive in releases {empty}")
    if failed:
        by_number = {c.number: c for c in grid}
        decoded = [(n, i, rows_each[n], *encode.decode_center(specs[by_number[n].epsilon], centers[n][i]).values()) for n, i in failed]
        types = ", ".join(f"`{c}` {'double' if c in schema.numeric else 'string'}" for c in [*schema.numeric, *schema.categorical])
        centre = spark.createDataFrame(decoded, f"release int, cluster_id int, __n int, {types}")
        own = centre.withColumn("synth_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__n") - 1).cast("long")))).withColumn("target", (F.col("synth_id") % 2).cast("int"))
        pools = pools.unionByName(own.drop("__n"))
    counts = {c.number: sum(n == c.number for n, _ in failed) for c in grid}
    return synth.validate_pool(pools, schema), counts


def sweep_predictions(ctx: DatasetContext, grid: Sequence[GridCell], specs: Mapping[float, encode.OneHotSpec], centers: Mapping[int, Sequence[Sequence[float]]], pools: DataFrame, scorers: Mapping[float, score.Scorer], shots: int, pool_rows: int) -> DataFrame:
    """(release, query_id, true_label, selected_cluster, prediction): every query of every release, routed, shown demonstrations and scored in one plan."""
    spark = pools.sparkSession
    any_spec = next(iter(specs.values()))
    about = [cluster.Clustering(c.number, specs[c.epsilon], c.k, c.epsilon, Noise.test(0)) for c in grid]
    table = F.broadcast(cluster.centers_table(spark, about, centers, [(c.trial * 10_000,) for c in grid], ", demo_seed int"))  # a row a release
    queries = ctx.evaluation.withColumn("__base", encode.onehot(cluster.unit(any_spec))).crossJoin(table)
    queries = queries.withColumn("cluster_id", cluster.nearest_of_row("__base")).drop("__base", "scales", "centers").withColumn("ask", F.concat_ws("/", "release", "query_id"))
    seeded = pools.withColumnRenamed("synth_id", "pool_id").join(table.select("release", "demo_seed"), "release")
    demos = sampling.balanced_demos(queries, seeded, shots, F.col("demo_seed"), by=["release", "cluster_id"], pool_rows=pool_rows)
    # the pool is as good as read: only what queries are shown goes on
    demos = demos.join(F.broadcast(queries.select("release", "cluster_id", "query_id", "ask")), ["release", "cluster_id", "query_id"]).drop("query_id", "demo_seed", "pool_id")
    found = None
    for eps, scorer in scorers.items():
        mine = F.col("release").isin([c.number for c in grid if c.epsilon == eps])
        part = scorer(queries.filter(mine), demos.filter(mine).drop("release", "cluster_id"), "ask")
        found = part if found is None else found.unionByName(part)
    per_query = queries.select("release", "query_id", "ask", F.col("target").alias("true_label"), F.col("cluster_id").alias("selected_cluster")).join(found, "ask", "left").drop("ask")
    return per_query.withColumn("prediction", F.coalesce("prediction", F.lit(0)))


def sweep_cost(methods: Sequence[str], trials: int, ks: Sequence[int], epsilons: Sequence[float]) -> float:
    """What all releases of a sweep cost one dataset: the dearer of its two disjoint parts."""
    pools = trials * (("global" in methods) + ("clustered" in methods) * len(ks))
    return sum(epsilons) * max(1, pools)


def spent(epsilon: float) -> privacy.BudgetLedger:
    """The ledger of one release, with the feature weights already bought from the reserved part."""
    ledger = privacy.BudgetLedger(epsilon)
    ledger.spend("weight", epsilon)
    return ledger


def prompt_scorer(schema: PublicSchema, score_texts, mode: str = "json", max_tokens: int | None = None) -> score.Scorer:
    """A scorer that reads prompts: demonstrations and query are rendered and scored by ``score_texts``.

    Token budgets are kept by ``text_scorer`` with a tokenizer; without one, ``max_tokens`` words from the right are kept.
    """

    def run(queries: DataFrame, demos: DataFrame, query_key: str) -> DataFrame:
        p = prompt.prompts(queries, demos, schema, mode, query_key)
        text = prompt.scorer_input(F.col("system_message"), F.col("user_message"), mode)
        return score_texts(p.select(query_key, (text if max_tokens is None else prompt.left_truncated(text, max_tokens)).alias("prompt")), query_key)

    return run
