"""Differentially private aggregates under a budget ledger."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SUPPORTED_SHOTS, clip, col, group_domain, group_key, group_spec
from ..functions.rand import Noise, infinite, order_key
from ..sources.schema import PublicSchema


class BudgetError(ValueError):
    """An operator asked for more epsilon than its part of the table has left."""


@dataclass
class BudgetLedger:
    """Epsilon spent per disjoint part of a table; parts compose in parallel, spends in sequence.

    Neighbours differ by one added or removed row. A spend on a Poisson sample of a part is charged what it costs the part.
    """

    epsilon: float
    spent: dict[str, float] = field(default_factory=dict)

    def spend(self, part: str, epsilon: float, rate: float = 1.0) -> float:
        """Charge ``epsilon``, used on a secret Poisson sample of ``rate`` of the part; returns it."""
        if not epsilon > 0:
            raise BudgetError(f"epsilon must be positive, not {epsilon}")
        used = self.spent.get(part, 0.0) + amplified(epsilon, rate)
        if not infinite(self.epsilon) and used > self.epsilon * (1 + 1e-9):
            raise BudgetError(f"part {part!r}: {used} of {self.epsilon} would be spent")
        self.spent[part] = used
        return epsilon

    @property
    def total(self) -> float:
        return max(self.spent.values(), default=0.0)


def amplified(epsilon: float, rate: float) -> float:
    """What ``epsilon`` spent on a Poisson sample costs the whole: ln(1 + rate (exp(epsilon) - 1))."""
    if not 0 < rate <= 1:
        raise ValueError(f"sample rate must lie in (0, 1], not {rate}")
    if rate == 1 or infinite(epsilon):
        return epsilon
    return epsilon + math.log(rate + (1 - rate) * math.exp(-epsilon))


def affordable(epsilon: float, rate: float) -> float:
    """The epsilon to spend on a Poisson sample so that the whole is charged ``epsilon``: the inverse of ``amplified``."""
    if not 0 < rate <= 1:
        raise ValueError(f"sample rate must lie in (0, 1], not {rate}")
    if rate == 1 or infinite(epsilon):
        return epsilon
    return epsilon + math.log((1 - (1 - rate) * math.exp(-epsilon)) / rate)


def poisson_sample(df: DataFrame, rate: float, noise: Noise, key: str = "row_id") -> DataFrame:
    """Each row by a coin of its own, keyed by ``noise``: the sample that ``amplified`` speaks of, if the noise is secret. Maybe no row."""
    if not 0 < rate <= 1:
        raise ValueError(f"sample rate must lie in (0, 1], not {rate}")
    return df if rate == 1 else df.filter(noise.uniform("sample", col(key)) < rate)


def split_budget(epsilon: float, cluster_share: float) -> tuple[float, float]:
    """(clustering, synthesis) shares of epsilon."""
    if not 0 < cluster_share < 1:
        raise BudgetError(f"cluster share must lie inside (0, 1), not {cluster_share}")
    return cluster_share * epsilon, epsilon - cluster_share * epsilon


def noisy_count(n: Column, epsilon: float, noise: Noise, *parts) -> Column:
    """The count with discrete Laplace noise: an integer, maybe below zero."""
    return n.cast("long") + noise.discrete_laplace(epsilon, *parts)


def noisy_mean(total: Column, n: Column, epsilon: float, noise: Noise, *parts, min_count: float = 1.0) -> Column:
    """Half of epsilon for the count, half for the sum; the ratio is clipped to [0, 1]."""
    if infinite(epsilon):
        return F.when(n > 0, clip(total / n, 0, 1)).otherwise(F.lit(0.5))
    if not epsilon > 0:
        raise BudgetError("epsilon must be positive")
    count = F.greatest(n.cast("double") + noise.laplace(2.0 / epsilon, *parts, "count"), F.lit(float(min_count)))
    return clip((F.coalesce(total, F.lit(0.0)) + noise.laplace(2.0 / epsilon, *parts, "sum")) / count, 0, 1)


def key_grid(schema: PublicSchema, spec: list[str], spark) -> DataFrame:
    """Every public key: g0, g1, ... in domain order, with its position; its size is set by the schema alone."""
    if not spec:
        return spark.createDataFrame([("__ALL__", 0)], "g0 string, key_id int")
    keys = list(product(*[group_domain(schema, c) for c in spec]))
    names = ", ".join(f"g{i} string" for i in range(len(spec)))
    return spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{names}, key_id int")


def bernoulli(df: DataFrame, rate: float, seed: int, key: str = "row_id") -> DataFrame:
    """Each row by a coin that ``seed`` tells; at least one row (the least hash) if any. For evaluation: it amplifies nothing."""
    if not 0 < rate <= 1:
        raise ValueError(f"sample rate must lie in (0, 1], not {rate}")
    if rate >= 1:
        return df
    u = Noise.test(seed).uniform("bernoulli", col(key))
    tossed = df.withColumn("__u", u)
    some = tossed.filter(F.col("__u") < rate)
    if some.isEmpty():
        return tossed.orderBy("__u", key).limit(1).drop("__u")
    return some.drop("__u")


def dp_group_by(rows: DataFrame, schema: PublicSchema, epsilon: float, shots: int, noise: Noise, spec: list[str] | None = None, min_count: float = 1.0, sample_rate: float = 1.0, exact_shots: bool = True, seed: int = 0, key: str = "row_id") -> DataFrame:
    """One prototype row per public key: noisy means, noisy modes, noisy target; ``shots`` of them.

    Two aggregates over the rows, whatever the number of keys: sums and counts per
    key, and category counts per (key, column, value). Both shrink in the map tasks to at most the public
    grid; noise is added to grid cells only. If the grid has another size than ``shots``, its rows are resampled
    by hash (``seed``) and numbered in ``slot``, unless ``exact_shots`` is off. With a ``sample_rate`` below 1 only a
    Poisson sample of the rows is read: charge it with ``BudgetLedger.spend(part, epsilon, sample_rate)``.
    """
    spark = rows.sparkSession
    spec = [c for c in (group_spec(schema, shots) if spec is None else spec) if c is not None]
    grid = F.broadcast(key_grid(schema, spec, spark))  # the public grid
    names = [f"g{i}" for i in range(max(1, len(spec)))]
    rows = poisson_sample(rows, sample_rate, noise, key)
    keyed = rows.select("*", *([group_key(schema, c).alias(f"g{i}") for i, c in enumerate(spec)] or [F.lit("__ALL__").alias("g0")]))
    private = [*schema.features, "target"]
    each = float("inf") if infinite(epsilon) else epsilon / max(len(private), 1)
    sums = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *[F.sum(clip(F.coalesce(col(c), F.lit(0.0)), 0, 1)).alias(f"sum_{i}") for i, c in enumerate(schema.numeric)])
    cell = F.concat_ws("/", *names)
    means = grid.join(sums, names, "left").select(
        "key_id", *names, F.coalesce("n", F.lit(0)).alias("n"),
        *[noisy_mean(F.coalesce(f"sum_{i}", F.lit(0.0)), F.coalesce("n", F.lit(0)), each, noise, "mean", cell, c, min_count=min_count).alias(c) for i, c in enumerate(schema.numeric)],
    )
    modes = noisy_modes(keyed, grid, names, schema, each, noise)
    out = means.join(modes, "key_id").select("key_id", *[col(c) for c in schema.numeric], *[col(c) for c in schema.categorical], F.col("target").cast("int").alias("target"))
    size = math.prod(len(group_domain(schema, c)) for c in spec)
    return resample(out, shots, seed, "key_id", size) if exact_shots and shots != size else out


def noisy_modes(keyed: DataFrame, grid: DataFrame, names: list[str], schema: PublicSchema, epsilon: float, noise: Noise) -> DataFrame:
    """(key_id, one column per category and ``target``): the noisy most frequent domain value, ties to the earliest."""
    columns = [(c, list(schema.domain(c))) for c in schema.categorical] + [("target", ["0", "1"])]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("attr"), col(c).cast("string").alias("value")) for i, (c, _) in enumerate(columns)]))
    counts = keyed.select(*names, cells.alias("cell")).select(*names, "cell.attr", "cell.value").groupBy(*names, "attr", "value").agg(F.count(F.lit(1)).alias("n"))
    domain = keyed.sparkSession.createDataFrame([(i, c, j, v) for i, (c, d) in enumerate(columns) for j, v in enumerate(d)], "attr int, column string, position int, value string")
    dense = grid.crossJoin(F.broadcast(domain)).join(counts, [*names, "attr", "value"], "left")  # grid and domain are public and small
    noisy = noisy_count(F.coalesce("n", F.lit(0)), epsilon, noise, "mode", F.concat_ws("/", *names), F.col("column"), F.col("value"))
    best = dense.withColumn("noisy", noisy).groupBy("key_id", "attr").agg(F.max_by("value", F.struct("noisy", -F.col("position"))).alias("value"))
    return best.groupBy("key_id").agg(*[F.max(F.when(F.col("attr") == i, F.col("value"))).alias(c) for i, (c, _) in enumerate(columns)])


def resample(rows: DataFrame, k: int, seed: int, key: str, n: int | None = None) -> DataFrame:
    """Exactly k rows: the k least hashes, or, from fewer rows, k keyed draws with replacement. ``n``: their number, if known."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.orderBy(order_key(seed, "resample", F.col(key)), key)))
    n = rows.count() if n is None else n  # a public grid
    if k <= n:
        return ranked.filter(F.col("__r") <= k).withColumn("slot", F.col("__r")).drop("__r")
    slots = rows.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("slot"))
    slots = slots.withColumn("__r", (F.floor(Noise.test(seed).uniform("slot", F.col("slot")) * n) + 1).cast("int"))
    return F.broadcast(slots).join(ranked, "__r").drop("__r")


def class_prototypes(rows: DataFrame, schema: PublicSchema, epsilon: float, noise: Noise) -> DataFrame:
    """Two rows, one per class: the DP summaries that feature weights are made from."""
    return dp_group_by(rows, schema, epsilon, 2, noise, spec=["target"])


def supported(shots: int) -> bool:
    return shots in SUPPORTED_SHOTS
