"""DP k-means in the weighted one-hot space, and routing to the nearest centre."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import Noise, infinite
from .encode import OneHotSpec, onehot


def squared_distance(coords: Column, center: Sequence[float]) -> Column:
    literal = F.array(*[F.lit(float(c)) for c in center])
    return F.aggregate(F.zip_with(coords, literal, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(coords: Column, centers: Sequence[Sequence[float]], among: Sequence[int] | None = None) -> Column:
    """Id of the nearest centre, ties to the lowest; one fused projection, no shuffle.

    ``among`` restricts the candidates, for example to clusters whose pool has rows.
    """
    ids = list(range(len(centers))) if among is None else sorted(among)
    if not ids:
        raise ValueError("no centre to route to")
    return F.array_min(F.array(*[F.struct(squared_distance(coords, centers[i]).alias("d"), F.lit(i).alias("id")) for i in ids]))["id"]


def initial_centers(spec: OneHotSpec, k: int, noise: Noise) -> list[list[float]]:
    """Data-independent starts: keyed points inside the public box."""
    import hashlib

    def u(i: int, j: int) -> float:
        return (int(hashlib.md5(f"{noise.key}|start|{i}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    return [[u(i, j) * top for j, top in enumerate(spec.upper)] for i in range(k)]


def rounds_for(n: int, width: int, epsilon: float, k: int) -> int:
    """Few rounds: each one divides the budget, so small or strict problems get fewer."""
    if infinite(epsilon):
        return 7
    return max(2, min(7, int(math.sqrt(n * epsilon / (500.0 * max(1, k)) / max(1.0, math.log(width + 2)))) + 2))


def step(coded: DataFrame, centers: Sequence[Sequence[float]], spec: OneHotSpec, epsilon: float, noise: Noise, round_: int) -> DataFrame:
    """(cluster, count, center) after one noisy update; a row for every cluster, so none shows whether it has rows.

    One aggregate with k * (width + 1) outputs. A row adds at most its clipped coordinates
    to one cluster: counts get Laplace 2 / epsilon; sums share the other half of
    epsilon, each coordinate with the L1 bound of a whole row.
    """
    k, width = len(centers), spec.width
    reach = sum(s for _, s in spec.numeric) + sum(s for _, _, s in spec.blocks)  # L1 norm of a row at most
    found = coded.withColumn("cluster", nearest(F.col("x"), centers)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(width)])
    ids = coded.sparkSession.createDataFrame([(i,) for i in range(k)], "cluster int")
    sums = ids.join(found, "cluster", "left").na.fill(0)
    if infinite(epsilon):
        sums = sums.filter("n > 0")  # nothing is hidden; an empty cluster keeps its centre
    exact = infinite(epsilon)
    count = F.col("n").cast("double") + (F.lit(0.0) if exact else noise.laplace(2.0 / epsilon, "km-count", round_, F.col("cluster")))
    count = F.greatest(count, F.lit(1.0))
    upper = spec.upper
    center = F.array(
        *[F.least(F.greatest((F.col(f"s{j}") + (F.lit(0.0) if exact else noise.laplace(2.0 * reach / epsilon, "km-sum", round_, F.col("cluster"), j))) / count, F.lit(0.0)), F.lit(upper[j])) for j in range(width)]
    )
    return sums.select("cluster", count.alias("count"), center.alias("center"))


def dp_kmeans(rows: DataFrame, spec: OneHotSpec, k: int, epsilon: float, noise: Noise, rounds: int | None = None, n: int | None = None) -> list[list[float]]:
    """Centres after a fixed number of noisy Lloyd rounds; only k * width numbers reach the driver.

    ``n`` is a public row count that sets the rounds; without it a tenth of epsilon buys a noisy one.
    """
    coded = rows.select(onehot(spec).alias("x"))
    if rounds is None and n is None:
        n = coded.count()
        if not infinite(epsilon):
            share, epsilon = 0.1 * epsilon, 0.9 * epsilon
            n = max(1, round(coded.sparkSession.range(1).select(F.lit(float(n)) + noise.laplace(1.0 / share, "km-rows")).first()[0]))
    if n is not None and n < 1:
        raise ValueError("no rows to cluster")
    rounds = rounds_for(n, spec.width, epsilon, k) if rounds is None else rounds
    centers = initial_centers(spec, k, noise)
    each = epsilon if infinite(epsilon) else epsilon / rounds
    coded = coded.persist()
    try:
        for r in range(rounds):
            for row in step(coded, centers, spec, each, noise, r).collect():
                centers[row["cluster"]] = list(row["center"])
    finally:
        coded.unpersist()
    return centers


@dataclass(frozen=True)
class Clustering:
    """One DP k-means of many over the same rows: its release number, weighted space, k, epsilon and noise."""

    number: int
    spec: OneHotSpec
    k: int
    epsilon: float
    noise: Noise


def unit(spec: OneHotSpec) -> OneHotSpec:
    """The space of ``spec`` without weights."""
    return OneHotSpec(tuple((c, 1.0) for c, _ in spec.numeric), tuple((c, d, 1.0) for c, d, _ in spec.blocks))


def scales(spec: OneHotSpec) -> list[float]:
    """What each coordinate of the space without weights is multiplied by."""
    return [s for _, s in spec.numeric] + [s for _, d, s in spec.blocks for _ in d]


def centers_table(spark: SparkSession, clusterings: Sequence[Clustering], centers: Mapping[int, Sequence[Sequence[float]]], rows: Sequence[tuple] | None = None, more: str = "") -> DataFrame:
    """(release, scales, centers and ``more``): one row a clustering, k * width numbers each."""
    rows = [()] * len(clusterings) if rows is None else rows
    data = [(c.number, scales(c.spec), [list(map(float, v)) for v in centers[c.number]], *r) for c, r in zip(clusterings, rows)]
    return spark.createDataFrame(data, "release int, scales array<double>, centers array<array<double>>" + more)


def nearest_of_row(base: str = "base") -> Column:
    """Id of the nearest of a row's ``centers`` to its coordinates ``base`` times ``scales``; ties to the lowest."""
    point = F.zip_with(base, "scales", lambda v, s: v * s)

    def closest(x: Column) -> Column:
        far = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return F.array_min(F.transform("centers", lambda c, i: F.struct(far(c).alias("d"), i.alias("id"))))["id"]

    return F.transform(F.array(point), closest)[0]  # the point is computed once a row, not once a centre


def dp_kmeans_many(rows: DataFrame, clusterings: Sequence[Clustering]) -> dict[int, list[list[float]]]:
    """Release -> centres of all ``clusterings``, which share every pass: as many jobs as the longest of them has rounds, and one that counts.

    Each is what ``dp_kmeans`` makes of it: the same starts, shares of epsilon, scales and keyed noise.
    """
    spark, first = rows.sparkSession, clusterings[0].spec
    coded = rows.select(onehot(unit(first)).alias("base")).persist()
    try:
        n = coded.count()
        if n < 1:
            raise ValueError("no rows to cluster")
        rounds, each = {}, {}
        for c in clusterings:
            noisy, epsilon = n, c.epsilon
            if not infinite(epsilon):
                share, epsilon = 0.1 * epsilon, 0.9 * epsilon
                noisy = max(1, round(n + c.noise.laplace_number(1.0 / share, "km-rows")))
            rounds[c.number] = rounds_for(noisy, c.spec.width, epsilon, c.k)
            each[c.number] = epsilon if infinite(epsilon) else epsilon / rounds[c.number]
        centers = {c.number: initial_centers(c.spec, c.k, c.noise) for c in clusterings}
        by_kind = sorted(clusterings, key=lambda c: c.noise.private)
        for r in range(max(rounds.values())):
            found = None
            for private in sorted({c.noise.private for c in by_kind}):
                now = [c for c in by_kind if rounds[c.number] > r and c.noise.private == private]
                if now:
                    part = _step_many(spark, coded, now, centers, each, r, private)
                    found = part if found is None else found.unionByName(part)
            for row in found.collect():  # a row a centre
                centers[row["release"]][row["cluster"]] = list(row["center"])
    finally:
        coded.unpersist()
    return centers


def _step_many(spark: SparkSession, coded: DataFrame, now: Sequence[Clustering], centers: Mapping[int, Sequence[Sequence[float]]], each: Mapping[int, float], round_: int, private: bool) -> DataFrame:
    """(release, cluster, center) after one noisy update of every clustering: see ``step``."""
    about = []
    for c in now:
        e = each[c.number]
        reach = sum(s for _, s in c.spec.numeric) + sum(s for _, _, s in c.spec.blocks)
        about.append((c.noise.key, infinite(e), 0.0 if infinite(e) else 2.0 / e, 0.0 if infinite(e) else 2.0 * reach / e, [float(u) for u in c.spec.upper]))
    table = centers_table(spark, now, centers, about, ", key string, exact boolean, count_scale double, sum_scale double, upper array<double>")
    width = now[0].spec.width
    met = coded.crossJoin(F.broadcast(table.select("release", "scales", "centers")))  # one row a clustering
    sums = met.withColumn("cluster", nearest_of_row()).groupBy("release", "cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("base")[j]).alias(f"s{j}") for j in range(width)])
    ids = table.select("*", F.posexplode("centers").alias("cluster", "_")).drop("centers", "_")
    whole = ids.join(sums, ["release", "cluster"], "left").na.fill(0).filter("NOT exact OR n > 0")  # without noise, an empty cluster keeps its centre
    noise = Noise(F.col("key"), private)
    count = F.greatest(F.col("n").cast("double") + noise.laplace(F.col("count_scale"), "km-count", round_, F.col("cluster")), F.lit(1.0))
    at = lambda j: F.least(F.greatest((F.col(f"s{j}") * F.col("scales")[j] + noise.laplace(F.col("sum_scale"), "km-sum", round_, F.col("cluster"), j)) / F.col("count"), F.lit(0.0)), F.col("upper")[j])
    return whole.withColumn("count", count).select("release", "cluster", F.array(*[at(j) for j in range(width)]).alias("center"))


def assign(rows: DataFrame, spec: OneHotSpec, centers: Sequence[Sequence[float]], among: Sequence[int] | None = None, name: str = "cluster_id") -> DataFrame:
    return rows.withColumn(name, nearest(onehot(spec), centers, among))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def filled_clusters(pools: DataFrame) -> list[int]:
    """Clusters whose pool has rows; at most k of them."""
    return sorted(r["cluster_id"] for r in pools.select("cluster_id").distinct().collect())
