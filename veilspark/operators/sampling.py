"""Splits and samples by keyed hash ranks: exact sizes, reproducible, free of partition order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.rand import Noise, order_key


#: Rows of a hash cell that may be gathered (the driver's look at a cut) or sorted by one task (positions); hex digits counted at a time.
CUT_ROWS, CELL_ROWS, DIGITS, HEX = 4096, 100_000, 3, 32


def disjoint_split(df: DataFrame, fraction: float, seed: int, key: str = "row_id", n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reserved, rest): clip(floor(f n), 1, n - 1) rows by least hash, and all others.

    The cut is one (hash, key) pair, so both sides are filters on the scan: no join,
    and nobody sorts the table in one task.
    """
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie inside (0, 1), not {fraction}")
    n = df.count() if n is None else n
    if n < 2:
        raise ValueError("a split needs two rows")
    take = min(max(math.floor(fraction * n), 1), n - 1)
    h, k = cut_at(df, take, n, seed, key)
    mine = order_key(seed, col(key))
    low = (mine < h) | ((mine == h) & (col(key) <= k))
    return df.filter(low), df.filter(~low)


def cut_at(df: DataFrame, take: int, n: int, seed: int, key: str) -> tuple[str, object]:
    """The ``take``-th least (hash, key) of ``n`` rows, by radix selection.

    Rows are counted by their next hex digits (at most 16**3 counts) and the cell that holds
    the cut is entered, until it holds few rows; only those are looked at. Rows of equal keys count one by one.
    """
    h = order_key(seed, col(key))
    prefix, size = "", n
    while size > CUT_ROWS and len(prefix) < HEX:
        inside = df.filter(h.startswith(prefix)) if prefix else df
        cells = inside.groupBy(F.substring(h, len(prefix) + 1, min(DIGITS, HEX - len(prefix))).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        for c, size in sorted((r["c"], r["n"]) for r in cells.collect()):  # at most 16**DIGITS rows
            if take <= size:
                prefix += c
                break
            take -= size
        else:
            raise AssertionError("take exceeds the rows")
    inside = df.filter(h.startswith(prefix)) if prefix else df
    found = inside.groupBy(h.alias("h"), col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most CUT_ROWS rows, or one hash
    for r in sorted(found, key=lambda r: (r["h"], r["k"])):
        take -= r["n"]
        if take <= 0:
            return r["h"], r["k"]
    raise AssertionError("take exceeds the rows")


def positions(df: DataFrame, groups: list[str], order: Column, key: str, name: str, n: int) -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its groups by (``order``, ``key``).

    ``order`` is a hash in hex. Rows are dealt by as many leading digits as keep cells of ``n`` rows
    small; a cell is sorted by itself, and the number of rows in earlier cells is added. No task holds a group.
    """
    digits = 0
    while n > CELL_ROWS * 16**digits and digits < HEX:
        digits += 1
    tagged = df.withColumn("__o", order).withColumn("__cell", F.substring("__o", 1, digits))
    cells = tagged.groupBy(*groups, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(*groups, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*groups, "__cell").orderBy("__o", key)) - 1
    return tagged.join(before, [*groups, "__cell"]).withColumn(name, nth + F.col("__before")).select(*[col(c) for c in df.columns], name)


def balanced(df: DataFrame, per_class: int, seed: int, key: str = "row_id", label: str = "target") -> DataFrame:
    """min(positives, negatives, per_class) rows of each class by least hash, in hash order; maybe none."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    k = min(sizes.get(1, 0), sizes.get(0, 0), per_class)
    h = order_key(seed, col(key))
    of = lambda y: df.filter(col(label) == y).withColumn("__h", h).orderBy("__h", key).limit(k)
    return of(1).unionByName(of(0)).orderBy("__h", key).drop("__h")


def balanced_demos(queries: DataFrame, pool: DataFrame, shots: int, seed: int | Column, query_key: str = "query_id", pool_key: str = "pool_id", label: str = "target", by: str | Sequence[str] | None = None, pool_rows: int | None = None) -> DataFrame:
    """(query key, demo_rank, pool columns): label-balanced demonstrations for every query.

    Half of the shots (rounded down) are positive. A class with rows enough
    gives distinct rows, else keyed draws with replacement; a pool with one class gives
    distinct rows of it. Pools join by ``by`` (a cluster id, or several columns) if given, and ``seed`` may be a column of both sides. For a query, a class of m
    rows is read from a keyed start with a keyed stride, so picks are distinct without ranking the pool per query:
    the join carries exactly the shots, never queries x pool. ``pool_rows``: about how many rows the pool has, if that is known.
    """
    if shots <= 0:
        raise ValueError("shots must be positive")
    keys = [by] if isinstance(by, str) else list(by or [])
    ranked = positions(pool, [*keys, label], order_key(seed, "pool", col(pool_key)), pool_key, "__pos", pool.count() if pool_rows is None else pool_rows)
    sizes = pool.groupBy(*keys).agg(F.count(F.when(col(label) == 1, 1)).alias("n1"), F.count(F.when(col(label) == 0, 1)).alias("n0"))
    q = queries.join(F.broadcast(sizes), keys) if keys else queries.crossJoin(F.broadcast(sizes))  # one row a pool
    k = F.least(F.lit(shots), F.col("n1") + F.col("n0")).cast("int")
    k1 = F.when(F.col("n1") == 0, 0).when(F.col("n0") == 0, k).otherwise(F.floor(k / 2)).cast("int")
    q = q.withColumn("__k", k).withColumn("__k1", k1).filter("__k > 0")
    slots = q.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    slots = slots.withColumn("__y", F.when(F.col("__slot") < F.col("__k1"), 1).otherwise(0))
    m = F.when(F.col("__y") == 1, F.col("n1")).otherwise(F.col("n0"))
    want = F.when(F.col("__y") == 1, F.col("__k1")).otherwise(F.col("__k") - F.col("__k1"))
    nth = F.when(F.col("__y") == 1, F.col("__slot")).otherwise(F.col("__slot") - F.col("__k1"))
    rng = Noise(seed.cast("string")) if isinstance(seed, Column) else Noise.test(seed)
    start = F.floor(rng.uniform("start", col(query_key), F.col("__y")) * m)
    draw = F.floor(rng.uniform("draw", col(query_key), F.col("__slot")) * m)
    slots = slots.withColumn("__pos", F.when(want <= m, (start + nth) % m).otherwise(draw).cast("long"))
    order = order_key(seed + 3, col(query_key), F.col("__slot"))
    slots = slots.withColumn("demo_rank", F.row_number().over(Window.partitionBy(*keys, query_key).orderBy(order, "__slot")))
    joined = slots.select(query_key, "demo_rank", *keys, "__y", "__pos").join(ranked.withColumnRenamed(label, "__y"), [*keys, "__y", "__pos"])
    return joined.select(query_key, "demo_rank", *[F.col("__y").alias(label) if c == label else col(c) for c in pool.columns])
