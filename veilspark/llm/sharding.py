"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get dense numbers 0..n-1 in (id, text hash) order. A generalised Feistel
network permutes Z_a x Z_b, with a*b >= n and a*b - n as small as a search of
nearby factor pairs finds; numbers that land at n or above walk on until they
fall inside. Such a walk meets each of the a*b - n outside points at most once,
so a*b - n + 1 steps always suffice: the walk is exact, not capped. The shard is
the permuted number modulo the shard count, the slot is the quotient: both are
computable from the row number alone, counts differ by at most one and slots
have no gaps.

Law: ``rows``. Equal texts are spread like any other rows.

Edge cases. Null text has size 8 and the checksum of the empty string. Null ids
sort first. Repeated ids are separate rows; rows equal in id and text are
interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage, text_or_empty

ROUNDS = 6
SEED = 20_240_229
#: Most factor pairs searched for the smallest excess; a stays within 1.25 sqrt(n), so both halves mix.
SEARCH = 4096


def domain(n: int) -> tuple[int, int]:
    """(a, b) near sqrt(n) with a*b >= n and the smallest excess among nearby pairs."""
    root = max(2, math.isqrt(max(n, 1)))
    return min(((a, -(-n // a)) for a in range(root, root + min(root // 4, SEARCH) + 1)), key=lambda p: (p[0] * p[1] - n, p[0]))


def _mix(seed: int, round_: Column, half: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), round_, half), F.lit(modulus))


def permute(x: Column, a: int, b: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the network over 0..a*b-1."""
    start = F.struct((x % a).alias("l"), F.call_function("div", x, F.lit(a)).alias("r"))

    def one(acc: Column, i: Column) -> Column:
        l = (acc["l"] + _mix(seed, i * 2, acc["r"], a)) % a
        return F.struct(l.alias("l"), ((acc["r"] + _mix(seed, i * 2 + 1, l, b)) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, one, lambda acc: acc["r"] * a + acc["l"])


def permuted(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The cycle-walked permutation of 0..n-1."""
    a, b = domain(n)
    first = permute(x, a, b, seed, rounds)
    if a * b == n:
        return first
    walk = F.sequence(F.lit(1), F.lit(a * b - n))
    return F.aggregate(walk, first, lambda acc, _: F.when(acc >= n, permute(acc, a, b, seed, rounds)).otherwise(acc))


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with a dense global number in ``order``, and their count.

    Range partitions are written once; a task's rows carry (partition, position),
    and only one count per partition goes through the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stage(sorted_.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__at", 33).cast("int")
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    offset = F.broadcast(spark.createDataFrame(offsets, "__p int, __o long"))  # one row per shuffle partition
    position = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__p", part).join(offset, "__p").withColumn(name, F.col("__o") + position).drop("__p", "__o", "__at"), total


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    dense, n = numbered(rows, ["id", "h"])
    spot = permuted(F.col("row_number"), n, seed).alias("spot") if n else F.lit(0).cast("long").alias("spot")
    out = dense.select("id", "size", "text_crc32", "row_number", spot)
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("spot") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("spot"), F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
