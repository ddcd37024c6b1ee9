"""Exact dedup over an extendible-hash index kept on shared files.

A 64-bit key is hashed from every normalised text. Keys are counted first, in
one narrow pass, and a directory is grown over their leading bits: it starts as one bucket, and
while a bucket holds more rows than ``capacity`` it is split on its next bit; the
directory doubles whenever a bucket's local depth would pass the global one. Buckets are
contiguous key ranges. Then every row is routed through the directory to the task that
owns its bucket. The owner sorts its rows by (key, text), so that texts whose keys collide
form a chain, tells the chain's members apart by their bytes, and names for each the
smallest id and the number of rows. What it finds is the index: one narrow row
per document, written to the shared folder; a bucket's rows lie in one file.

A key that alone exceeds the capacity cannot be split by more bits: it is an overflow chain. Its
rows are dealt to several owners; each compares its share, and one row per
owner and text, with its bytes, is compared again, so no task ever reads a whole hot group.
The directory is a table: it is grown, kept and looked up without passing the driver. A bucket holds ``CAPACITY`` rows
until there are a million full ones (``BUCKETS``, some 270 million documents); from then on it holds
a millionth of the rows, so that the directory and the list of overflow chains stay small enough to send to every task.

Edge cases. Null text counts as empty; all empty texts form one group. Null
doc_ids sort last: they stay only if every copy has a null doc_id. Repeated
doc_ids are ordinary rows. An empty table gives an empty result. Columns of any other
name are left alone: the operator reads two columns, and ``dedup`` carries the rest as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WHITE, small_or_plain, stage, text_or_empty

#: Rows a bucket may hold before it splits, unless that made more than ``BUCKETS`` full ones.
CAPACITY, BUCKETS = 256, 1 << 20
#: Bits of the key that are counted at a time while the directory grows.
LEVEL = 12
_FLIP = -(1 << 63)  # makes unsigned order of keys the order of longs


@dataclass(frozen=True)
class Directory:
    """``table`` (least, depth): the least key and the local depth of every bucket; ``chains`` is the number of overflow chains."""

    table: DataFrame
    capacity: int
    chains: int = 0

    @property
    def buckets(self) -> tuple[tuple[int, int], ...]:
        """(prefix, local depth) of every bucket, in key order, on the driver: for a look at small directories."""
        found = sorted((r["least"] - _FLIP, r["depth"]) for r in self.table.collect())
        return tuple((least >> (64 - depth), depth) for least, depth in found)

    @property
    def depth(self) -> int:
        """The global depth."""
        return self.table.agg(F.max("depth")).first()[0]

    def cells(self) -> DataFrame:
        """(cell, buckets): the directory's pages, for every value of the leading ``LEVEL`` bits the buckets there by least key."""
        first = F.shiftrightunsigned(F.col("least").bitwiseXOR(_FLIP), 64 - LEVEL)
        span = F.when(F.col("depth") >= LEVEL, 1).otherwise(F.expr(f"shiftleft(1L, cast({LEVEL} - least({LEVEL}, depth) AS int))"))
        rows = self.table.select("least", F.explode(F.sequence(first, first + span - 1)).alias("cell"))
        return rows.groupBy("cell").agg(F.sort_array(F.collect_list("least")).alias("buckets"))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Grow the directory over counted ``keys`` (key, n).

    Level by level the keys of overfull cells alone are counted, by the next ``LEVEL`` bits; inside a cell a bucket
    ends at the first bit after which it is not overfull. A cell of 64 bits is one key and stays whole, however many rows it has.
    """
    spark = keys.sparkSession
    rows, most = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    capacity = max(capacity, -(-rows // BUCKETS))
    chains = keys.filter(F.col("n") > capacity).count() if most > capacity else 0
    pages, depth, found = spark.createDataFrame([(0,)], "page long"), 0, None
    while True:
        more = min(LEVEL, 64 - depth)
        at = _prefix(depth) if depth else F.lit(0).cast("long")
        cell = _prefix(depth + more).bitwiseAND((1 << more) - 1)
        counted = keys.groupBy(at.alias("page"), cell.alias("cell")).agg(F.sum("n").alias("n"))
        grid = pages.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << more) - 1).cast("long"))))
        loads = grid.join(counted, ["page", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0))).repartition("page")
        upto = F.sum("n").over(Window.partitionBy("page").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        page = loads.select("page", "cell", upto.alias("upto")).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("cell", "upto"))).alias("cells"))  # 2**LEVEL cells
        last = depth + more == 64
        rows_upto = F.transform("cells", lambda c: c["upto"])

        def local(cell: Column, upto: Column) -> Column:
            """The first bit that is enough for the bucket around a cell, null if none is."""
            found = F.lit(more).cast("int") if last else F.lit(None).cast("int")
            for d in range(more, -1, -1):
                head = F.shiftright(cell, more - d)
                first, end = F.shiftleft(head, more - d).cast("int"), F.shiftleft(head + 1, more - d).cast("int")
                before = F.when(first == 0, F.lit(0).cast("long")).otherwise(F.get(upto, first - 1))
                found = F.when(F.get(upto, end - 1) - before <= capacity, d).otherwise(found)
            return found

        # the running sums are made once a page, not once a cell
        cut = F.transform(F.array(rows_upto), lambda upto: F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), local(c["cell"], upto).alias("d"))))[0]
        split = stage(page.select("page", F.inline(cut)), "exact-directory")
        done = split.filter("d IS NOT NULL").select("page", F.expr(f"shiftright(cell, {more} - d)").alias("head"), "d").distinct()
        left = F.expr(f"shiftleft(page, {more}) | shiftleft(head, {more} - d)")  # the bucket's bits, filled up with zeros
        buckets = done.select(F.shiftleft(left, 64 - depth - more).bitwiseXOR(_FLIP).alias("least"), (F.col("d") + depth).cast("int").alias("depth"))
        found = buckets if found is None else found.unionByName(buckets)
        over = split.filter("d IS NULL").select(F.expr(f"shiftleft(page, {more}) | cell").alias("page"))
        if last or not over.limit(1).count():
            return Directory(stage(found, "exact-buckets"), capacity, chains)
        depth += more
        pages = over
        keys = keys.join(small_or_plain(over), _prefix(depth) == F.col("page"), "left_semi")


def text_key(norm: Column, bits: int = 64) -> Column:
    """The leading ``bits`` of the text's hash; fewer than 64 force collisions, for tests."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def _routed(docs: DataFrame, id_col: str, text_col: str, carried: list[Column], capacity: int, key_bits: int) -> tuple[DataFrame, Directory]:
    """(rows at their owners, directory): id, norm, key, bucket, part, parts and ``carried``."""
    norm = F.regexp_replace(text_or_empty(text_col), WHITE, " ")
    keys = docs.select(norm.alias("norm")).select(text_key(F.col("norm"), key_bits).alias("key"))
    keys = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    directory = build_directory(keys, capacity)
    pages = directory.cells()
    chains = keys.filter(F.col("n") > directory.capacity).select("key", F.ceil(F.col("n") / directory.capacity).cast("int").alias("parts"))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *carried).withColumn("key", text_key(F.col("norm"), key_bits))
    rows = rows.withColumn("cell", _prefix(LEVEL)).join(F.broadcast(pages), "cell")  # 2**LEVEL rows, about 2 * BUCKETS longs
    rows = rows.join(F.broadcast(chains), "key", "left")  # fewer than BUCKETS rows
    here = F.filter("buckets", lambda least: least <= F.col("key").bitwiseXOR(_FLIP))
    rows = rows.withColumn("bucket", F.element_at(here, -1)).drop("cell", "buckets")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", part).withColumn("parts", F.coalesce("parts", F.lit(1)))
    return rows.repartition("bucket", "part"), directory


def _same_text() -> Window:
    # the owner's partitioning by (bucket, part) serves; rows come sorted by key, then bytes
    return Window.partitionBy("key", "bucket", "part", "norm")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, Directory]:
    """(index, directory). The index is staged, a row per document in key ranges:

    id, key, bucket, chain (number of the text among those of its key at this owner), digest,
    keep_id, group_size; part, parts and, on one row per text of an overflow chain, its bytes (norm).
    """
    rows, directory = _routed(docs, id_col, text_col, [], capacity, key_bits)
    same = _same_text()
    rows = rows.withColumn("keep_id", F.min("id").over(same)).withColumn("group_size", F.count(F.lit(1)).over(same))
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy("id")))
    rows = rows.withColumn("chain", F.dense_rank().over(Window.partitionBy("key", "bucket", "part").orderBy("norm")))
    bytes_ = F.when((F.col("parts") > 1) & (F.col("nth") == 1), F.col("norm"))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    return stage(rows.select("id", "key", "bucket", "part", "parts", "chain", "keep_id", "group_size", digest.alias("digest"), bytes_.alias("norm")), "exact-index"), directory


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Among equal texts the smallest id stays; if a kept id is repeated on equal
    rows, each such row reports ``kept``. ``dedup`` keeps exactly one.
    """
    index, _ = build_index(docs, id_col, text_col, **options)
    settled = index.filter("parts = 1").select("id", "digest", "keep_id", "group_size")
    # overflow chains: one row per owner and text, compared by bytes once more
    shares = index.filter("norm IS NOT NULL").groupBy("key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("digest").alias("digest"))
    chains = stage(shares.select("digest", "keep_id", "group_size"), "exact-chains")
    rest = index.filter("parts > 1").select("id", "digest").join(small_or_plain(chains), "digest").select("id", "digest", "keep_id", "group_size")
    found = settled.unionByName(rest)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """The documents that stay, with all their columns: one per group of equal texts.

    Rows travel whole to the owner of their bucket, once; a text that normalisation leaves as it is
    travels once, too. Of rows equal in id and text the one that stays is any of them.
    """
    text = F.col(f"`{text_col}`")
    others = [c for c in docs.columns if c != text_col]
    norm = F.regexp_replace(text_or_empty(text_col), WHITE, " ")
    plain = text.cast("string").eqNullSafe(norm)
    carried = [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), plain.alias("plain"), F.when(~plain, text).alias("raw")]
    rows, directory = _routed(docs, id_col, text_col, carried, capacity, key_bits)
    order = F.col("id").asc_nulls_last()
    first = rows.withColumn("nth", F.row_number().over(_same_text().orderBy(order))).filter("nth = 1")
    if directory.chains:  # only overflow chains have more than one owner; their few local firsts are compared once more
        again = first.filter("parts > 1").withColumn("nth", F.row_number().over(Window.partitionBy("key", "norm").orderBy(order))).filter("nth = 1")
        first = first.filter("parts = 1").unionByName(again)
    kind = docs.schema[text_col].dataType
    back = {text_col: F.when(F.col("plain"), F.col("norm").cast(kind)).otherwise(F.col("raw"))}
    return first.select(*[back[c].alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
