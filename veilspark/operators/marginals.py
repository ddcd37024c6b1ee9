"""Dense marginals over public domains, dependency scores, workloads.

All requested attribute sets are counted in one pass over one integer key; partial aggregation
leaves at most the public grid per task. Grids to densify with have the size that the schema sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import code, col, digitize, target_code
from ..sources.schema import PublicSchema


def encode_rows(rows: DataFrame, schema: PublicSchema, bins: int = 8, strict: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Integer codes: bins for numerics, domain positions for categories, 0/1 for the target."""
    binned = digitize(rows, schema.numeric, bins) if schema.numeric else rows
    return binned.select(
        *[col(k) for k in keep], *[col(c + "_bin").alias(c) for c in schema.numeric],
        *[code(col(c), schema.domain(c), strict).alias(c) for c in schema.categorical], target_code(F.col("target")).alias("target"),
    )


def sizes(schema: PublicSchema, bins: int = 8) -> dict[str, int]:
    """Codes per attribute, from public facts."""
    return {c: bins for c in schema.numeric} | {c: len(schema.domain(c)) for c in schema.categorical} | {"target": 2}


def observed_sizes(coded: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attr, size): the greatest code seen plus one. Depends on private rows; prefer ``sizes``."""
    row = coded.agg(*[(F.max(col(a)) + 1).alias(a) for a in attributes])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), col(a).cast("long").alias("size")) for a in attributes])).alias("x")).select("x.attr", "x.size")


def counted(coded: DataFrame, sets: Sequence[tuple[str, ...]], attributes: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., cell, n): how many rows fall into each cell of the attribute sets' tables laid end to end.

    A row becomes one integer per set (its position in mixed radix behind the sets before it),
    so the only key that is grouped and shuffled is that integer; map tasks fold their rows to at most the public grid.
    Codes outside an attribute's size go to cell -1.
    """
    cells, offset = [], 0
    for s in sets:
        at, inside = F.lit(0).cast("long"), F.lit(True)
        for a in s:
            at = at * attributes[a] + col(a)
            inside = inside & (col(a) >= 0) & (col(a) < attributes[a])
        cells.append(F.when(inside, at + offset).otherwise(F.lit(-1)))
        offset += prod(attributes[a] for a in s)
    return coded.select(*by, F.explode(F.array(*cells)).alias("cell")).groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))


def marginal_tables(coded: DataFrame, sets: Sequence[tuple[str, ...]], attributes: Mapping[str, int], by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """(by..., set_id, at, attrs, codes, n): dense tables of attribute sets of any degree, from one pass.

    ``at`` is a cell's place in its table, row by row. The empty set is a table of one cell: the number of rows.
    ``groups`` lists the values of ``by`` that get tables; without it, those that rows have.
    """
    spark = coded.sparkSession
    about, offset = [], 0
    for i, s in enumerate(sets):
        shape = [attributes[a] for a in s]
        strides = [prod(shape[j + 1 :]) for j in range(len(s))]
        about.append((i, list(s), shape, strides, offset, prod(shape)))
        offset += prod(shape)
    about = spark.createDataFrame(about, "set_id int, attrs array<string>, shape array<int>, strides array<long>, offset long, cells long")
    grid_ = about.withColumn("rel", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    codes = F.zip_with("shape", "strides", lambda n, t: (F.floor(F.col("rel") / t) % n).cast("int"))
    dense = grid_.select("set_id", F.col("rel").alias("at"), "attrs", codes.alias("codes"), (F.col("offset") + F.col("rel")).alias("cell"))
    if by:
        dense = dense.crossJoin(F.broadcast(coded.select(*by).distinct() if groups is None else groups))  # groups are clusters: few
    found = counted(coded, sets, attributes, by)
    return dense.join(found, [*by, "cell"], "left").select(*by, "set_id", "at", "attrs", "codes", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grid(spark, attributes: Mapping[str, int], set_: tuple[str, ...]) -> DataFrame:
    """Every code combination of one attribute set."""
    out = None
    for a in set_:
        one = spark.range(attributes[a]).select(F.col("id").cast("int").alias(a))
        out = one if out is None else out.crossJoin(one)
    return out


def one_way(coded: DataFrame, attr: str, size: int) -> DataFrame:
    """(code, n), dense and in code order."""
    found = coded.groupBy(col(attr).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid(coded.sparkSession, {"code": size}, ("code",))).join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def two_way(coded: DataFrame, a: str, b: str, attributes: Mapping[str, int]) -> DataFrame:
    """(code_a, code_b, n), dense."""
    found = coded.groupBy(col(a).alias("code_a"), col(b).alias("code_b")).agg(F.count(F.lit(1)).alias("n"))
    cells = grid(coded.sparkSession, {"code_a": attributes[a], "code_b": attributes[b]}, ("code_a", "code_b"))
    return F.broadcast(cells).join(found, ["code_a", "code_b"], "left").select("code_a", "code_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def all_pairs(attributes: Sequence[str], degree: int = 2) -> list[tuple[str, ...]]:
    return list(combinations(attributes, degree))


def target_star(features: Sequence[str]) -> list[tuple[str, str]]:
    return [(f, "target") for f in features]


def pair_marginals(coded: DataFrame, pairs: Sequence[tuple[str, str]], attributes: Mapping[str, int], by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """(by..., attr_a, attr_b, code_a, code_b, n): dense tables of all pairs from one pass."""
    t = marginal_tables(coded, pairs, attributes, by, groups)
    return t.select(*by, F.col("attrs")[0].alias("attr_a"), F.col("attrs")[1].alias("attr_b"), F.col("codes")[0].alias("code_a"), F.col("codes")[1].alias("code_b"), "n")


def independence_difference(pairs: DataFrame) -> DataFrame:
    """(attr_a, attr_b, indif): sum over the dense table of |n_a n_b / N - n_ab|, N at least 1.

    Row and column sums come from the pair table itself, so nothing is scanned again.
    """
    from pyspark.sql import Window

    pair = ["attr_a", "attr_b"]
    total = F.greatest(F.sum("n").over(Window.partitionBy(*pair)), F.lit(1)).cast("double")
    na, nb = (F.sum("n").over(Window.partitionBy(*pair, c)).cast("double") for c in ("code_a", "code_b"))
    return pairs.withColumn("gap", F.abs(na * nb / total - F.col("n"))).groupBy(*pair).agg(F.sum("gap").alias("indif"))


def target_difference(coded: DataFrame, pairs: Sequence[tuple[str, str]], attributes: Mapping[str, int]) -> DataFrame:
    """``independence_difference`` of the pairs with the target; all others score 0 and are not counted."""
    with_target = [p for p in pairs if "target" in p]
    rest = [(a, b, 0.0) for a, b in pairs if "target" not in (a, b)]
    found = independence_difference(pair_marginals(coded, with_target, attributes))
    return found.unionByName(coded.sparkSession.createDataFrame(rest, "attr_a string, attr_b string, indif double"))


def workload_answers(tables: DataFrame, table: Sequence[str] = ("attr_a", "attr_b")) -> DataFrame:
    """Marginal cells as shares of all rows; ``table`` names the columns that tell tables apart."""
    from pyspark.sql import Window

    total = F.greatest(F.sum("n").over(Window.partitionBy(*table)), F.lit(1)).cast("double")
    return tables.withColumn("answer", F.col("n") / total).drop("n")
