"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: shares of the whole in proportion to the
weights, stopped at ``max_repeat`` times the source's own words, the excess
reshared by weight until no target is above its stop (water filling). Inside a source a
document's expected copies are proportional to the bit length of its word count, so that long
documents, which carry more context, are likelier; they stop at ``max_repeat``, and what
stopped documents leave is reshared among the others until the source's expected words are
its target. The whole part of the expected copies is certain; the remainder is the document's inclusion
probability p. Documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken in that
order: the sample size that is fixed is the source's words, so the order stops
where the next document would pass the goal. What is left of the goal goes to
the documents of lower rank that still fit, by the same order. At last up to three documents are
added and up to three given back, if that brings the mix nearer to its target: of all such changes among
the ``CHOICES`` or so documents of the source with the least u (all, if it has no more) the one that comes nearest.

The outcome is a handful of bounds per source and length class (``plan_mix``), so a document's
copies are a pure function of its own row. The bounds come from pre-aggregated
digits of the rank: level by level only the rows of one cell of 4096 remain, so
no source, however hot, is sorted or summed in one task.

Edge cases. Null text has size 0. The null source is a source of its own, last
in order; ids may be null or repeat (rows equal in id and text share one rank
and change together). Sources without words have target 0. An empty table
gives an empty result. Reruns agree: u is a hash of seed, id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, WORD, stage, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 1729
LEVELS, CELLS = 2, 4096
#: Documents of a source that the last change chooses from, about, and how many may come and go.
CHOICES, MOVES = 24, 3


def source_key(name: str = "source") -> Column:
    """Sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("t"))


def words(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def uniform(id_col: str, text_col: str, seed: int) -> Column:
    """A hash of seed, id and text, strictly inside (0, 1), with 52 bits."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.md5(text_or_empty(text_col).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source_key, source_size, target).

    Sources are a dimension: one row each, ordered by code point for the weights.
    """
    by_name = Window.orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filling = Window.orderBy("level", "source_key").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(max_repeat))).withColumn("level", F.col("stop") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("stopped", F.sum("stop").over(filling)).withColumn("weight_to", F.sum("weight").over(filling))
    s = s.withColumn("full", F.col("stopped") + F.col("level") * (F.col("all_weight") - F.col("weight_to")) <= F.col("total"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("stop")).otherwise(0.0)).over(everything)
    open_weight = F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("full"), F.col("stop")).otherwise(F.least(F.col("weight") * rest / open_weight, F.col("stop")))
    return s.withColumn("target", target).select("source_key", "source_size", "target")


def length_class(size: Column) -> Column:
    """The bit length of the word count: what a document's expected copies are proportional to."""
    return F.length(F.bin(size)).cast("int")


def expected(classes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source_key, class, source_size, target, whole, p, goal) from (source_key, class, words, source_size, target).

    A few dozen classes a source at most. Classes stop at ``max_repeat`` from the longest down, the others share
    what is left; goal: the source's words that the certain copies leave to sampling.
    """
    top = float(max_repeat)
    source = Window.partitionBy("source_key")
    longer = source.orderBy(F.desc("class"))
    c = classes.withColumn("weighted", F.col("words") * F.col("class"))
    below = F.sum("weighted").over(source) - F.sum("weighted").over(longer)
    c = c.withColumn("full", F.lit(top) * F.sum("words").over(longer) + F.lit(top) / F.col("class") * below <= F.col("target"))
    held = F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))).over(source), F.lit(0))
    rate = (F.col("target") - F.lit(top) * held) / F.sum(F.when(~F.col("full"), F.col("weighted"))).over(source)
    c = c.withColumn("copies", F.when(F.col("full"), F.lit(top)).otherwise(F.least(rate * F.col("class"), F.lit(top))))
    c = c.withColumn("whole", F.floor("copies").cast("long"))
    goal = F.greatest(F.col("target") - F.sum(F.col("words") * F.col("whole")).over(source), F.lit(0.0))
    return c.select("source_key", "class", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("p"), goal.alias("goal"))


def rank(u: Column, p: Column) -> Column:
    """Pareto rank squeezed to (0, 1): q / (1 + q) keeps the order of q."""
    q = (u / (1.0 - u)) / (p / (1.0 - p))
    return F.when((p > 0) & (p < 1), q / (1.0 + q))


def _prefix(rows: DataFrame, goals: DataFrame, hint) -> DataFrame:
    """(source_key, cut, used): the longest rank prefix of each source that stays within its goal.

    ``rows``: source_key, size, y. ``goals``: source_key, goal. cut is -1 if
    nothing fits; rows of equal rank stand or fall together.
    """
    state = goals.select("source_key", "goal", F.lit(0).cast("long").alias("used"), F.lit(-1.0).alias("cut"))
    left = rows
    for level in range(1, LEVELS + 1):
        digit = F.floor(F.col("y") * float(CELLS**level)).cast("long")
        cells = left.withColumn("cell", digit).groupBy("source_key", "cell").agg(F.sum("size").alias("size"), F.max("y").alias("top"))
        run = F.sum("size").over(Window.partitionBy("source_key").orderBy("cell"))
        seen = cells.withColumn("run", run).join(hint(state), "source_key").withColumn("fits", F.col("used") + F.col("run") <= F.col("goal"))
        edge = seen.groupBy("source_key").agg(
            F.max(F.when(F.col("fits"), F.col("run"))).alias("more"), F.max(F.when(F.col("fits"), F.col("top"))).alias("top"), F.min(F.when(~F.col("fits"), F.col("cell"))).alias("edge")
        )
        state = stage(
            state.join(hint(edge), "source_key", "left").select("source_key", "goal", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"), F.coalesce("top", "cut").alias("cut"), "edge"), "mix-level"
        )
        left = left.withColumn("cell", digit).join(hint(state.filter("edge IS NOT NULL").select("source_key", "edge")), "source_key").filter("cell = edge").drop("cell", "edge")
        state = state.drop("edge")
    run = F.sum("size").over(Window.partitionBy("source_key").orderBy("y").rangeBetween(Window.unboundedPreceding, 0))
    last = left.withColumn("run", run).join(hint(state), "source_key").filter(F.col("used") + F.col("run") <= F.col("goal"))
    last = last.groupBy("source_key").agg(F.max("run").alias("more"), F.max("y").alias("top"))
    return state.join(hint(last), "source_key", "left").select("source_key", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"), F.coalesce("top", "cut").alias("cut"))


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, bounds): a staged narrow row per document, and the bounds of each source and length class.

    rows: id, source_key, size, class, u. bounds: source_key, class, source_size, target, whole,
    p, cut, room, cut2, add, drop.
    """
    rows = docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("source_key"), words(text_col).alias("size"), uniform(id_col, text_col, seed).alias("u"))
    rows = stage(rows.withColumn("class", length_class(F.col("size"))), "mix-rows")
    classes = stage(rows.groupBy("source_key", "class").agg(F.sum("size").alias("words")), "mix-classes")
    few = classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)  # a few dozen rows a source at most
    goals = stage(targets(classes.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, max_repeat), "mix-targets")
    plan = stage(expected(classes.join(hint(goals), "source_key"), max_repeat), "mix-plan")
    known = rows.filter("size > 0").join(hint(plan.select("source_key", "class", "whole", "p")), ["source_key", "class"]).select("source_key", "size", "u", "whole", rank(F.col("u"), F.col("p")).alias("y"))
    ranked = known.filter("y IS NOT NULL").select("source_key", "size", "y")
    goal = plan.groupBy("source_key").agg(F.first("goal").alias("goal"))
    first = stage(_prefix(ranked, goal, hint), "mix-first")
    state = stage(goal.join(hint(first), "source_key").select("source_key", (F.col("goal") - F.col("used")).alias("room"), "cut"), "mix-state")
    fitting = ranked.join(hint(state), "source_key").filter("y > cut AND size <= room").select("source_key", "size", "y")
    second = stage(_prefix(fitting, state.select("source_key", F.col("room").alias("goal")), hint), "mix-second")
    state = stage(state.join(hint(second.select("source_key", F.col("used").alias("used2"), F.col("cut").alias("cut2"))), "source_key").withColumn("left", F.col("room") - F.col("used2")), "mix-state2")
    counts = rows.filter("size > 0").groupBy("source_key").agg(F.count(F.lit(1)).alias("rows"))
    change = best_change(known.join(hint(state), "source_key").join(hint(counts), "source_key"), state, max_repeat)
    bounds = plan.drop("goal").join(hint(state.drop("used2", "left")), "source_key").join(hint(change), "source_key", "left")
    return rows, stage(bounds, "mix-bounds")


def sums(choices: DataFrame) -> DataFrame:
    """(source_key, sum, us): the sums of up to ``MOVES`` different ``choices`` (source_key, u, size) of a source, each with the first set of u that makes it."""
    one = choices.select("source_key", F.col("size").alias("sum"), F.array("u").alias("us"))
    found, more = one, one
    for _ in range(MOVES - 1):
        more = more.join(choices, "source_key").filter(F.element_at("us", -1) < F.col("u")).select("source_key", (F.col("sum") + F.col("size")).alias("sum"), F.concat("us", F.array("u")).alias("us"))
        found = found.unionByName(more)
    return found.groupBy("source_key", "sum").agg(F.min("us").alias("us"))


def best_change(known: DataFrame, state: DataFrame, max_repeat: int) -> DataFrame:
    """(source_key, add, drop): u of the documents to take once more and of those to take once less.

    A source's choices are its rows with u at most ``CHOICES`` over their number, so a handful whatever its size. For each sum
    that may go (or none) the sums just below and above what is then left are tried. A document in both lists stays as it is.
    Sources that no change brings nearer have no row.
    """
    taken = known.filter(F.col("u") * F.col("rows") <= CHOICES).withColumn("n", F.col("whole") + taken_more())
    # rows equal in id and text change together
    choices = stage(taken.groupBy("source_key", "u").agg(F.sum("size").alias("size"), F.max("n").alias("n")), "mix-choices")
    none = state.select("source_key", F.lit(0).cast("long").alias("sum"), F.array().cast("array<double>").alias("us"))
    some = lambda on: stage(sums(choices.filter(on).drop("n")).unionByName(none).join(state.select("source_key", "left"), "source_key"), "mix-sums")
    move = "struct<sum:long,us:array<double>>"
    offers = some(F.col("n") < max_repeat).select("source_key", F.col("sum").cast("double").alias("at"), F.lit(0).alias("kind"), "left", F.struct("sum", "us").alias("offer"), F.lit(None).cast(move).alias("given"))
    asks = some(F.col("n") > 0).select("source_key", (F.col("left") + F.col("sum")).alias("at"), F.lit(1).alias("kind"), "left", F.lit(None).cast(move).alias("offer"), F.struct("sum", "us").alias("given"))
    # two running windows: a frame to the end of the partition would be computed anew for every row
    line = Window.partitionBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    below = F.last("offer", ignorenulls=True).over(line.orderBy("at", "kind"))
    above = F.last("offer", ignorenulls=True).over(line.orderBy(F.desc("at"), F.desc("kind")))
    near = offers.unionByName(asks).select("*", F.array(below, above).alias("near")).filter("kind = 1")
    pairs = near.select("source_key", "at", "left", "given", F.explode("near").alias("offer")).filter("offer IS NOT NULL")
    pairs = pairs.withColumn("miss", F.abs(F.col("at") - F.col("offer.sum"))).filter(F.col("miss") < F.col("left"))
    best = pairs.groupBy("source_key").agg(F.min(F.struct("miss", F.col("given.sum").alias("d"), F.col("offer.sum").alias("a"), F.col("offer.us").alias("add"), F.col("given.us").alias("drop"))).alias("best"))
    return stage(best.select("source_key", "best.add", "best.drop"), "mix-change")


def taken_more() -> Column:
    """1 if a row is sampled beyond its whole copies by rank, else 0."""
    more = (F.col("y") <= F.col("cut")) | ((F.col("size") <= F.col("room")) & (F.col("y") <= F.col("cut2")))
    return F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)


def copies() -> Column:
    """Copies taken of a row (size, u, y), given the bounds of its source and class."""
    one = lambda c: F.when(F.coalesce(F.array_contains(c, F.col("u")), F.lit(False)), 1).otherwise(0)
    return F.when(F.col("size") > 0, F.col("whole") + taken_more() + one("add") - one("drop")).otherwise(0)


def _bounded(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    few = bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(bounds) if few else bounds, ["source_key", "class"]).withColumn("y", rank(F.col("u"), F.col("p")))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    rows, bounds = plan_mix(docs, id_col=id_col, **options)
    return _bounded(rows, bounds).select(F.col("id").alias(id_col), "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mixed documents: the input's columns, each row as many times as it is taken.

    Documents without words have no share of any target and stay away.
    """
    _, bounds = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    # the row travels as one struct: its column names may clash with any of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key(source_col).alias("source_key"), words(text_col).alias("size"), uniform(id_col, text_col, seed).alias("u"))
    taken = _bounded(rows.withColumn("class", length_class(F.col("size"))), bounds).select("row", copies().cast("int").alias("n"))
    # array_repeat of nothing is empty, so no copy comes of rows that are not taken
    return taken.select(F.explode(F.array_repeat(F.lit(1), F.col("n"))), "row").select("row.*")
