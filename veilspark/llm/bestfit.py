"""Best-fit packing of whole documents: large ones matched in pairs, smaller ones into the tightest gaps.

A document longer than the window is cut into whole windows and a rest; nothing else is cut. What fits a window depends
on lengths alone, and a length is a number from 1 to the window, so the plan is made from
the number of pieces of each length (at most 2,048 numbers, however many documents there are) and covers all
of them at once:

1. At most two pieces of over a third of the window fit together. From the longest down, each takes
   the longest such piece that still fits: a matching with as many pairs as possible.
2. The smaller pieces, from the longest down, go to the window with the smallest gap that holds them;
   a new window is opened only where no gap does.

The plan is a list of steps "so many pieces of this length, so many to a window, from this window on"; a piece
finds its step by its rank among the pieces of its length. Ranks are counted while tokenising, inside
each task, and get the number of pieces of earlier tasks added by one join, so no length is ever gathered in one place,
however many documents share it. Texts are tokenised once; only lengths and checksums are staged.

Edge cases. Null and empty texts are the end token alone. Ids may be null or
repeat: a row is packed for itself. Very long texts are tokenised whole. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .packing import BATCH_CHARS, slices
from .shared import small_or_plain, stage

WINDOW, END = 2048, 0

#: A step of the plan: pieces of ``length`` with ranks from ``rank`` on, ``n`` of them, ``each`` to a window from ``first`` on, behind ``used`` tokens.
STEP = ("length", "rank", "n", "each", "first", "used")


def plan(counts: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """The steps that place ``counts`` (length -> pieces), as tuples of ``STEP``."""
    if any(not 0 < size <= window for size in counts):
        raise ValueError("lengths lie between 1 and the window")
    left, placed, steps = Counter({size: n for size, n in counts.items() if n > 0}), Counter(), []
    windows, gaps, open_gaps = 0, defaultdict(list), 0  # gap -> [(first window, windows)], and the gaps that have any, as bits

    def place(size: int, first: int, n: int, each: int, used: int) -> None:
        steps.append((size, placed[size], n * each, each, first, used))
        placed[size] += n * each
        left[size] -= n * each

    def keep(gap: int, first: int, n: int) -> None:
        nonlocal open_gaps
        if gap and n:
            gaps[gap].append((first, n))
            open_gaps |= 1 << gap

    large = 0
    for size in left:
        large |= (3 * size > window) << size
    while large:
        size = large.bit_length() - 1
        fits = large & ((1 << (window - size + 1)) - 1)
        if left[size] == 1 and fits >> size & 1:
            fits ^= 1 << size
        other = fits.bit_length() - 1
        n = left[size] if other < 0 else left[size] // 2 if other == size else min(left[size], left[other])
        if other == size:
            place(size, windows, n, 2, 0)
        else:
            place(size, windows, n, 1, 0)
            if other > 0:
                place(other, windows, n, 1, size)
        keep(window - size - max(other, 0), windows, n)
        windows += n
        for s in {size, other} - {-1}:
            if not left[s]:
                large &= ~(1 << s)
    for size in sorted(left, reverse=True):
        while m := left[size]:
            fits = open_gaps >> size
            if not fits:
                each = window // size
                n = -(-m // each)
                keep(window, windows, n)
                windows += n
                continue
            gap = size + (fits & -fits).bit_length() - 1
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
            each = gap // size
            if m < each:
                each = m
            full = min(n, m // each)
            place(size, first, full, each, window - gap)
            keep(gap - each * size, first, full)
            keep(gap, first + full, n - full)
    return steps


def _pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """Pieces with the task that made them and their rank there among the pieces of their length."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["piece", "start", "length", "ids_crc32", "doc_tokens", "task", "turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, task = tokens.coder(tokenizer_path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for part in slices(b, BATCH_CHARS):
                of, out = [], []
                for i, x in enumerate(coder.encode(part.column(1).to_pylist())):
                    ids = np.append(x, np.uint32(END)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), window)):
                        own = ids[start : start + window]
                        of.append(i)
                        out.append((piece, start, len(own), zlib.crc32(own.tobytes()), len(ids), task, int(seen[len(own)])))
                        seen[len(own)] += 1
                columns = [part.column(0).take(pa.array(of)), *(pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out)))]
                yield pa.record_batch(columns, names=["id", *names])

    return rows.mapInArrow(run, f"id {kind}, piece int, " + ", ".join(f"{n} long" for n in names[1:]))


def pack_whole(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stage(_pieces(docs, tokenizer_path, id_col, text_col, window), "bestfit-pieces")
    cells = stage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "bestfit-cells")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    steps = np.array(sorted(plan({r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)), np.int64).reshape(-1, len(STEP))
    ranked = pieces.join(small_or_plain(before), ["task", "length"]).withColumn("rank", F.col("turn") + F.col("before")).drop("task", "turn", "before")
    out = ranked.drop("rank").columns
    most = int(steps[:, 2].sum()) + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, each, first, used = steps.T
        at = length * most + rank
        for b in batches:
            size, turn = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(at, size * most + turn, side="right") - 1
            nth = turn - rank[k]
            columns = [b.column(b.schema.get_field_index(c)) for c in out]
            yield pa.record_batch([*columns, pa.array(first[k] + nth // each[k]), pa.array(used[k] + nth % each[k] * size)], names=[*out, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(out).schema)
    placed_rows = ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")
    return placed_rows.select("id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
