"""Periodic runs of words: stretches that repeat one short sequence of words over and over.

A run of period q is a stretch of at least ``max(min_words, times * q)`` words in which
words q apart are identical, q is the smallest such number, and no neighbouring word can be added.
Its words match their q-th successors without a break, so a lag q can have runs only if
the whole text has ``max(min_words - q, (times - 1) * q)`` matching pairs at that lag. All lags of a text are
counted exactly, in two ways that add up: for words that are frequent in
it, the autocorrelation of their places by FFT (two words to a transform, one inverse transform a text); for the
rare ones, the differences of their places, for all texts of a batch at once. Only lags with enough
matches are scanned for islands of consecutive matches.

The matches that a run of period p makes at the multiples of p are known from its length; they are taken off
those lags' counts, so a text of one word repeated a million times is scanned once. Islands are looked for
at every ``need``-th place first, since an island of ``need`` matches cannot avoid them.

Rows are independent: one narrow pass, no shuffle, and a lost task repeats alone.

Edge cases. Null, empty and blank texts have no words and no runs; their collapsed text is empty.
Ids may be null or repeat, and keep their type. Very long texts are read whole. Columns other than the two
named are not touched. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices

MIN_WORDS, TIMES = 6, 4
#: Texts held at a time, in bytes, and pairs of places counted at a time.
BATCH_BYTES, BATCH_PAIRS = 1 << 22, 1 << 21
#: Places looked at on either side before a whole lag is scanned.
REACH = 8

RUNS = "array<struct<start:long,length:long,period:long>>"


def _fast(n: int) -> int:
    """The least size of a fast transform that holds ``n``."""
    return min(m << max(0, (-(-n // m) - 1).bit_length()) for m in (1, 3, 5, 9))


def _heavy(codes: np.ndarray, heavy: np.ndarray, lags: int) -> np.ndarray:
    """Matches of the words ``heavy`` at lags 0 to ``lags``, by FFT."""
    size = _fast(len(codes) + lags)
    power = np.zeros(size)
    for i in range(0, len(heavy), 2):
        z = np.zeros(size, np.complex128)
        z.real[: len(codes)] = codes == heavy[i]
        if i + 1 < len(heavy):
            z.imag[: len(codes)] = codes == heavy[i + 1]
        z = np.fft.fft(z)
        power += z.real**2 + z.imag**2
    return np.rint(np.fft.ifft(power).real[: lags + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, sizes: np.ndarray, times: int = TIMES) -> list[np.ndarray]:
    """For each text of ``sizes`` words, ``codes`` one behind the other: matching pairs at the lags 0 to size // times (none at 0)."""
    lags = sizes // times
    first, base = np.cumsum(sizes) - sizes, np.cumsum(lags + 1) - (lags + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    limit = np.maximum(64, np.sqrt(sizes * np.log2(sizes + 2)) / 2)
    counts = np.zeros(int((lags + 1).sum()), np.int64)
    order = np.argsort(doc * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    same = (doc[order][1:] == doc[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    edge = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(codes)]))
    often = np.diff(edge)
    of = doc[order[edge[:-1]]] if len(codes) else doc
    frequent = often > limit[of] if len(codes) else np.zeros(0, bool)
    for d in np.unique(of[frequent]):
        words = codes[order[edge[:-1][frequent & (of == d)]]]
        found = _heavy(codes[first[d] : first[d] + sizes[d]], words, int(lags[d]))
        found[0] = 0
        counts[base[d] : base[d] + lags[d] + 1] += found
    live = np.flatnonzero(~np.repeat(frequent, often)) if len(codes) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(often)), often)
    held, n, step = [], 0, 1
    while len(live):
        live = live[live + step < len(order)]
        live = live[group[live] == group[live + step]]
        gap = order[live + step] - order[live]
        near = gap <= lags[doc[order[live]]]
        live, gap = live[near], gap[near]
        held.append(base[doc[order[live]]] + gap)
        n += len(live)
        if n > BATCH_PAIRS or not len(live):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n = [], 0
        step += 1
    return np.split(counts, base[1:]) if len(sizes) else []


def _islands(codes: np.ndarray, q: int, need: int) -> list[tuple[int, int]]:
    """(start, end) of the unbroken stretches of at least ``need`` matches at lag ``q``."""
    m = len(codes) - q
    at = np.arange(need - 1, m, need)
    at = at[codes[at] == codes[at + q]]
    right, left = at, at
    for t in range(1, min(REACH, (need - 1) // 2) + 1):
        right, left = right[right + t < m], left[left >= t]
        right, left = right[codes[right + t] == codes[right + t + q]], left[codes[left - t] == codes[left - t + q]]
        if not len(right) and not len(left):
            return []
    if not len(at):
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], codes[q:] == codes[:-q], [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    long = end - start >= need
    return list(zip(start[long].tolist(), end[long].tolist()))


def text_runs(codes: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs by start and period; ``counts`` are its matches by lag and are used up."""
    lag = np.arange(len(counts))
    need = np.maximum(min_words - lag, (times - 1) * lag)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(counts >= need).tolist():
        if not q or counts[q] < need[q]:
            continue
        for start, end in _islands(codes, q, int(need[q])):
            length = end - start + q
            if (start, length) not in found:  # else a divisor of q is its period
                found[start, length] = q
                known = lag[2 * q : length : q]
                counts[known] -= length - known
    return sorted((start, length, q) for (start, length), q in found.items())


def batch_runs(texts: list[bytes], min_words: int = MIN_WORDS, times: int = TIMES) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, collapsed text) of each text, given in UTF-8."""
    words = [t.split() for t in texts]  # bytes.split() cuts at [\x20\x09-\x0D]
    code = dict(zip(dict.fromkeys(chain.from_iterable(words)), count()))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    for ws, end, counts in zip(words, ends.tolist(), lag_counts(codes, sizes, times)):
        runs = text_runs(codes[end - len(ws) : end], counts, min_words, times)
        if runs:
            deep = np.zeros(len(ws) + 1, np.int64)
            for start, length, q in runs:
                deep[start + q] += 1
                deep[start + length] -= 1
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(deep[:-1]) == 0).tolist()]
        yield runs, b" ".join(ws)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """One row per document: id, runs (start, length and period in words, by start and period), and the collapsed text.

    The collapsed text has the words that lie in no run after its first period, joined by one space.
    ``times`` is the least number of periods of a run, 2 or more.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, BATCH_BYTES):
                found, texts = zip(*batch_runs(part.column(1).to_pylist(), min_words, times))
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], struct)
                yield pa.record_batch([part.column(0), runs, pa.array(texts, pa.binary())], names=["id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"id {kind}, runs {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: str = "runs") -> str:
    """SQL for the run of greatest exact length / period in ``runs``; of equal ones the first, null if there is none."""
    return f"aggregate({runs}, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, r) -> CASE WHEN a IS NULL OR r.length * a.period > a.length * r.period THEN r ELSE a END)"
