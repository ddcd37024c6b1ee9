"""Spelling variants: words one edit apart, found by a join of symmetric deletions.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Every word
emits itself and its distinct single deletions as 64-bit keys; near words share one. A
key also says between which places the deleted code point may have stood, and only rows whose places
overlap meet, so every near pair meets under exactly one key. Pairs are then verified on the words
themselves. A key's rows are words with one code point more than one string: at most its length plus one times the
code points in use, so no key is unbounded, and no two words meet but under a shared key.
Keys come from prefix sums: a word of m code points costs m steps, not m * m.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent as it. Forms lead to
ever more frequent words, so they have no cycles, and roots follow by joining roots with roots: the
way is halved each time, and at most log2(log_ratio(n)) joins are needed.

Edge cases. Null words do not count. Lengths are in code points. Of equally frequent near words the
first in code-point order is the form. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Letters of a word: A-Z, a-z and the range from U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ANY = (1 << 31) - 1
#: Words whose keys are made at a time, in code points.
BATCH_CHARS = 1 << 18


def lower_ascii(c: Column) -> Column:
    """``c`` with A-Z lower-cased and all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_runs(text: Column) -> Column:
    """The maximal runs of letters of a text (none of a null), as an array."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(LETTERS), F.lit(0))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's place in ``words``, key, low, high) of each word itself and of its distinct single deletions.

    The deleted code point stood at one of the places low to high - 1; a word itself overlaps with every place.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    end = np.cumsum(size)
    start, of, n = end - size, np.repeat(np.arange(len(words)), size), len(points)
    value = (points + np.uint64(1)) * np.uint64(_MIX)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(_BASE)
    up, down = _powers(_BASE, n + 2), _powers(pow(_BASE, -1, 1 << 64), n + 2)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[:n], dtype=np.uint64)))
    own = (total[end] - total[start]) * down[start]
    i = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = (points[1:] != points[:-1]) | (of[1:] != of[:-1])
    i, w = i[first], of[first]
    cut = (total[i] - total[start[w]]) * down[start[w]] + (total[end[w]] - total[i + 1]) * down[start[w] + 1]
    stop = np.append(i[1:], n)
    every = np.arange(len(words))
    low = np.concatenate((np.full(len(words), -1), i - start[w]))
    high = np.concatenate((np.full(len(words), _ANY), stop - start[w]))
    return np.concatenate((every, w)), np.concatenate((own, cut)).view(np.int64), low, high


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (wid, word) -> (key, wid, low, high)."""
    for b in batches:
        words, ids = b.column(1).to_pylist(), b.column(0).to_numpy()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, side="right")))
            of, key, low, high = deletion_keys(words[at:to])
            columns = [pa.array(key), pa.array(ids[at:to][of]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            yield pa.record_batch(columns, names=["key", "wid", "low", "high"])
            at = to


def near_words(words: DataFrame) -> DataFrame:
    """(wid, other): both directions of every pair of ``words`` (wid, word, n) that shares a key at overlapping places."""
    keys = stage(words.select("wid", "word").mapInArrow(_keys, "key long, wid long, low int, high int"), "variant-keys")
    other = keys.select("key", F.col("wid").alias("wid2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = keys.join(other, "key").filter("wid < wid2 AND low < high2 AND low2 < high")
    both = F.array(F.struct("wid", F.col("wid2").alias("other")), F.struct(F.col("wid2").alias("wid"), F.col("wid").alias("other")))
    return pairs.select(F.inline(both))


def group_variants(words: DataFrame, word_col: str = "word", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per frequent word of ``words`` (a row per occurrence): word, form, root, n, n_near, form_n."""
    if min_length < 2 or ratio < 2:
        raise ValueError("words have at least two code points, and forms are at least twice as frequent")
    seen = words.select(F.col(word_col).cast("string").alias("word")).filter(F.length("word") >= min_length)
    counted = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    known = stage(counted.withColumn("wid", F.monotonically_increasing_id()), "variant-words")
    names = known.select(F.col("wid").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = known.join(near_words(known).join(names, "other"), "wid", "left")
    near = F.when(F.levenshtein("word", "near", 1) == 1, F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("name")))
    best = met.groupBy("wid", "word", "n").agg(F.count(near).alias("n_near"), F.min(near).alias("best"))
    formed = F.col("best.less") <= -ratio * F.col("n")
    rows = best.select("word", F.when(formed, F.col("best.name")).alias("form"), "n", "n_near", F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = stage(rows, "variant-forms")
    return rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form on each word's way, for ``forms`` (word, form) without cycles."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
