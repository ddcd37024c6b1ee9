"""Exact removal of repeated substrings by elected anchors and an external sort of their hashes.

Every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus is
removed. This is not induced suffix sorting: no suffix is sorted, there are no priority queues and no common-prefix
values. Sorting all suffixes of the corpus in Python workers is out of reach of the time limits (README has figures). Instead:

1. Anchors. Each ``LENGTH``-byte window elects one anchor, the leftmost position of
   least hash among its ``GRAM``-byte strings. Equal windows elect the same offset, so equal
   windows always meet at equal anchors. About one position in 43 is an anchor. An anchor
   stands for the run of windows that elected it and carries a key (its string's hash)
   and a name (the hash of the whole run's bytes).
2. Sort. Anchors are sorted by (key, name, document, start) with Spark's
   disk-backed sort. Every anchor but the first of its name repeats as a whole.
3. Comparison. Only first anchors whose key has several names are undecided; their
   runs' bytes are fetched, and within a key each window is compared with
   the windows before it. A
   key with more than ``HOT`` names (a short line that stands in very many documents, with
   other words around it each time) is split: its windows are dealt by their own hashes.
4. Intervals. Repeated runs and windows become byte intervals of their documents.

Map tasks settle repeats within their own batches before anything is shuffled, so a passage
in a third of all documents costs one row per batch. Within one key, runs and windows are compared
by 64-bit hashes (odds of a mistake: 2**-64 a pair of one key). The windows of hot keys,
which meet all other hot windows, are compared by 128 bits.

Edge cases. Null text counts as empty. Texts under ``LENGTH`` bytes have nothing to
remove. Documents are ordered by id, nulls last; rows of equal id are
ordered by a hash of their text (equal rows: either may come first), each row is a document of its own.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharding import numbered
from .shared import stage, text_or_empty

LENGTH, GRAM = 100, 16
SPAN = LENGTH - GRAM + 1
#: Bytes of text handled at once by a task; longer texts are cut into overlapping pieces.
BATCH = 4 << 20
#: Names a key may have before its windows are dealt one by one instead of together.
HOT = 2048
_POS = 24
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S29, _S32 = np.uint64(29), np.uint64(32)


def _words(buffer: bytes) -> np.ndarray:
    """The 8-byte little-endian word at every position of ``buffer`` (zeros behind its end)."""
    n = len(buffer)
    padded = buffer + bytes(16)
    out = np.empty(n + 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(padded, "<u8", (n + 8) // 8, o)
        out[o : o + 8 * len(part) : 8] = part[: len(out[o : o + 8 * len(part) : 8])]
    return out[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _C[2]
    return x ^ (x >> _S29)


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every position that has them."""
    return _mix(words[:-8] * _C[0] + _mix(words[8:]) * _C[1])


def window_hashes(words: np.ndarray, at: np.ndarray, other: bool = False) -> np.ndarray:
    """Hash of the ``LENGTH`` bytes that start at each of ``at``; ``other``: a second one, with factors of its own."""
    total = np.full(len(at), int(other), np.uint64)
    carry, factor = (_C[1], _C[3]) if other else (_C[3], _C[0])
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        total = _mix(total * carry + words[at + j] * factor)
    return total


def anchors(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor key) of each run of ``starts`` that elect one anchor.

    ``starts``: ascending starts of windows that lie within one document.
    """
    words = _words(buffer)
    h = grams(words)
    low = np.uint64((1 << _POS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = SPAN - width
    least = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    spot = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((new[1:] - 1, [len(starts) - 1]))
    return starts[new], starts[last], spot[new], h[spot[new]]


def pieces(ids: list[int], texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, window starts, id per document part, its shift from buffer to document) in parts of about ``BATCH`` bytes.

    Parts of one document overlap by ``LENGTH - 1`` bytes; every window lies in exactly one part.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        begin = np.concatenate(([0], np.cumsum([len(b) for _, _, b in parts])))
        starts = np.concatenate([np.arange(a, a + len(b) - LENGTH + 1) for a, (_, _, b) in zip(begin, parts)])
        return b"".join(b for _, _, b in parts), starts, begin, np.array([(i, o) for i, o, _ in parts], np.int64)

    for i, t in zip(ids, texts):
        for o in range(0, max(len(t) - LENGTH + 1, 0), BATCH):
            b = t[o : o + BATCH + LENGTH - 1]
            parts.append((i, o, b))
            size += len(b)
            if size >= BATCH:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


_ROW = "kind int, key long, name long, doc long, a long, b long, p long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_ANCHOR, _GONE, _OPEN, _HOT = 0, 1, 2, 3


def _batch(kind, key, name, doc, a, b, p) -> pa.RecordBatch:
    n = len(doc)
    fill = lambda x: x if isinstance(x, np.ndarray) else np.full(n, x, np.int64)
    arrays = [pa.array(fill(kind).astype(np.int32)), *(pa.array(fill(x)) for x in (key, name, doc, a, b, p))]
    return pa.record_batch(arrays, names=_NAMES)


def _first_of_run(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any of ``columns``."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (rid, text) -> anchors and intervals already known to repeat."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
        for buffer, starts, begin, info in pieces(ids, texts):
            first, last, spot, key = anchors(buffer, starts)
            view = memoryview(buffer)
            name = np.array([xxh3_64_intdigest(view[a : b + LENGTH], p - a) for a, b, p in zip(first.tolist(), last.tolist(), spot.tolist())], np.uint64)
            part = np.searchsorted(begin, first, side="right") - 1
            doc, shift = info[part, 0], info[part, 1] - begin[part]
            a = first + shift
            order = np.lexsort((a, doc, name, key))
            fresh = np.empty(len(a), bool)
            fresh[order] = _first_of_run(key[order], name[order])
            b = last + shift
            yield _batch(_ANCHOR, key.view(np.int64)[fresh], name.view(np.int64)[fresh], doc[fresh], a[fresh], b[fresh], (spot + shift)[fresh])
            # settled repeats travel as merged intervals, dealt by document: their keys may be hot
            gone = np.flatnonzero(~fresh)
            if len(gone):
                head = np.flatnonzero(np.concatenate(([True], (part[gone[1:]] != part[gone[:-1]]) | (a[gone[1:]] > b[gone[:-1]] + LENGTH))))
                tail = np.concatenate((head[1:] - 1, [len(gone) - 1]))
                yield _batch(_GONE, _mix(doc[gone[head]].astype(np.uint64)).view(np.int64), 0, doc[gone[head]], a[gone[head]], b[gone[tail]], 0)


def _decide(batches: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by (key, name, doc, a) -> repeated intervals, and anchors that need their bytes.

    Only the first anchors of the last key are held, ``most`` at most: from there on the key
    is known to be hot, and its rows leave as they come.
    """
    last = None  # (key, name) of the row before
    held = [np.empty(0, np.int64)] * 5  # first anchors (key, doc, a, b, p) of the last key, not yet decided
    hot = None  # the last key if it is hot

    def sort_out(rows: list[np.ndarray], ended: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, hot
        rows = [np.concatenate(x) for x in zip(held, rows)]
        key = rows[0]
        if not len(key):
            return
        new = np.flatnonzero(_first_of_run(key))
        n = np.diff(np.append(new, len(key)))
        kind = np.where((n > most) | (key[new] == (key[0] if hot is None else hot)) & (hot is not None), _HOT, np.where(n > 1, _OPEN, -1))
        if kind[-1] == _HOT:
            hot = key[-1]
        keep = 0 if ended or kind[-1] == _HOT else n[-1]
        cut = len(key) - keep
        held = [x[cut:] for x in rows]
        kind = np.repeat(kind, n)[:cut]
        for k in (_OPEN, _HOT):
            key_, doc_, a_, b_, p_ = (x[:cut][kind == k] for x in rows)
            if len(key_):
                yield _batch(k, key_, 0, doc_, a_, b_, p_)

    for batch in batches:
        kind, key, name, doc, a, b, p = (batch.column(i).to_numpy() for i in range(7))
        gone = kind == _GONE
        if gone.any():
            yield _batch(_GONE, 0, 0, doc[gone], a[gone], b[gone] + LENGTH, 0)
        key, name, doc, a, b, p = (x[~gone] for x in (key, name, doc, a, b, p))
        if not len(key):
            continue
        fresh = _first_of_run(key, name)
        fresh[0] = last != (key[0], name[0])
        last = key[-1], name[-1]
        if not fresh.all():
            yield _batch(_GONE, 0, 0, doc[~fresh], a[~fresh], b[~fresh] + LENGTH, 0)
        yield from sort_out([x[fresh] for x in (key, doc, a, b, p)], False)
    yield from sort_out([np.empty(0, np.int64)] * 5, True)


def _spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last) of the runs of touching windows; rows sorted by (doc, start)."""
    head = np.flatnonzero(_first_of_run(doc, start - np.arange(len(start))))
    return doc[head], start[head], start[np.append(head[1:] - 1, len(start) - 1)] if len(head) else start[head]


def _hashed(key: np.ndarray, doc: np.ndarray, a: np.ndarray, p: np.ndarray, runs: list[bytes], wide: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, row, start in its document) of every window of ``runs``, and a second hash if ``wide``; windows meet only at one key and one offset."""
    size = np.array([len(r) for r in runs], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    count = size - LENGTH + 1
    row = np.repeat(np.arange(len(runs)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    words, at = _words(b"".join(runs)), begin[row] + nth
    h = _mix(window_hashes(words, at) + key.view(np.uint64)[row] * _C[1] + (p[row] - a[row] - nth).astype(np.uint64) * _C[3])
    return (h, row, a[row] + nth, *([window_hashes(words, at, True)] if wide else []))


_RUN = "kind int, key long, doc long, a long, p long, run binary"


def _runs(kind: int, key, doc, a, p, run: list | None) -> pa.RecordBatch:
    n = len(key)
    arrays = [pa.array(np.full(n, kind, np.int32)), *(pa.array(x, pa.int64()) for x in (key, doc, a, p)), pa.nulls(n, pa.binary()) if run is None else pa.array(run, pa.binary())]
    return pa.record_batch(arrays, names=[c.split()[0] for c in _RUN.split(", ")])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (rid, text, list of (kind, key, a, b, p)) -> rows of ``_RUN``.

    An open anchor brings its run's bytes and is dealt by its key. The windows of a hot
    key are dealt one by one, by their hashes (key, p), the first of a batch only; the rest of
    the batch is settled and leaves as intervals (a, p) of ``_GONE``.
    """

    def windows(hot: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, doc, a, p = (np.array(x, np.int64) for x in list(zip(*hot))[:4])
        h, row, start, more = _hashed(key, doc, a, p, [x[4] for x in hot], True)
        order = np.lexsort((start, doc[row], more, h))
        fresh = np.empty(len(h), bool)
        fresh[order] = _first_of_run(h[order], more[order])
        yield _runs(_HOT, h[fresh].view(np.int64), doc[row[fresh]], start[fresh], more[fresh].view(np.int64), None)
        old = np.flatnonzero(~fresh)
        old = old[np.lexsort((start[old], doc[row[old]]))]
        d, first, last = _spans(doc[row[old]], start[old])
        yield _runs(_GONE, _mix(d.astype(np.uint64)).view(np.int64), d, first, last + LENGTH, None)

    for batch in batches:
        whole: list[tuple] = []
        hot: list[tuple] = []
        size = 0
        for i, t, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = t.as_py().encode()
            for w in wanted:
                (hot if w["kind"] == _HOT else whole).append((w["key"], i, w["a"], w["p"], data[w["a"] : w["b"] + LENGTH]))
                size += w["b"] + LENGTH - w["a"]
                if size > BATCH:
                    if whole:
                        yield _runs(_OPEN, *zip(*whole))
                    if hot:
                        yield from windows(hot)
                    whole, hot, size = [], [], 0
        if whole:
            yield _runs(_OPEN, *zip(*whole))
        if hot:
            yield from windows(hot)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_RUN`` sorted by (key, p if hot, doc, a) -> intervals of windows that some earlier run has too.

    What is kept between batches: the window hashes of one key (``HOT`` runs at most),
    or the two hashes of one hot window.
    """
    seen_key, seen = None, np.empty(0, np.uint64)
    hot_key = None
    for batch in batches:
        kind, key, doc, a, p = (batch.column(i).to_numpy() for i in range(5))
        gone = kind == _GONE
        if gone.any():
            yield _batch(_GONE, 0, 0, doc[gone], a[gone], p[gone], 0)
        hot = kind == _HOT
        if hot.any():
            k, more, d, at = key[hot], p[hot], doc[hot], a[hot]
            old = ~_first_of_run(k, more)
            old[0] = hot_key == (k[0], more[0])
            hot_key = k[-1], more[-1]
            yield _batch(_GONE, 0, 0, d[old], at[old], at[old] + LENGTH, 0)
        whole = np.flatnonzero(kind == _OPEN)
        if not len(whole):
            continue
        key, doc, a, p = (x[whole] for x in (key, doc, a, p))
        h, row, start = _hashed(key, doc, a, p, batch.column(5).take(pa.array(whole)).to_pylist())
        order = np.argsort(h, kind="stable")
        fresh = np.empty(len(h), bool)
        fresh[order] = _first_of_run(h[order])
        if seen_key == key[0] and len(seen):
            head = key[row] == seen_key
            at = np.minimum(np.searchsorted(seen, h[head]), len(seen) - 1)
            fresh[np.flatnonzero(head)[seen[at] == h[head]]] = False
        now = h[(key[row] == key[-1]) & fresh]
        seen = np.union1d(seen, now) if seen_key == key[-1] else np.sort(now)
        seen_key = key[-1]
        old = np.flatnonzero(~fresh)
        if len(old):
            head = np.flatnonzero(_first_of_run(row[old], start[old] - np.arange(len(old))))
            last = np.append(head[1:] - 1, len(old) - 1)
            yield _batch(_GONE, 0, 0, doc[row[old[head]]], start[old[head]], start[old[last]] + LENGTH, 0)


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = t.encode()
                merged = _merge(spans)
                at, kept = 0, []
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                left = b"".join((*kept, data[at:]))
                rows.append((len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), [{"a": a, "b": b} for a, b in merged]))
            n, removed, spans_, digest, where = zip(*rows) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(where, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))))
                names.append("spans")
            yield pa.record_batch(columns, names=names)

    return run


def repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, a, b): byte intervals to remove from documents (rid, text); they may touch or overlap."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = docs.mapInArrow(_sample, _ROW)
    decided = stage(sampled.repartition(n, "key", "kind").sortWithinPartitions("key", "name", "doc", "a").mapInArrow(lambda batches: _decide(batches, hot), _ROW), "repeats-decided")
    undecided = decided.filter(F.col("kind").isin(_OPEN, _HOT))
    wanted = undecided.groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "a", "b", "p")).alias("wanted"))  # bounded by the document
    runs = docs.join(wanted, docs.rid == wanted.doc).select("rid", "text", "wanted").mapInArrow(_fetch, _RUN)
    compared = runs.repartition(n, "key").sortWithinPartitions("key", F.when(F.col("kind") == _HOT, F.col("p")), "doc", "a").mapInArrow(_compare, _ROW)
    gone = decided.filter(F.col("kind") == _GONE).select("doc", "a", "b").unionByName(compared.select("doc", "a", "b"))
    return gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and the removed ``spans``)."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    if whole and odd.isEmpty():
        numbered_rows = rows.select(F.col("id").cast("long").alias("rid"), "id", "text")
    else:  # order rows of equal and null ids, too
        keyed = rows.select(F.col("id").isNull().alias("last"), "id", F.xxhash64("text").alias("h"), "text")
        numbered_rows = numbered(keyed, ["last", "id", "h"], "rid")[0].select("rid", "id", "text")
    gone = repeated(numbered_rows.select("rid", "text"), hot)
    per_doc = gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("gone"))  # bounded by the document
    joined = numbered_rows.join(per_doc, numbered_rows.rid == per_doc.doc, "left").select("id", "text", "gone")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<a: long, b: long>>" if spans else "")
    return joined.mapInArrow(_remove(spans), schema).withColumnRenamed("id", id_col)
