"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Vectors are normalised, centred, turned by their principal axes and by a learned
rotation that brings them close to the corners of a cube (iterative quantisation),
and signed: 64 bits. A code is cut into eight substrings, each with an
inverted list of its own. By the pigeonhole principle a code within Hamming radius r of a
query agrees with it up to r // 8 bits in some substring, so probing every list
entry within that many flips retrieves every code of the radius; the codes
are then checked in full, and the survivors are reranked by the exact cosine in double precision.

Codes are indexed in blocks of bounded size, queries come in blocks too; a task holds one
block of each and returns at most k rows per query, so nothing grows with the table but the
number of tasks. The rotation is fitted on at most ``SAMPLE`` vectors; every vector is indexed.

Edge cases. Vectors that are null, empty, zero, of another length than most, or
hold null or non-finite components take no part, as queries or candidates.
If fewer than k codes of a block lie in the radius, it grows by one flip a substring and the
lists are probed again, so short tables give all their candidates. Ties go to the smaller id. Repeated ids
are candidates each; an id is never its own neighbour. Null ids take no part.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

BITS, SUBS, RADIUS, TOP, EVERY = 64, 8, 30, 5, 50
SAMPLE, CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 16_384, 2048


def valid(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices of vectors that take part, their rows as doubles)."""
    keep, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or (dim is not None and len(v) != dim) or any(x is None for x in v):
            continue
        x = np.asarray(v, float)
        if np.isfinite(x).all() and np.isfinite(n := float(x @ x)) and n > 0:
            keep.append(i)
            rows.append(x)
    return np.array(keep, np.int64), np.array(rows) if rows else np.empty((0, dim or 0))


def fit(sample: np.ndarray, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``BITS`` columns) learned from rows of ``sample``."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :BITS]
    rng = np.random.default_rng(seed)
    if axes.shape[1] < BITS:  # short vectors: random directions fill the code
        axes = np.hstack([axes, rng.normal(size=(x.shape[1], BITS - axes.shape[1]))])
    p = c @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(p.T @ np.where(p @ turn > 0, 1.0, -1.0))
        turn = u @ v
    return mean, axes @ turn


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, projection = model
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.packbits((unit - mean) @ projection > 0, axis=1).view(np.uint64).ravel()


def _probes(flips: int) -> list[np.ndarray]:
    """For each substring value, the values within ``flips`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(min(flips, 8) + 1) for bits in combinations(range(8), n)]
    return [np.array([v ^ m for m in masks]) for v in range(256)]


class Index:
    """Inverted lists of one block of codes."""

    def __init__(self, codes: np.ndarray, radius: int = RADIUS):
        self.codes, self.radius = codes, radius
        parts = codes.view(np.uint8).reshape(-1, SUBS)
        self.lists = []
        for s in range(SUBS):
            order = np.argsort(parts[:, s], kind="stable")
            self.lists.append((order, np.searchsorted(parts[order, s], np.arange(257))))
        self.probes: dict[int, list[np.ndarray]] = {}

    def within(self, code: np.uint64, radius: int | None = None) -> np.ndarray:
        """All positions whose codes lie within the radius of ``code``."""
        radius = self.radius if radius is None else radius
        flips = radius // SUBS
        if flips not in self.probes:
            self.probes[flips] = _probes(flips)
        hit = np.zeros(len(self.codes), bool)
        for s, value in enumerate(np.array([code]).view(np.uint8)):
            order, at = self.lists[s]
            for p in self.probes[flips][value]:
                hit[order[at[p] : at[p + 1]]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def search_block(qid: np.ndarray, qx: np.ndarray, qcode: np.ndarray, cid: np.ndarray, cx: np.ndarray, ccode: np.ndarray, k: int = TOP, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, cosine): at most k of this block for each query."""
    index = Index(ccode, radius)
    norm = np.sqrt(np.einsum("ij,ij->i", cx, cx))
    out: list[tuple] = []
    for i in range(len(qid)):
        reach = radius
        at = index.within(qcode[i])
        while len(at := at[cid[at] != qid[i]]) < k and reach < BITS:
            reach = min(reach + SUBS, BITS)
            at = index.within(qcode[i], reach)
        score = np.array([]) if not len(at) else (cx[at] @ qx[i]) / (norm[at] * np.sqrt(qx[i] @ qx[i]))
        if len(at) > 4 * k:
            edge = np.partition(score, len(score) - k)[-k]
            close = score >= edge - 1e-12
            at, score = at[close], score[close]
        # the final figure by one formula for every pair, so that equal vectors tie exactly
        score = np.array([float(np.dot(qx[i], cx[j])) / (float(np.sqrt(np.dot(qx[i], qx[i]))) * float(np.sqrt(np.dot(cx[j], cx[j])))) for j in at])
        best = np.lexsort((cid[at], -score))[:k]
        out.extend((qid[i], cid[at[b]], score[b]) for b in best)
    a, b, c = zip(*out) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(c, float)


def nearest(vectors: DataFrame, k: int = TOP, every: int = EVERY, radius: int = RADIUS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    seen = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    dims = Counter(len(v) for v in seen if len(v))
    out_schema = "query_id long, vec_id long, score double"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    dim = dims.most_common(1)[0][0]
    _, sample = valid(seen, dim)
    if not len(sample):
        return empty
    model = pickle.dumps(fit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model)
        for b in batches:
            keep, x = valid(b.column(1).to_pylist(), dim)
            codes = encode(x, m) if len(keep) else np.empty(0, np.uint64)
            yield pa.record_batch([b.column(0).take(pa.array(keep)), pa.array(codes.view(np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "code", "x"])

    coded = stage(rows.mapInArrow(run, "id long, code long, x binary"), "ann-codes")
    is_query = F.pmod("id", F.lit(every)) == 0
    total, asked = coded.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    if not total or not asked:
        return empty
    n_blocks, n_query_blocks = -(-total // CANDIDATE_BLOCK), -(-asked // QUERY_BLOCK)
    block = lambda n, seed: F.pmod(F.xxhash64("id", "code", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = coded.select("*", block(n_blocks, 1).alias("cb"), each(n_query_blocks).alias("qb"))
    queries = coded.filter(is_query).select("*", block(n_query_blocks, 2).alias("qb"), each(n_blocks).alias("cb"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), float).reshape(-1, dim)
            return t.column("id").to_numpy(), x, t.column("code").to_numpy().view(np.uint64)

        if not q.num_rows or not c.num_rows:
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            found = search_block(*parts(q), *parts(c), k, radius)
        return pa.table([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(cell, out_schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
