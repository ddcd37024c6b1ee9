"""Bounded labelled samples, held-out folds and a small logistic calibrator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Rows per class and UTF-8 bytes per class that a classifier may be fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20
FOLDS, HELD_OUT = 4, 2


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    """True if crc32 of the id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(fold(id_col) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Texts of each class, in an order fixed by a hash of their ids, and the class's labelled ids in all.

    At most ``rows`` labelled ids a class, of those whole texts of ``size`` bytes in all: in
    that order, a text that does not fit any more is passed over and later ones are taken. Held-out ids, null labels and labels other than 0 and 1 are left out; an id
    labelled more than once counts if its labels agree.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)").filter(~held_out("id") & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("id", "y", F.xxhash64("id").alias("at"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = known.filter("y = 0").orderBy("at", "id").limit(rows).unionByName(known.filter("y = 1").orderBy("at", "id").limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = stage(texts.join(F.broadcast(picked), "id").groupBy("id", "y", "at").agg(F.min("text").alias("text")), "labelled-texts")  # at most 2 * rows rows
    used, fits = {0: 0, 1: 0}, []
    for r in sorted(found.select("at", "id", "y", F.octet_length("text").alias("n")).collect()):
        if used[r["y"]] + r["n"] <= size:
            used[r["y"]] += r["n"]
            fits.append((r["id"],))
    taken = docs.sparkSession.createDataFrame(fits, found.select("id").schema)
    bounded = found.join(F.broadcast(taken), "id").select("y", "at", "id", "text").collect()
    out: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(bounded, key=lambda r: (r["at"], r["id"])):
        out[r["y"]].append(r["text"])
    return out, counts


def to_whole(model: tuple[np.ndarray, np.ndarray, np.ndarray], drawn: dict[int, int], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A logistic fitted on ``drawn`` texts a class, with its intercept moved to the class shares of ``counts``."""
    w, mean, scale = model
    w = w.copy()
    w[-1] += np.log(max(counts.get(1, 0), 1) / max(drawn[1], 1)) - np.log(max(counts.get(0, 0), 1) / max(drawn[0], 1))
    return w, mean, scale


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept last, mean, scale) by Newton steps, halved until the penalised likelihood grows; the ridge is stronger on few rows."""
    ridge += 1.0 / len(x)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + ridge * len(x) * (w @ w) / 2
    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + (ridge * len(x) + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if then > now or np.abs(step).max() < 1e-9:
            break
        w, now = w + step, then
    return w, mean, scale


def logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, mean, scale = model
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    return 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
