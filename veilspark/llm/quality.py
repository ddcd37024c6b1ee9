"""Quality by compression: two zstandard dictionaries and a calibrated size difference.

One dictionary is built from good and one from bad labelled text: pieces taken evenly from
all texts of the class, up to a fixed size. A text is
compressed with each; the difference of the two sizes, normalised by the text's
length and by the sizes themselves, tells which class it is closer to. A logistic
calibrator, fitted on labelled texts that the dictionaries have not seen, turns
the normalised differences and the better of the two rates into a score. The length is
no input of the calibrator. Texts are compressed whole.

The fit uses a bounded sample (``labelled.SAMPLE_ROWS``, ``SAMPLE_BYTES`` a class) and
never the held-out fold; scoring is one pass over the documents without a shuffle.

Edge cases. Null text counts as empty; the empty text gets the share of good
labels among very short texts that the calibrator gives it. Without labels of both
classes every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

THRESHOLD = 0.7
DICT_BYTES, LEVEL, CHUNK = 1 << 20, 9, 512


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibration: tuple | None
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor] | None:
        """(good, bad), or None if there was too little to learn from."""
        if self.calibration is None and not self.good:
            return None
        out = []
        for d in (self.good, self.bad):
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(d), write_content_size=0, write_checksum=0, write_dict_id=0)
            held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        return out


def dictionary(texts: list[bytes]) -> bytes:
    """``DICT_BYTES`` of the texts at most: pieces of ``CHUNK`` bytes, evenly spread over all of them."""
    pieces = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    total = sum(len(p) + 1 for p in pieces)
    step = max(1.0, total / DICT_BYTES)
    taken = [pieces[int(i * step)] for i in range(int(len(pieces) / step))] or pieces[:1]
    return b"\n".join(taken)[:DICT_BYTES].ljust(8, b"\n")


def features(texts: list[str], compressors: list) -> np.ndarray:
    """The difference of the two compressed sizes, by the text's length and by the sizes, and the better rate."""
    good, bad = compressors
    x = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        b = t.encode()
        g, w = len(good.compress(b)), len(bad.compress(b))
        x[i] = (w - g) / (len(b) + 16), (w - g) / (w + g), min(g, w) / (len(b) + 16)
    return x


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit_texts(*labelled.sample(docs, labels, "quality", id_col, text_col))


def fit_texts(texts: dict[int, list[str]], counts: dict[int, int]) -> Model:
    """Dictionaries from every second text of a class, the calibrator from the others."""
    n_bad, n_good = counts.get(0, 0), counts.get(1, 0)
    prior = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
    share = {y: (t[0::2], t[1::2]) for y, t in texts.items()}
    raw = {y: [t.encode() for t in share[y][0]] for y in (0, 1)}
    if not (raw[0] and raw[1] and share[0][1] and share[1][1]):
        return Model(b"", b"", None, prior)
    model = Model(dictionary(raw[1]), dictionary(raw[0]), None, prior)
    x = features(share[0][1] + share[1][1], model.compressors())
    y = np.repeat([0.0, 1.0], [len(share[0][1]), len(share[1][1])])
    model.calibration = labelled.to_whole(labelled.fit_logistic(expand(x), y), {c: len(share[c][1]) for c in (0, 1)}, counts)
    return model


def expand(x: np.ndarray) -> np.ndarray:
    """Calibrator inputs: the normalised differences and the better rate, with squares and products. No length is among them."""
    return np.column_stack([x, x * x, x[:, :1] * x[:, 1:2], x[:, :2] * x[:, 2:]])


def scores(texts: list[str], model: Model, compressors: list | None) -> np.ndarray:
    if compressors is None:
        return np.full(len(texts), model.prior)
    return labelled.logistic(expand(features(texts, compressors)), model.calibration)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score (and ``keep`` columns), one pass, no shuffle."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(pickle.dumps(model))  # two dictionaries and a few weights
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        compressors = m.compressors()
        for b in batches:
            s = scores(b.column(1).to_pylist(), m, compressors)
            yield pa.record_batch([b.column(0), pa.array(s)], names=["id", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(F.col("id").alias(id_col), labelled.held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns, without a shuffle."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(pickle.dumps(fit(docs, labels, id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        compressors = m.compressors()
        for b in batches:
            good = scores([str(t) if t is not None else "" for t in b.column(at).to_pylist()], m, compressors) >= threshold
            yield b.filter(pa.array(good))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
