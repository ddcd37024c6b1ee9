"""The labelled sample under its byte bound."""

from pyspark.sql import functions as F

import numpy as np
import pytest

from veilspark.llm import labelled, quality, toxicity


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(5)
    for scale in (1.0, 40.0):
        x = rng.normal(size=(300, 3)) * [scale, 1.0, 0.01]
        y = (x[:, 0] / scale + rng.normal(size=300) * 0.1 > 0.3).astype(float)
        w, mean, sd = labelled.fit_logistic(x, y)
        z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
        slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + (1e-3 + 1 / len(x)) * len(x) * w
        assert np.abs(slope).max() < 1e-4


def brute_scores(op, texts, labels, label):
    """The query's scores computed in one process: sample, fit and score without Spark."""
    import zlib

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    order = [r.id for r in spark.range(len(texts)).orderBy(F.xxhash64("id"), "id").collect()]
    seen = [i for i in order if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    group = {c: [texts[i] for i in seen if labels[i] == c] for c in (0, 1)}
    model = op.fit_texts(group, {c: len(g) for c, g in group.items()})
    if op is quality:
        return quality.scores(texts, model, model.compressors())
    return toxicity.scores(texts, model, toxicity.Scorer(model.crfs))


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_query_equals_one_process(spark, op, label):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(80)]
    texts = [" ".join(rng.choice(vocab, 30)) + (" damnfool" if i % 5 == 0 and label == "toxic" else "") + (" @#$%&" * 20 if i % 5 and label == "quality" and i % 3 == 0 else "") + "." for i in range(160)]
    texts[7], texts[9] = "", "x" * 50_000
    known = {i: int(i % 5 == 0 if label == "toxic" else not (i % 5 and i % 3 == 0)) for i in range(160) if i % 7}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, y in known.items()], f"doc_id long, {label} int")
    got = op.report(docs, labels).orderBy("doc_id").toPandas()
    assert np.allclose(got.score, brute_scores(op, texts, known, label), atol=1e-9)
    assert (got.predicted == (got.score >= op.THRESHOLD)).all()
    twice = op.report(docs.union(docs), labels).toPandas()
    assert (twice.groupby("doc_id").score.nunique() == 1).all() and len(twice) == 320


def test_accepted_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(i, ("good words stand here " if i % 2 else "@@ ## $$ ") * 9, "x") for i in range(120)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == list(range(1, 120, 2))
    assert quality.accepted(docs.limit(0), labels.limit(0)).count() == 0


def test_a_long_text_shuts_out_no_other(spark):
    ids = spark.range(60).filter(~labelled.held_out("id")).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    rows = [(i, "x" * (5000 if i in (ids[0], ids[7]) else 10)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    texts, counts = labelled.sample(docs, lab, "quality", size=1000)
    assert texts == {0: [], 1: ["x" * 10] * (len(ids) - 2)} and counts == {1: len(ids)}
    texts, _ = labelled.sample(docs, lab, "quality", size=5050)
    assert sorted(map(len, texts[1])) == [10] * 5 + [5000]
