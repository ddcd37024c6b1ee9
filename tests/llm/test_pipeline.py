"""The pipeline's run() over a small corpus: each stage against a count of its own, near-dedup around 0.8."""

import re

import numpy as np
from test_near_dedup import around, brute
from tokenizers import Tokenizer

import corpus_pipeline
from veilspark.llm import mixing, quality
from veilspark.llm.queries import tokenizer_path


def test_run_is_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = dict(around())
    n = len(texts)
    texts |= {1000 + i: texts[i].replace(" ", " \n", 1 + i % 3) for i in range(0, n, 7)}
    texts |= {2000 + i: " ".join("".join(rng.choice(list("#$%&@!"), 6)) for _ in range(40)) for i in range(120)}
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i in texts if i % 2], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.report(docs, labels).collect()}
    good = {i for i, s in score.items() if s >= quality.THRESHOLD}
    assert len(good) > n // 2 and sum(i >= 2000 for i in good) < 12
    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    stay = brute([(i, texts[i]) for i in first.values()])
    assert 20 < len(stay) < len(first) < len(good)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_report(docs.filter(docs.doc_id.isin(list(stay)))).collect() if r.taken}
    tok = Tokenizer.from_file(tokenizer_path())
    want = {i: c * (len(tok.encode(texts[i], add_special_tokens=False).ids) + 1) for i, c in taken.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == want


#: Names that the stages use inside.
INNER = ("keep", "_keep", "__keep", "__at", "id", "row", "source_key", "u", "size", "class", "key", "norm", "fp", "node", "root", "score", "text_sha256", "bucket", "part", "parts", "n", "nth", "y", "plain", "raw", "cell", "least", "target", "taken")


def edge_docs(spark, rows):
    names = ", ".join(f"`{c}` string" for c in INNER)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(INNER)) for i, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def test_stages_take_edge_rows_and_clashing_columns(spark, tmp_path):
    good = [f"a plain and quiet sentence number {i} about the river and the town" for i in range(30)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(good)] + [(100, None, None), (101, "", "a"), (102, " \n", None), (None, good[0], "a"), (None, None, None), (103, good[1], "b"), (103, good[1], "b"), (104, "word " * 30_000, None), (105, "ünï 𝄞", "c")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(200 + i, 0, 0) for i in range(30)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bad = [(200 + i, "".join(np.random.default_rng(i).choice(list("#$%&@! "), 300)), "b") for i in range(30)]
    docs = edge_docs(spark, rows + bad)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] > 0 and seen[4] > 0
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
        docs = out if name != "packing" else docs
