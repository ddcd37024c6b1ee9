"""Scorer and weigher protocols with offline stand-ins, and classification metrics.

The stand-ins take the place of language models and say nothing about their quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..sources.schema import PublicSchema
from .encode import OneHotSpec, onehot


class Scorer(Protocol):
    def __call__(self, queries: DataFrame, demos: DataFrame, query_key: str) -> DataFrame:
        """(query key, prediction) with predictions 0 or 1."""


class Weigher(Protocol):
    def __call__(self, prototypes: DataFrame, schema: PublicSchema) -> dict[str, float]:
        """A non-negative weight per feature with mean 1."""


def nearest_demo_scorer(spec: OneHotSpec) -> Scorer:
    """The label of the nearest demonstration in the weighted space; ties between labels give 0."""

    def run(queries: DataFrame, demos: DataFrame, query_key: str) -> DataFrame:
        q = queries.select(query_key, onehot(spec).alias("q"))
        d = demos.select(query_key, onehot(spec).alias("x"), "target")
        gap = F.aggregate(F.zip_with("q", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        near = q.join(d, query_key).withColumn("gap", gap)
        return near.groupBy(query_key).agg(F.min(F.struct("gap", "target"))["target"].cast("int").alias("prediction"))

    return run


class Tokenizer(Protocol):
    def encode(self, text: str, add_special_tokens: bool = True):
        """Something with ``ids`` and, for each of them, ``offsets`` (begin, end) into the text."""


def left_cut(text: str, tokenizer: Tokenizer, max_tokens: int) -> tuple[str, int]:
    """(the longest end of ``text`` that starts with a token and has at most ``max_tokens``, its number of tokens)."""
    offsets = tokenizer.encode(text, add_special_tokens=False).offsets
    if len(offsets) <= max_tokens:
        return text, len(offsets)
    for begin, _ in offsets[len(offsets) - max_tokens :]:  # the end alone may be cut into tokens in another way: then it starts later
        rest = text[begin:]
        n = len(tokenizer.encode(rest, add_special_tokens=False).ids)
        if n <= max_tokens:
            return rest, n
    return "", 0


def by_length(lengths: Sequence[int], batch_tokens: int) -> Iterator[list[int]]:
    """Places in groups of like length, the longest first: padded to its longest, a group has at most ``batch_tokens`` tokens, or one text."""
    group: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if group and (len(group) + 1) * lengths[group[0]] > batch_tokens:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def text_scorer(
    load: Callable[[], Callable[[Sequence[str]], Sequence[tuple[float, float]]]], positive_wins_ties: bool = False, tokenizer: Callable[[], Tokenizer] | None = None, max_tokens: int = 4000, batch_tokens: int = 1 << 16,
) -> Callable[[DataFrame, str, str], DataFrame]:
    """A scorer over prompt texts: ``load`` runs once per task and gives a function from texts to
    (score of label 0, score of label 1) each; the prediction is 1 only if its score is greater. A null text is an empty one.

    With a ``tokenizer`` (made once per task, too), texts are cut from the left to ``max_tokens`` tokens and
    scored in batches of like length, each of at most ``batch_tokens`` with its padding.
    """

    def run(prompts: DataFrame, query_key: str, text_col: str = "prompt") -> DataFrame:
        kind = dict(prompts.dtypes)[query_key]

        def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, coder = load(), None if tokenizer is None else tokenizer()
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                groups: Iterator[list[int]] = iter([list(range(len(texts)))])
                if coder is not None:
                    texts, lengths = zip(*(left_cut(t, coder, max_tokens) for t in texts)) if texts else ((), ())
                    groups = by_length(lengths, batch_tokens)
                label = [0] * len(texts)
                for group in groups:
                    for i, (zero, one) in zip(group, score([texts[i] for i in group])):
                        label[i] = int(one > zero or (positive_wins_ties and one == zero))
                yield pa.record_batch([b.column(0), pa.array(label, pa.int32())], names=[query_key, "prediction"])

        return prompts.select(query_key, text_col).mapInArrow(batch, f"{query_key} {kind}, prediction int")

    return run


#: Spellings of the labels whose scores count, by serialisation mode (fixed values).
LABELS = {"json": (("0", " 0"), ("1", " 1")), "sentence": (("No", " No", "no", " no"), ("Yes", " Yes", "yes", " yes"))}


def max_label_scores(variants: Sequence[Mapping[str, float]], labels: Sequence[Sequence[str]] = LABELS["json"]) -> list[tuple[float, float]]:
    """(score of 0, score of 1) per text: for each label the greatest score among its spellings, minus infinity without any."""
    return [tuple(max((v[w] for w in names if w in v), default=float("-inf")) for names in labels) for v in variants]


#: What a language model is told before it weighs features (fixed wording).
WEIGHT_SYSTEM = """You are a clinical data scientist evaluating feature importance for tabular classification.
Calculate the mean shift (delta) between label=0 and label=1 for each feature, and combine it with clinical domain relevance.
Assign continuous weights between 0.05 (irrelevant) and 1.00 (critical predictor).
Avoid assigning default flat weights (like 0.5) to multiple features unless they have identical effect sizes."""


class ReplyError(ValueError):
    """A model's reply holds no object with weights."""


def text_weigher(ask: Callable[[str, str], str], system: str = WEIGHT_SYSTEM, tokenizer: Callable[[], Tokenizer] | None = None, max_tokens: int = 3000) -> Weigher:
    """A weigher that asks a language model once, over the class summaries, and reads its reply leniently.

    With a ``tokenizer`` the question's end is cut so that it has at most ``max_tokens`` tokens together with ``system``.
    A reply without an object is an error.
    """

    def run(prototypes: DataFrame, schema: PublicSchema) -> dict[str, float]:
        from .prompt import extract_object, normalize_weights, parse_weights, summary_line, weighting_prompt

        lines = [r[0] for r in prototypes.orderBy("target").select(summary_line(schema)).collect()]  # two rows
        question = weighting_prompt(schema, lines)
        if tokenizer is not None:
            coder = tokenizer()
            room = max(0, max_tokens - len(coder.encode(system, add_special_tokens=False).ids))
            offsets = coder.encode(question, add_special_tokens=False).offsets
            question = question if len(offsets) <= room else question[: offsets[room][0]]
        reply = prototypes.sparkSession.createDataFrame([(ask(system, question),)], "reply string")
        weights = normalize_weights(parse_weights(F.col("reply"), schema.features), schema.features)
        found = reply.select(extract_object(F.col("reply")).isNotNull().alias("object"), weights.alias("w")).first()
        if not found["object"]:
            raise ReplyError("the reply holds no JSON object")
        return dict(found["w"])

    return run


def class_gap_weigher(prototypes: DataFrame, schema: PublicSchema) -> dict[str, float]:
    """|difference| of the two class summaries, 0/1 for categories, over the mean."""
    rows = {r["target"]: r for r in prototypes.collect()}  # two rows
    if len(rows) < 2:
        return dict.fromkeys(schema.features, 1.0)
    a, b = rows[0], rows[1]
    raw = {c: abs(a[c] - b[c]) if c in schema.numeric else float(a[c] != b[c]) for c in schema.features}
    return normalize(raw)


def normalize(raw: Mapping[str, float], shrinkage: float = 0.0) -> dict[str, float]:
    """Weights over their mean (all 1 if it is not positive), optionally drawn towards 1."""
    mean = sum(raw.values()) / len(raw) if raw else 0.0
    out = {k: v / mean if mean > 0 else 1.0 for k, v in raw.items()}
    return {k: (1 - shrinkage) * v + shrinkage for k, v in out.items()}


def confusion(truth: Column, predicted: Column) -> list[Column]:
    n = lambda t, p: F.count(F.when((truth == t) & (predicted == p), 1)).alias
    return [n(1, 1)("tp"), n(0, 1)("fp"), n(1, 0)("fn"), n(0, 0)("tn")]


def metrics(df: DataFrame, truth: str = "target", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1, precision and recall of class 1; 0 wherever a denominator is 0."""
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = df.groupBy(*by).agg(*confusion(col(truth), col(predicted)))
    return m.select(
        *by, "tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
    )
