"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training. Documents are labelled, tokens are not, so token labels are projected
first: a word, or a word's leading letters, is marked as toxic if the documents it occurs
in lean to the toxic side beyond what chance explains among all words tried; words that
begin with a marked stem are marked too. The CRF then learns from sentences of labelled tokens
with two states, by gradient ascent on the penalised likelihood. Its inputs are
the word, its leading letters, its neighbours, its length class and its letter case.

Scoring. Texts are read whole, sentence by sentence. Forward-backward gives every
token its probability of being toxic; the document's evidence is made of the odds against
all its tokens being clean, the highest marginal, and the weight of its likely
toxic tokens. Two CRFs are trained, each on one half of the labelled documents, and each gets a logistic
calibrator fitted on its evidence about the other half; a document's score is the mean of
the two calibrated probabilities. ``spans`` returns the offending character offsets by the mean of the marginals.

The fit uses a bounded sample (``SAMPLE_ROWS`` documents and ``SAMPLE_BYTES`` a class, of its
sentences without a toxic word an even ``QUIET`` at most) and never
the held-out fold; it is the same at every size. Scoring is one pass without a shuffle.

Edge cases. Null text counts as empty; an empty text has no evidence and gets the
calibrator's score for none. Without labels of both classes every score is the
share of label 1 (0.5 if there are none). Ties do not arise: all documents are scored alike.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

THRESHOLD = 0.3
#: Documents and UTF-8 bytes of each class that the CRFs are trained and calibrated on.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 6 << 20
STEM = (4, 5, 6)
#: Least share of toxic documents among those with a marked word or stem.
MOSTLY = 0.6
#: Longest CRF sequence; a longer run without a sentence end is cut at a word, no token is left out.
LONGEST = 128
#: Sentences without a toxic word that a class may give to the CRF's training, spread evenly over its texts.
QUIET = 12_000
CACHE_ENTRIES = 500_000
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?\n]")
_ENDS = frozenset(".!?\n")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence."""
    out, now = [], []
    for t in _TOKEN.findall(text):
        if t in _ENDS:
            if now:
                out.append(now)
                now = []
        else:
            now.append(t)
            if len(now) == LONGEST:
                out.append(now)
                now = []
    if now:
        out.append(now)
    return out


def word_features(word: str) -> list[str]:
    low = word.lower()
    shape = "A" if word.isupper() else "a"
    return ["w=" + low, *("p=" + low[:n] for n in STEM if len(low) > n), "n=" + str(min(len(low), 12)), "c=" + shape]


def neighbour_features(word: str) -> list[str]:
    low = word.lower()
    return ["w=" + low]


@dataclass
class Crf:
    """Feature weights towards the toxic state, transitions, and the calibrator of its evidence."""

    own: dict[str, float] = field(default_factory=dict)
    left: dict[str, float] = field(default_factory=dict)
    right: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple | None = None


@dataclass
class Model:
    """CRFs whose calibrated scores are averaged; without any, every score is ``prior``."""

    crfs: list[Crf] = field(default_factory=list)
    prior: float = 0.5


class Scorer:
    """CRFs with a word cache: a word's own, left and right contributions to each are computed once."""

    def __init__(self, crfs: list[Crf]):
        self.crfs = crfs
        self.codes: dict[str, int] = {}
        self.values: list[list[float]] = []
        # feature -> (place among a word's values, weight), so that a word is looked up once for all CRFs
        self.own: dict[str, list[tuple[int, float]]] = {}
        self.near: dict[str, list[tuple[int, float]]] = {}
        for i, m in enumerate(crfs):
            for table, part, place in ((self.own, m.own, 0), (self.near, m.left, 1), (self.near, m.right, 2)):
                for f, w in part.items():
                    table.setdefault(f, []).append((3 * i + place, w))
        self.bias = [x for m in crfs for x in (m.bias, 0.0, 0.0)]

    def _code(self, word: str) -> int:
        values = self.bias.copy()
        for table, names in ((self.own, word_features(word)), (self.near, neighbour_features(word))):
            for f in names:
                for place, w in table.get(f, ()):
                    values[place] += w
        c = self.codes[word] = len(self.values)
        self.values.append(values)
        return c

    def marginals(self, rows: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per CRF (token marginals of the toxic state, log probability that all tokens are clean), rows end to end."""
        lengths = np.array([len(r) for r in rows])
        if len(self.codes) > CACHE_ENTRIES:
            self.codes, self.values = {}, []
        get, make = self.codes.get, self._code
        codes = np.array([make(w) if (c := get(w)) is None else c for r in rows for w in r], np.int64)
        values = np.array(self.values).T
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inner = np.ones(len(codes), bool)
        inner[start] = False
        at = np.flatnonzero(inner)
        before, after = codes[at - 1], codes[at]
        out = []
        for i, m in enumerate(self.crfs):
            own, left, right = values[3 * i : 3 * i + 3]
            e = own[codes]
            e[at] += left[before]
            e[at - 1] += right[after]
            out.append(forward_backward(e, start, lengths, m.trans))
        return out


def forward_backward(e: np.ndarray, start: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """All sequences at once, one vector step per position.

    ``e``: log potential of state 1 against state 0 for each token. A two-state chain needs only
    the ratios alpha1 / alpha0 and beta1 / beta0; each step maps a ratio to one between two constants times
    the token's odds, so nothing overflows. Returns marginals, log P(all clean) per
    sequence, and with ``pairs`` the expected transition counts and the log partition.
    """
    order = np.argsort(-lengths, kind="stable")
    s, n = start[order], lengths[order]
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # sequences with more than t tokens
    odds = np.exp(np.clip(e, -300, 300))
    x00, x01, x10, x11 = np.exp(trans.ravel())
    a, b, scale = odds.copy(), np.ones(len(e)), np.ones(len(e))
    for t in range(1, longest):
        i = s[: alive[t]] + t
        r = a[i - 1]
        zero = x00 + r * x10
        scale[i] = zero
        a[i] = (x01 + r * x11) / zero * odds[i]
    for t in range(longest - 2, -1, -1):
        i = s[: alive[t + 1]] + t
        r = b[i + 1] * odds[i + 1]
        b[i] = (x10 + r * x11) / (x00 + r * x01)
    both = a * b
    m = both / (1 + both)
    inner = np.ones(len(e), bool)
    inner[start] = False
    total = np.add.reduceat(np.log(scale), start) + np.log1p(a[start + lengths - 1]) if len(start) else np.zeros(0)
    clean = (lengths - 1) * trans[0, 0] - total
    if not pairs:
        return m, clean
    at = np.flatnonzero(inner)
    # pair posteriors from the left message and the right one
    left, right = a[at - 1], b[at] * odds[at]
    w = np.stack([np.full(len(at), x00), x01 * right, left * x10, left * x11 * right])
    w /= w.sum(axis=0)
    return m, clean, w.sum(axis=1).reshape(2, 2), total


def mark(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> tuple[set[str], set[str]]:
    """(words, stems) that set toxic documents, given as their sentences, apart."""
    seen = []
    for docs in (toxic, clean):
        words, stems = Counter(), Counter()
        for doc in docs:
            own = {w.lower() for s in doc for w in s}
            words.update(own)
            stems.update({w[:n] for w in own for n in STEM if len(w) > n})
        seen.append((words, stems, max(1, len(docs))))
    (tw, ts, tn), (cw, cs, cn) = seen
    share = tn / (tn + cn)

    def lopsided(a: Counter, b: Counter) -> set[str]:
        """Strings whose documents lean to the toxic side further than chance among as many strings explains."""
        tried = sum(1 for x, k in a.items() if k + b[x] >= 3)
        need = math.log(max(tried, 1)) + 2.0
        out = set()
        for x, k in a.items():
            n = k + b[x]
            if k >= 3 and k / n >= MOSTLY:
                gain = k * math.log(k / n / share) + (b[x] * math.log(b[x] / n / (1 - share)) if b[x] else 0.0)
                if gain >= need:
                    out.add(x)
        return out

    return lopsided(tw, cw), lopsided(ts, cs)


class Types:
    """Features of the distinct words of some sequences: for each part (own, left, right) pairs (word, feature)."""

    def __init__(self, words: list[str]):
        self.codes: dict[str, int] = {}
        self.at = np.array([self.codes.setdefault(w, len(self.codes)) for w in words], np.int64)
        often = np.bincount(self.at, minlength=len(self.codes))
        self.names: list[tuple[str, str]] = []
        self.parts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part, of, least in (("own", word_features, 2), ("left", neighbour_features, 3), ("right", neighbour_features, 3)):
            count: Counter = Counter()
            listed = [of(w) for w in self.codes]
            for fs, n in zip(listed, often.tolist()):
                for f in fs:
                    count[f] += n
            ids: dict[str, int] = {}
            pairs = [(i, ids.setdefault(f, len(self.names) + len(ids))) for i, fs in enumerate(listed) for f in fs if count[f] >= least]
            self.names += [(part, f) for f in ids]
            word, feature = zip(*pairs) if pairs else ((), ())
            self.parts[part] = np.array(word, np.int64), np.array(feature, np.int64)

    def values(self, part: str, weight: np.ndarray) -> np.ndarray:
        """The sum of a part's weights for each distinct word."""
        word, feature = self.parts[part]
        return np.bincount(word, weights=weight[feature], minlength=len(self.codes))

    def gradient(self, part: str, by_word: np.ndarray) -> np.ndarray:
        word, feature = self.parts[part]
        return np.bincount(feature, weights=by_word[word], minlength=len(self.names))


def fit_crf(sequences: list[list[str]], tags: list[np.ndarray], rounds: int = 60, rate: float = 0.5, ridge: float = 2e-4) -> Crf:
    """Adaptive gradient ascent on the log likelihood of ``tags``.

    Features belong to words, so potentials and gradients are summed by distinct word, not by token.
    """
    lengths = np.array([len(s) for s in sequences])
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    words = Types([w for s in sequences for w in s])
    y = np.concatenate(tags).astype(float)
    n, kinds = len(y), len(words.codes)
    inner = np.ones(n, bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    before, after = words.at[at - 1], words.at[at]
    weight, bias, trans = np.zeros(len(words.names)), 0.0, np.zeros((2, 2))
    g2, b2, t2 = np.full(len(weight), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[at - 1].astype(int), y[at].astype(int)), 1)
    for _ in range(rounds):
        e = bias + words.values("own", weight)[words.at]
        e[at] += words.values("left", weight)[before]
        e[at - 1] += words.values("right", weight)[after]
        m, _, expected, _ = forward_backward(e, start, lengths, trans, pairs=True)
        gap = y - m
        g = words.gradient("own", np.bincount(words.at, weights=gap, minlength=kinds))
        g += words.gradient("left", np.bincount(before, weights=gap[at], minlength=kinds))
        g += words.gradient("right", np.bincount(after, weights=gap[at - 1], minlength=kinds))
        g -= ridge * len(sequences) * weight
        b = gap.sum() - ridge * len(sequences) * bias
        h = observed - expected - ridge * len(sequences) * trans
        g2 += g * g
        b2 += b * b
        t2 += h * h
        weight += rate * g / np.sqrt(g2)
        bias += rate * b / math.sqrt(b2)
        trans += rate * h / np.sqrt(t2)
    model = Crf(trans=trans, bias=float(bias))
    for (part, f), w in zip(words.names, weight.tolist()):
        if abs(w) > 1e-3:
            getattr(model, part)[f] = w
    return model


def evidence(texts: list[str], scorer: Scorer) -> list[np.ndarray]:
    """Per CRF and text: log of 1 + the squared odds of its sentences, highest marginal's log odds, log of 1 + its squared marginals.

    Squares keep the many small marginals of a long clean text from adding up to a toxic one.
    """
    split = [sentences(t) for t in texts]
    rows = [s for doc in split for s in doc]
    if not rows:
        return [np.tile([0.0, _logit(0.0), 0.0], (len(texts), 1)) for _ in scorer.crfs]
    doc_of_row = np.repeat(np.arange(len(texts)), [len(d) for d in split])
    doc_of_token = np.repeat(doc_of_row, [len(r) for r in rows])
    out = []
    for m, clean in scorer.marginals(rows):
        any_toxic = -np.expm1(np.minimum(clean, 0.0))
        top = np.zeros(len(texts))
        np.maximum.at(top, doc_of_token, m)
        total = lambda at, w: np.log1p(np.bincount(at, weights=w, minlength=len(texts)))
        out.append(np.column_stack([total(doc_of_row, any_toxic * any_toxic), _logit(top), total(doc_of_token, m * m)]))
    return out


def _logit(p):
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p))


def scores(texts: list[str], model: Model, scorer: Scorer) -> np.ndarray:
    if not model.crfs:
        return np.full(len(texts), model.prior)
    found = [evidence(part, scorer) for part in parts(texts)]
    return np.mean([np.concatenate([labelled.logistic(x[i], m.calibration) for x in found]) for i, m in enumerate(model.crfs)], axis=0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit_texts(*labelled.sample(docs, labels, "toxic", id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES))


def train(toxic_texts: list[str], clean_texts: list[str]) -> Crf:
    """A CRF from projected token labels; of each class's sentences without a marked word every n-th, ``QUIET`` at most."""
    groups = [[sentences(t) for t in texts] for texts in (toxic_texts, clean_texts)]
    words, stems = mark(*groups)
    marked: dict[str, bool] = {}

    def toxic(word: str) -> bool:
        if (known := marked.get(word)) is None:
            low = word.lower()
            known = marked[word] = low in words or any(low[:n] in stems for n in STEM if len(low) > n)
        return known

    sequences, tags = [], []
    for docs in groups:
        tagged = [(s, any(map(toxic, s))) for doc in docs for s in doc]
        quiet = [s for s, loud in tagged if not loud]
        for s in [s for s, loud in tagged if loud] + quiet[:: max(1, -(-len(quiet) // QUIET))]:
            sequences.append(s)
            tags.append(np.array([toxic(w) for w in s]))
    return fit_crf(sequences, tags) if sequences else Crf()


def fit_texts(texts: dict[int, list[str]], counts: dict[int, int]) -> Model:
    """Two CRFs from halves of the sample, each calibrated on the half that it has not seen."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    group = {y: list(dict.fromkeys(texts[y])) for y in (0, 1)}  # copies say nothing new about words
    if min(len(group[0]), len(group[1])) < 2:
        return Model(prior=prior)
    halves = [{y: group[y][h::2] for y in (0, 1)} for h in (0, 1)]
    crfs = []
    for seen, held in (halves, halves[::-1]):
        crf = train(seen[1], seen[0])
        scorer = Scorer([crf])
        x = {c: np.concatenate([evidence(part, scorer)[0] for part in parts(held[c])]) for c in (0, 1)}
        y = np.repeat([0.0, 1.0], [len(x[0]), len(x[1])])
        crf.calibration = labelled.to_whole(labelled.fit_logistic(np.concatenate([x[0], x[1]]), y), {c: len(x[c]) for c in (0, 1)}, counts)
        crfs.append(crf)
    return Model(crfs, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # weights of a bounded sample's features
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        scorer = Scorer(m.crfs)
        for b in batches:
            s = scores(b.column(1).to_pylist(), m, scorer)
            yield pa.record_batch([b.column(0), pa.array(s)], names=["id", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double")


def parts(texts: list[str], chars: int = 2 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters, so that memory does not follow the batch size."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield texts[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(texts) or not texts:
        yield texts[begin:]


def spans(text: str, model: Model, least: float = 0.5, scorer: Scorer | None = None) -> list[tuple[int, int, float]]:
    """(start, end, highest marginal) of runs of tokens at least ``least`` likely toxic, in code points."""
    found = [(t.start(), t.end(), t.group()) for t in _TOKEN.finditer(text)]
    words = [f for f in found if f[2] not in _ENDS]
    rows = sentences(text)
    if not rows or not model.crfs:
        return []
    m = np.mean([m for m, _ in (scorer or Scorer(model.crfs)).marginals(rows)], axis=0)
    out: list[tuple[int, int, float]] = []
    breaks = set(np.cumsum([len(r) for r in rows]).tolist())
    open_ = False
    for i, ((a, b, _), p) in enumerate(zip(words, m.tolist())):
        if i in breaks:
            open_ = False
        if p >= least:
            if open_:
                out[-1] = (out[-1][0], b, max(out[-1][2], p))
            else:
                out.append((a, b, p))
            open_ = True
        else:
            open_ = False
    return out


def toxic_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: id and its offending offsets, as spans array<struct<start, end, score>> in text order; empty if none.

    ``start`` and ``end`` count code points of the whole text, ``score`` is the highest marginal inside. One pass, no shuffle; null
    and empty texts have no spans.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # weights of a bounded sample's features
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        scorer = Scorer(m.crfs)
        for b in batches:
            found = [[{"start": x, "end": y, "score": p} for x, y, p in spans(t, m, least, scorer)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, struct)], names=["id", "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<start:long,end:long,score:double>>")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(F.col("id").alias(id_col), labelled.held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
