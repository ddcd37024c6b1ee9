"""Token budgets, batches by length, weighers and the command line's hooks."""

import glob
import math

import pytest
from pyspark.sql import functions as F

from veilspark.functions.rand import Noise
from veilspark.operators import privacy, prompt, score
from veilspark.operators.generator import GeneratorConfig
from veilspark.plans import cli, experiment
from veilspark.sources import schema as S

TOKENIZERS = glob.glob("/opt/tokenizers/**/word_bpe_49k.json", recursive=True)
TOY = S.PublicSchema("toy", {"x": (0.0, 100.0)}, {"c": ("a", "b", "d")}, "label", "1", key="id")
needs_tokenizer = pytest.mark.skipif(not TOKENIZERS, reason="no public tokenizer at hand")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZERS[0])


@needs_tokenizer
@pytest.mark.parametrize("budget", [4000, 3000, 7, 1, 0])
def test_left_cut_is_exact_in_tokens(budget):
    coder = tokenizer()
    for text in ("Label: 1 naïve 𝄞 déjà-vu … " * 900, "x" * 30_000, "", "short", " \n\t "):
        cut, n = score.left_cut(text, coder, budget)
        assert text.endswith(cut) and n == len(coder.encode(cut, add_special_tokens=False).ids) <= budget
        whole = coder.encode(text, add_special_tokens=False).ids
        if len(whole) <= budget:
            assert cut == text
        elif budget:
            assert n >= budget - 4  # a cut inside a character or a word costs a few tokens at most


def test_batches_are_of_like_length():
    lengths = [5, 900, 20, 1000, 30, 7, 0, 1000]
    groups = list(score.by_length(lengths, 2000))
    assert sorted(i for g in groups for i in g) == list(range(8)) and [sorted(g) for g in groups][0] == [3, 7]
    assert all(len(g) * max(lengths[i] for i in g) <= 2000 or len(g) == 1 for g in groups)
    assert list(score.by_length([9000], 10)) == [[0]] and list(score.by_length([], 10)) == []


@needs_tokenizer
def test_scorer_sees_budgeted_texts_in_batches(spark, tmp_path):
    texts = [("word " * (50 * i) + f"Label: {i % 2}") for i in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, prompt string")
    seen = f"{tmp_path}/seen"

    def load():
        import json

        def scores(batch):
            with open(seen, "a") as f:
                f.write(json.dumps(batch) + "\n")
            return [(0.0, 1.0 if t.endswith("1") else -1.0) for t in batch]

        return scores

    path = TOKENIZERS[0]
    make = lambda: __import__("tokenizers").Tokenizer.from_file(path)
    out = score.text_scorer(load, tokenizer=make, max_tokens=300, batch_tokens=1200)(df.repartition(2), "query_id").toPandas()
    assert dict(zip(out.query_id, out.prediction)) == {i: int((t or "").endswith("1")) for i, t in enumerate(texts)}
    import json

    coder = tokenizer()
    batches = [[len(coder.encode(t, add_special_tokens=False).ids) for t in json.loads(line)] for line in open(seen)]
    assert sum(map(len, batches)) == len(texts) and max(map(max, batches)) == 300
    assert all(len(b) * max(b) <= 1200 or len(b) == 1 for b in batches)


def test_scorer_without_a_tokenizer_and_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, prompt string")
    even = lambda: lambda texts: [(1.0, 1.0)] * len(texts)
    assert {r.prediction for r in score.text_scorer(even)(df, "query_id").collect()} == {0}
    assert {r.prediction for r in score.text_scorer(even, True)(df, "query_id").collect()} == {1}
    assert score.text_scorer(even)(df.limit(0), "query_id").count() == 0
    assert score.max_label_scores([{"No": 1.0, "yes": 3.0, "0": 9.0}], score.LABELS["sentence"]) == [(1.0, 3.0)]


@needs_tokenizer
def test_weigher_keeps_its_budget(spark):
    seen = []
    two = spark.createDataFrame([(0.2, "a", 0), (0.8, "b", 1)], "x double, c string, target int")
    ask = lambda system, text: seen.append((system, text)) or '{"x": 1.0, "c": 0.5}'
    coder = tokenizer()
    for budget in (3000, 150):
        assert score.text_weigher(ask, tokenizer=tokenizer, max_tokens=budget)(two, TOY) == pytest.approx({"x": 4 / 3, "c": 2 / 3})
        system, text = seen[-1]
        assert sum(len(coder.encode(t, add_special_tokens=False).ids) for t in (system, text)) <= budget
    assert "0.05 (irrelevant) and 1.00 (critical predictor)" in system and seen[0][1].startswith(seen[1][1]) and seen[0][1].endswith("[0.05, 1.00].")
    with pytest.raises(score.ReplyError):
        score.text_weigher(lambda *_: "no object")(two, TOY)


def test_command_line_hooks():
    a = cli.parse_args(["generator", "--root", "x", "--generator", "degree=3", "eta_min=1e-3", "resample=true", "max_idxs=none", "--split-seed", "5", "--scorer", "math:sqrt", "--ceiling", "9"])
    assert GeneratorConfig.of(**dict(a.generator)) == GeneratorConfig(degree=3, eta_min=0.001, resample=True) and a.split_seed == 5 and a.ceiling == 9.0
    assert cli.named(a.scorer) is math.sqrt and cli.named(None) is None
    with pytest.raises(ValueError):
        cli.named("math")


def test_a_sweep_tells_what_it_costs(spark):
    assert experiment.sweep_cost(("global", "clustered"), 10, (3, 5), (1.0, 2.0)) == 90.0 and experiment.sweep_cost(("global",), 0, (3,), (1.0,)) == 1.0
    with pytest.raises(privacy.BudgetError):
        experiment.run_experiments(spark, experiment.MarginalBackend(noise=Noise.test), [], trials=2, epsilons=(1.0,), ceiling=3.9)


def test_words_are_cut_where_no_tokenizer_is(spark):
    cut = spark.range(1).select(prompt.left_truncated(F.lit("a b c\nd Label: "), 3)).first()[0]
    assert cut == "d Label: "
