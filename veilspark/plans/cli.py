"""Command line: ``python -m veilspark.plans.cli {marginal,generator} --root DIR --datasets ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from importlib import import_module

from pyspark.sql import SparkSession

from ..functions.rand import Noise
from ..operators.generator import GeneratorConfig
from .experiment import METHODS, SPLIT_SEED, SUMMARY_SEED, GeneratorBackend, MarginalBackend, prepare_dataset, run_experiments


def named(path: str | None):
    """The object that ``module:name`` names."""
    if path is None:
        return None
    module, _, name = path.partition(":")
    if not name:
        raise ValueError(f"{path!r} should read module:name")
    return getattr(import_module(module), name)


def option(text: str) -> tuple[str, object]:
    """``name=value`` with a number, true, false or none."""
    name, _, value = text.partition("=")
    known = {"true": True, "false": False, "none": None}
    return name, known[value.lower()] if value.lower() in known else float(value) if set(value) & set(".eE") else int(value)


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Evaluate private synthetic demonstrations over a grid of experiments.")
    p.add_argument("backend", choices=("marginal", "generator"))
    p.add_argument("--root", required=True, help="folder of registered CSV datasets, or of Parquet tables")
    p.add_argument("--datasets", nargs="+", default=["Adult", "Airline", "Diabetes", "Phishing"])
    p.add_argument("--methods", nargs="+", default=list(METHODS), choices=METHODS)
    p.add_argument("--trials", type=int, default=10)
    p.add_argument("--k", type=int, nargs="+", default=[3])
    p.add_argument("--epsilon", type=float, nargs="+", default=[1.0, 2.0, 4.0])
    p.add_argument("--shots", type=int, default=8)
    p.add_argument("--bins", type=int, default=8)
    p.add_argument("--delta", type=float, default=1e-5)
    p.add_argument("--cluster-share", type=float, default=0.30)
    p.add_argument("--weight-fraction", type=float, default=0.10)
    p.add_argument("--cache-dir")
    p.add_argument("--out", default="results")
    p.add_argument("--n-synth", type=int)
    p.add_argument("--consistency-rounds", type=int, default=2)
    p.add_argument("--view-rounds", type=int, default=10)
    p.add_argument("--update-rounds", type=int, default=20)
    p.add_argument("--rounds", type=int, default=10)
    p.add_argument("--alpha", type=float, default=0.5)
    p.add_argument("--inner", type=int, default=100)
    p.add_argument("--generator", nargs="*", type=option, default=[], metavar="NAME=VALUE", help="further options of the generator, as degree=3 or eta_min=0.001")
    p.add_argument("--split-seed", type=int, default=SPLIT_SEED)
    p.add_argument("--summary-seed", type=int, default=SUMMARY_SEED)
    p.add_argument("--scorer", help="module:name of a function from (weighted space, schema) to a scorer")
    p.add_argument("--weigher", help="module:name of a weigher")
    p.add_argument("--ceiling", type=float, help="epsilon that the whole sweep may cost a dataset")
    p.add_argument("--test-noise", action="store_true", help="repeatable noise that anyone can remove: NOT private")
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    a = parse_args(argv)
    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    noise = Noise.test if a.test_noise else Noise.secret
    if a.backend == "marginal":
        backend = MarginalBackend(a.bins, a.delta, a.consistency_rounds, a.view_rounds, a.update_rounds, noise)
    else:
        backend = GeneratorBackend(a.bins, a.delta, GeneratorConfig.of(rounds=a.rounds, alpha=a.alpha, inner=a.inner, **dict(a.generator)), noise)
    contexts = [prepare_dataset(spark, d, a.root) for d in a.datasets]
    run_experiments(
        spark, backend, contexts, a.methods, a.trials, a.k, a.epsilon, a.shots, a.delta, a.cluster_share, a.weight_fraction, cache_dir=a.cache_dir, out=a.out, noise=noise, n_synth=a.n_synth,
        scorer=named(a.scorer), split_seed=a.split_seed, summary_seed=a.summary_seed, ceiling=a.ceiling, **({"weigher": named(a.weigher)} if a.weigher else {}),
    ).show(truncate=False)


if __name__ == "__main__":
    main()
