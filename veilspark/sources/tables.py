"""Sources and sinks: CSV with public types, Parquet, weight caches, append-only results."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import REGISTRY, PublicSchema, csv_struct, load_schema

#: Cells that a header CSV means as missing, as the usual CSV readers take them (fixed values).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: PublicSchema) -> DataFrame:
    """A header CSV, typed by its public schema; no inference pass over the data."""
    header = spark.read.option("header", True).csv(path).columns
    spelled = csv_struct(schema, header)
    text = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in header)).csv(path)
    cell = lambda f: F.when(F.trim(F.col(f"`{f.name}`")).isin(*MISSING), None).otherwise(F.col(f"`{f.name}`"))
    return text.select(*[cell(f).try_cast(f.dataType).alias(f.name) if f.name in schema.bounds else cell(f).alias(f.name) for f in spelled])


def dataset_paths(name: str, root: str | Path) -> dict[str, Path]:
    """Files of a registered dataset; unknown names and missing files are errors."""
    if name not in REGISTRY:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(REGISTRY)}")
    r = REGISTRY[name]
    found = {"train": Path(root, r.folder, "train.csv"), "test": Path(root, r.folder, "test.csv")}
    missing = [str(p) for p in found.values() if not p.exists()]
    if missing:
        raise FileNotFoundError(f"dataset {name}: {missing}")
    return found | {"schema": Path(root, r.folder, r.schema_file)}


def registered_schema(name: str, root: str | Path, schema_dir: str | Path | None = None) -> PublicSchema:
    r = REGISTRY[name]
    path = Path(schema_dir, r.schema_file) if schema_dir else Path(root, r.folder, r.schema_file)
    s = load_schema(path, name, r.label, r.positive, decode_values=r.decode_values)
    return PublicSchema(name, s.bounds, s.domains, r.label, r.positive, r.task, None, r.decode_values, s.columns)


# -- weight caches -----------------------------------------------------------------------------


class CacheError(ValueError):
    """A weight cache does not describe the run that asks for it."""


def cache_name(dataset: str, epsilon: float) -> str:
    return f"{dataset.lower()}_eps_{epsilon:g}.json"


def check_cache(payload: Mapping, epsilon: float, split_seed: int | None, features: Sequence[str]) -> dict[str, float]:
    """The cached weights, if they are of this epsilon, split and feature set."""
    weights = payload.get("normalized_weights")
    if not isinstance(weights, Mapping) or not weights:
        raise CacheError("the cache holds no normalized_weights")
    if abs(float(payload.get("epsilon", float("nan"))) - float(epsilon)) > 1e-12 or payload.get("epsilon") is None:
        raise CacheError(f"cached for epsilon {payload.get('epsilon')}, asked for {epsilon}")
    if split_seed is not None and payload.get("weight_split_seed") != split_seed:
        raise CacheError(f"cached for split seed {payload.get('weight_split_seed')}, asked for {split_seed}")
    if set(weights) != set(features):
        raise CacheError(f"cached features differ: {sorted(set(weights) ^ set(features))}")
    return {str(k): float(v) for k, v in weights.items()}


def read_cache(folder: str | Path, dataset: str, epsilon: float, split_seed: int | None, features: Sequence[str]) -> dict[str, float] | None:
    """Weights from ``folder``, or None if there is no file; an unfit file is an error."""
    path = Path(folder, cache_name(dataset, epsilon))
    if not path.exists():
        return None
    return check_cache(json.loads(path.read_text(encoding="utf-8")), epsilon, split_seed, features)


def write_cache(folder: str | Path, dataset: str, epsilon: float, payload: Mapping) -> Path:
    path = Path(folder, cache_name(dataset, epsilon))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, indent=2, ensure_ascii=False), encoding="utf-8")
    return path


# -- results -----------------------------------------------------------------------------------


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows as Parquet files of their own: concurrent and failed writers leave no half rows."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_results(results: DataFrame, retrieval: DataFrame | None, path: str) -> None:
    """Result rows to ``path``; per-query retrieval rows to its ``_retrieval`` sibling."""
    append(results, path, "dataset", "method")
    if retrieval is not None:
        append(retrieval, path.rstrip("/") + "_retrieval", "dataset", "method")


def append_csv(rows: Sequence[Mapping], path: str | Path) -> None:
    """Append driver-sized rows to one CSV file, its header only when the file is new or empty."""
    import csv

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = not path.exists() or not path.stat().st_size
    with path.open("a", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, list(rows[0]) if rows else [])
        if fresh and rows:
            writer.writeheader()
        writer.writerows(rows)
