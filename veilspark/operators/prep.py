"""Preparation: cleaning, label binarisation, roles, scaling (one lazy plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col, scale
from ..sources.schema import PublicSchema


def clean(df: DataFrame) -> DataFrame:
    """Rows without a null and without a cell that reads exactly ``?``: plain comparisons, which reach the scan."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    for c in df.columns:
        df = df.filter(col(c).isNotNull())
        if c in text:
            df = df.filter(col(c) != "?")
    return df


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def numeric_labels(df: DataFrame, label: str, positive: str) -> bool:
    """Are all labels, and the positive value, numbers? One aggregate decides."""
    try:
        float(positive)
    except ValueError:
        return False
    row = df.agg(F.every(col(label).try_cast("double").isNotNull()).alias("all")).first()
    return bool(row["all"]) if row["all"] is not None else True


def binarize(label: Column, positive: str, numeric: bool) -> Column:
    """1 for the positive label: by number, or by trimmed upper-case text."""
    if numeric:
        return F.when(label.try_cast("double") == float(positive), 1).otherwise(0)
    return F.when(F.upper(F.trim(label.cast("string"))) == positive.strip().upper(), 1).otherwise(0)


def split_types(df: DataFrame, label: str) -> tuple[list[str], list[str]]:
    """(numeric, other) columns by physical type, without label and target."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema if f.name not in (label, "target")}
    return [c for c, n in kinds.items() if n], [c for c, n in kinds.items() if not n]


def prepare(df: DataFrame, schema: PublicSchema, numeric: bool | None = None) -> DataFrame:
    """Key, scaled numerics, string categories and the 0/1 target; rows with nulls are dropped."""
    schema.check_features([c for c in df.columns if c in schema.features or c == schema.label])
    if numeric is None:
        numeric = numeric_labels(df, schema.label, schema.positive)
    used = df.select(*[col(c) for c in dict.fromkeys([*([schema.key] if schema.key else []), *schema.features, schema.label])])
    return clean(used).select(
        *([col(schema.key).alias("row_id")] if schema.key else []),
        *[scale(schema, c).alias(c) for c in schema.numeric],
        *[col(c).cast("string").alias(c) for c in schema.categorical],
        binarize(col(schema.label), schema.positive, numeric).alias("target"),
    )
