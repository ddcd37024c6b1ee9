"""Public schemas: column roles, numeric bounds and ordered category domains.

Bounds and domains are public facts from a JSON file or a declaration, never computed
from rows. Order of columns and of domain values is part of the schema.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A public schema lacks or contradicts something an operator needs."""


@dataclass(frozen=True)
class PublicSchema:
    name: str
    bounds: Mapping[str, tuple[float, float]]
    domains: Mapping[str, tuple[str, ...]]
    label: str
    positive: str
    task: str = "binary classification"
    key: str | None = None
    decode_values: bool = False
    columns: tuple[dict, ...] = field(default=(), compare=False)

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.bounds if c != self.label]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.domains if c != self.label]

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def bound(self, column: str) -> tuple[float, float]:
        if column not in self.bounds:
            raise SchemaError(f"no public bounds for {column!r}")
        low, high = self.bounds[column]
        if not high > low:
            raise SchemaError(f"bounds of {column!r} are empty: {(low, high)}")
        return low, high

    def domain(self, column: str) -> tuple[str, ...]:
        if not self.domains.get(column):
            raise SchemaError(f"no public domain for {column!r}")
        return self.domains[column]

    def check_features(self, columns: Sequence[str]) -> None:
        """Error if a table has a feature that the schema does not declare."""
        unknown = [c for c in columns if c not in self.bounds and c not in self.domains and c not in (self.label, self.key, "target")]
        if unknown:
            raise SchemaError(f"columns without a public role: {unknown}")

    def prompt_metadata(self) -> tuple[dict[str, str], dict[str, dict[str, str]], dict[str, str]]:
        """Shown names, value labels and units of columns that declare them."""
        names, values, units = {}, {}, {}
        for c in self.columns:
            if c.get("name") is None:
                continue
            name = str(c["name"])
            names[name] = str(c.get("prompt_name", name))
            if isinstance(c.get("value_labels"), dict):
                values[name] = {str(k): str(v) for k, v in c["value_labels"].items()}
            if c.get("unit") is not None:
                units[name] = str(c["unit"])
        return names, values, units


def compile_columns(payload: Mapping | None) -> tuple[dict[str, tuple[str, ...]], dict[str, tuple[float, float]]]:
    """(domains, bounds) of a schema document; an empty document gives two empty dicts."""
    domains, bounds = {}, {}
    for c in (payload or {}).get("columns", []):
        if c.get("type") == "categorical":
            domains[str(c["name"])] = tuple(str(v) for v in c.get("i2s", []))
        elif c.get("type") == "continuous":
            bounds[str(c["name"])] = (float(c["min"]), float(c["max"]))
    return domains, bounds


def load_schema(path: str | Path, name: str | None = None, label: str | None = None, positive: str = "1", **more) -> PublicSchema:
    """A schema file; a given ``label`` wins over the file's own."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"schema file {path}")
    payload = json.loads(path.read_text(encoding="utf-8"))
    domains, bounds = compile_columns(payload)
    return PublicSchema(name or path.parent.name, bounds, domains, label or str(payload.get("label", "label")), positive, str(payload.get("task", "binary classification")), columns=tuple(payload.get("columns", ())), **more)


def csv_struct(schema: PublicSchema, header: Sequence[str]) -> T.StructType:
    """Read types for a CSV header: declared numerics as double, everything else as string."""
    return T.StructType([T.StructField(c, T.DoubleType() if c in schema.bounds and c != schema.label else T.StringType()) for c in header])


def _declared(name, key, bounds, domains, label, positive, task):
    return PublicSchema(name, bounds, {k: tuple(v) for k, v in domains.items()}, label, positive, task, key)


#: Declared public schemas of the driver's tables; bounds are constants that cover every scale.
DECLARED: dict[str, PublicSchema] = {
    s.name: s
    for s in (
        _declared("orders", "o_orderkey", {"o_totalprice": (0.0, 500000.0)}, {"o_orderstatus": ("F", "O", "P")}, "o_orderpriority", "1-URGENT", "order urgency prediction"),
        _declared("customer", "c_custkey", {"c_acctbal": (-1000.0, 10000.0)}, {"c_nationkey": [str(i) for i in range(25)]}, "c_mktsegment", "BUILDING", "segment prediction"),
        _declared("part", "p_partkey", {"p_size": (1.0, 50.0), "p_retailprice": (900.0, 1000.0)}, {"p_brand": [f"Brand#{i}" for i in range(1, 26)]}, "p_type", "PROMO", "promotion prediction"),
        _declared("lineitem", None, {"l_quantity": (1.0, 50.0), "l_extendedprice": (0.0, 105000.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)}, {"l_linestatus": ("F", "O")}, "l_returnflag", "R", "return prediction"),
        _declared("events", "event_id", {"value": (0.0, 600.0)}, {}, "event_type", "purchase", "purchase prediction"),
        _declared("labels", "doc_id", {}, {"toxic": ("0", "1")}, "quality", "1", "quality prediction"),
    )
}


@dataclass(frozen=True)
class Registered:
    """Where a CSV dataset lives and what its label means."""

    folder: str
    schema_file: str
    label: str
    positive: str
    task: str
    decode_values: bool = False


#: Registered CSV datasets (fixed values).
REGISTRY: dict[str, Registered] = {
    "Adult": Registered("adult", "adult.json", "label", ">50K", "income prediction", True),
    "Airline": Registered("airline", "airline.json", "satisfaction", "satisfied", "passenger satisfaction prediction", True),
    "Diabetes": Registered("diabetes", "diabetes.json", "Diabetes_binary", "1", "diabetes risk prediction"),
    "Phishing": Registered("phishing", "phishing.json", "label", "1", "phishing website detection"),
    "Heart": Registered("heart", "heart.json", "HeartDisease", "1", "heart disease prediction"),
}
