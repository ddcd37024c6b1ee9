"""Weighted one-hot space: specification, encoding expressions, centre decoding."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import clip_numeric, col
from ..sources.schema import PublicSchema


@dataclass(frozen=True)
class OneHotSpec:
    """Coordinate scales: one per numeric column, one block per category column."""

    numeric: tuple[tuple[str, float], ...]
    blocks: tuple[tuple[str, tuple[str, ...], float], ...]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(len(d) for _, d, _ in self.blocks)

    @property
    def upper(self) -> list[float]:
        """Greatest value of every coordinate."""
        return [max(s, 1e-8) for _, s in self.numeric] + [max(s, 1e-8) for _, d, s in self.blocks for _ in d]

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.numeric] + [f"{c}={v}" for c, d, _ in self.blocks for v in d]


def onehot_spec(schema: PublicSchema, weights: Mapping[str, float] | None = None) -> OneHotSpec:
    """Numeric scale sqrt(w), category scale sqrt(w / domain size); missing weights are 1, negative ones 0."""
    w = lambda c: max(float((weights or {}).get(c, 1.0)), 0.0)
    return OneHotSpec(tuple((c, math.sqrt(w(c))) for c in schema.numeric), tuple((c, schema.domain(c), math.sqrt(w(c) / len(schema.domain(c)))) for c in schema.categorical))


def coordinates(spec: OneHotSpec) -> list[Column]:
    """The coordinates of a prepared row; an unknown category gives a block of zeros."""
    out = [clip_numeric(col(c)) * F.lit(s) for c, s in spec.numeric]
    for c, domain, s in spec.blocks:
        out += [F.when(col(c) == v, F.lit(s)).otherwise(F.lit(0.0)) for v in domain]
    return out


def onehot(spec: OneHotSpec) -> Column:
    return F.array(*coordinates(spec))


def decode_center(spec: OneHotSpec, center: Sequence[float]) -> dict[str, float | str]:
    """A centre back to a row: numerics unscaled and clipped (0.5 without a scale), the largest category."""
    if len(center) != spec.width:
        raise ValueError(f"centre has {len(center)} coordinates, the space {spec.width}")
    row: dict[str, float | str] = {}
    at = 0
    for c, s in spec.numeric:
        row[c] = min(max(float(center[at]) / s, 0.0), 1.0) if s > 1e-12 else 0.5
        at += 1
    for c, domain, _ in spec.blocks:
        block = [float(v) for v in center[at : at + len(domain)]]
        row[c] = domain[block.index(max(block))]
        at += len(domain)
    return row
