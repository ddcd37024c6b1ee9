"""Scalar expressions over prepared rows: scaling, binning, codes, group keys, formats."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import PublicSchema, SchemaError


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def scale(schema: PublicSchema, name: str) -> Column:
    """Clipped to the public bounds and mapped to [0, 1]."""
    low, high = schema.bound(name)
    return (clip(col(name).cast("double"), low, high) - low) / (high - low)


def clip_numeric(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Text or number to a clipped double; what is not a number becomes ``low``."""
    value = x.try_cast("double")
    return clip(F.when(value.isNull() | F.isnan(value), F.lit(float(low))).otherwise(value), low, high)


def unscale(schema: PublicSchema, name: str, digits: int = 2) -> Column:
    low, high = schema.bound(name)
    return F.round(col(name) * (high - low) + low, digits)


def scaled_threshold(schema: PublicSchema, name: str, original: float) -> float:
    low, high = schema.bound(name)
    return (float(original) - low) / (high - low)


def edges(bins: int, low: float = 0.0, high: float = 1.0) -> list[float]:
    """Equal-width edges; public, so the data plays no part."""
    return [float(x) for x in np.linspace(low, high, bins + 1)]


def digitize(df: DataFrame, columns: Sequence[str], bins: int, suffix: str = "_bin") -> DataFrame:
    """Left-closed bins over [0, 1]; 1.0 falls into the last one. Exact at every edge."""
    inner = edges(bins)[1:-1]
    safe = {c: f"__b{i}" for i, c in enumerate(columns)}
    df = df.withColumns({v: clip_numeric(col(k)) for k, v in safe.items()})
    return df.withColumns({k + suffix: bin_of(F.col(v), inner) for k, v in safe.items()}).drop(*safe.values())


def bin_of(x: Column, inner: Sequence[float], first: int = 0) -> Column:
    """The number of ``inner`` edges at or below ``x``, by bisection in nested conditions."""
    if not inner:
        return F.lit(first)
    middle = len(inner) // 2
    return F.when(x < inner[middle], bin_of(x, inner[:middle], first)).otherwise(bin_of(x, inner[middle + 1 :], first + middle + 1))


def midpoint(code: Column, bins: int) -> Column:
    mids = [(a + b) / 2 for a, b in zip(edges(bins), edges(bins)[1:])]
    at = F.least(F.greatest(F.coalesce(code.cast("int"), F.lit(0)), F.lit(0)), F.lit(bins - 1))
    return F.element_at(F.array(*[F.lit(m) for m in mids]), at + 1)


def domain_array(domain: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in domain])


def code(x: Column, domain: Sequence[str], strict: bool = False) -> Column:
    """Position in the ordered domain; an unknown value is an error if ``strict``, else code 0."""
    if not domain:
        raise SchemaError("empty domain")
    at = F.coalesce(F.array_position(domain_array(domain), x.cast("string")), F.lit(0)).cast("int") - 1
    if not strict:
        return F.greatest(at, F.lit(0))
    return F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("value outside its public domain: "), F.coalesce(x.cast("string"), F.lit("NULL")))).cast("int"))


def decode(at: Column, domain: Sequence[str]) -> Column:
    safe = F.least(F.greatest(F.coalesce(at.cast("int"), F.lit(0)), F.lit(0)), F.lit(len(domain) - 1))
    return F.element_at(domain_array(domain), safe + 1)


def target_code(x: Column) -> Column:
    """Labels and generated labels to 0 or 1: rounded, null to 0, clipped."""
    return clip(F.coalesce(F.round(x.try_cast("double")), F.lit(0.0)), 0, 1).cast("int")


# -- public binary group keys ------------------------------------------------------------------

#: Published category merges (fixed values): dataset, column -> value, name, name of the rest.
MERGES = {
    ("adult", "race"): ("white", "White", "Non-White"),
    ("bank", "marital"): ("married", "Married", "Not-Married"),
    ("bank", "marital-status"): ("married", "Married", "Not-Married"),
    ("bank", "contact"): ("cellular", "Cellular", "Non-Cellular"),
    ("bank", "contact-type"): ("cellular", "Cellular", "Non-Cellular"),
}
#: Published numeric thresholds in original units (fixed values).
THRESHOLDS = {"diabetes": {"Pregnancies": 4, "Age": 33}}


def _merge(dataset: str, name: str) -> tuple[str, str, str] | None:
    ds = "bank" if dataset.lower() == "banking" else dataset.lower()
    return MERGES.get((ds, name.lower()))


def group_threshold(schema: PublicSchema, name: str) -> float:
    original = THRESHOLDS.get(schema.name.lower(), {}).get(name)
    return 0.5 if original is None else scaled_threshold(schema, name, original)


def group_key(schema: PublicSchema, name: str) -> Column:
    """A row's public binary group by one column of prepared rows."""
    if name == "target":
        return F.col("target").cast("int").cast("string")
    if name in schema.numeric:
        return F.when(clip_numeric(col(name)) <= group_threshold(schema, name), "low").otherwise("high")
    if name not in schema.categorical:
        raise SchemaError(f"unknown group column {name!r}")
    domain = schema.domain(name)
    if merge := _merge(schema.name, name):
        value, yes, no = merge
        return F.when(F.lower(F.trim(col(name))) == value, yes).otherwise(no)
    if len(domain) <= 2:
        return col(name).cast("string")
    first = domain[: (len(domain) + 1) // 2]
    return F.when(col(name).isin(*first), "group0").otherwise("group1")


def group_domain(schema: PublicSchema, name: str) -> list[str]:
    """All public values of ``group_key``."""
    if name == "target":
        return ["0", "1"]
    if name in schema.numeric:
        return ["low", "high"]
    if name not in schema.categorical:
        raise SchemaError(f"unknown group column {name!r}")
    domain = list(schema.domain(name))
    if merge := _merge(schema.name, name):
        return [merge[1], merge[2]]
    return domain if len(domain) <= 2 else ["group0", "group1"]


#: Preferred group columns of known datasets (fixed values).
PREFERRED = {
    "adult": (("sex", "gender"), ("race", "marital-status", "relationship", "education")),
    "bank": (("marital", "marital-status"), ("contact", "contact-type")),
    "banking": (("marital", "marital-status"), ("contact", "contact-type")),
    "diabetes": (("Pregnancies",), ("Age",)),
    "shoppers": (("VisitorType", "Weekend", "Month"), ("Weekend", "Month", "VisitorType")),
}
SUPPORTED_SHOTS = (1, 2, 4, 8)


def first_existing(preferred: Sequence[str], available: Sequence[str]) -> str | None:
    return next((c for c in preferred if c in set(available)), None)


def group_spec(schema: PublicSchema, shots: int) -> list[str]:
    """Group columns for 1, 2, 4 or 8 prototypes; other counts group as 8."""
    shots = shots if shots in SUPPORTED_SHOTS else 8
    if shots == 1:
        return []
    if shots == 2:
        return ["target"]
    have, name = schema.features, schema.name.lower()
    by_kind = schema.categorical + schema.numeric
    if name == "abalone":
        first, second = first_existing(["sex"], have), first_existing(schema.numeric, have)
    elif name in PREFERRED:
        first, second = (first_existing(p, have) for p in PREFERRED[name])
        if name == "shoppers" and first == second:
            second = first_existing([c for c in by_kind if c != first], have)
    elif name == "defaultcredit":
        first = first_existing(schema.categorical, have)
        second = first_existing([c for c in by_kind if c != first], have)
    else:
        first = first_existing(by_kind, have)
        second = first_existing([c for c in by_kind if c != first], have)
    return ["target", *[c for c in ((first,) if shots == 4 else (first, second)) if c is not None]]


# -- text ----------------------------------------------------------------------------------------


def format_value(x: Column, is_float: bool) -> Column:
    """``NA`` for null and NaN, four decimals for floats, else at most 60 characters."""
    if is_float:
        return F.when(x.isNull() | F.isnan(x), "NA").otherwise(F.format_string("%.4f", x))
    return F.coalesce(F.substring(x.cast("string"), 1, 60), F.lit("NA"))


def yes_no(x: Column) -> Column:
    return F.when((F.coalesce(x.try_cast("double"), F.lit(0.0)).cast("int") == 1) | F.lower(F.trim(x.cast("string"))).isin("1", "yes", "true", "positive"), "Yes").otherwise("No")
