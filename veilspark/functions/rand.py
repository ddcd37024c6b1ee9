"""Keyed randomness: uniform and Laplace columns that do not depend on partitioning.

``Noise`` hashes a key with the cell's own coordinates. With ``Noise.test(seed)`` the key is a
known seed and md5 is used, so runs repeat and an oracle can follow; such noise can be
removed by anyone who knows the seed and is NOT private. ``Noise.secret()`` draws a
256-bit key and hashes with SHA-256: use it for releases.

Counts get discrete noise: ``discrete_laplace`` and ``discrete_normal`` compare 60-bit keyed integers with
thresholds that the driver computes with 50 digits, so a released count is an integer, no
floating-point operation touches it, and every probability is right to 2**-60. ``laplace`` and ``normal`` are for values that
are no counts.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str | int) -> Column:
    return (part if isinstance(part, Column) else F.lit(str(part))).cast("string")


#: Bits of a keyed integer, and the greatest sigma of one table of thresholds: a wider normal is a sum of narrower ones.
DIGITS, BITS, WIDEST = 15, 60, 512.0
_BLOCK = 64


@lru_cache(maxsize=64)
def laplace_bits(epsilon: float) -> tuple[int, ...]:
    """Of a geometric variable with ratio exp(-epsilon), bit j is 1 with this chance out of 2**60; its bits are independent."""
    out: list[int] = []
    with localcontext() as c:
        c.prec = 50
        while not out or out[-1]:
            out.append(int((1 << BITS) / (1 + (Decimal(epsilon) * (1 << len(out))).exp())))
    return tuple(out[:-1])


@lru_cache(maxsize=64)
def normal_table(sigma: float) -> tuple[int, ...]:
    """For k from -m to m: the chance, out of 2**60, that a discrete normal variable is at most k; beyond m less than one is left."""
    if not 0 < sigma <= WIDEST:
        raise ValueError(f"one table holds a sigma of at most {WIDEST}")
    m = math.ceil(9.3 * sigma) + 1
    with localcontext() as c:
        c.prec = 50
        half = [(-Decimal(k * k) / (2 * Decimal(sigma) * Decimal(sigma))).exp() for k in range(m + 1)]
        weights, upto, out = [*half[:0:-1], *half], Decimal(0), []
        total = sum(weights)
        for w in weights:
            upto += w
            out.append(int((1 << BITS) * upto / total))
    return tuple(out[:-1])


def _longs(values: tuple[int, ...]) -> Column:
    """A constant array; as text, which the optimiser folds to one literal."""
    return (F.split(F.lit(",".join(map(str, values))), ",") if values else F.array()).cast("array<bigint>")


@dataclass(frozen=True)
class Noise:
    """``key`` may be a column: rows then have the noise of their own release."""

    key: str | Column
    private: bool = False

    @staticmethod
    def test(*seed: int | str) -> Noise:
        """Repeatable, removable noise; further parts of the seed tell releases apart."""
        return Noise("|".join(map(str, seed)))

    @staticmethod
    def secret(*_: int | str) -> Noise:
        """A fresh key at every call, whatever is passed."""
        return Noise(secrets.token_hex(32), True)

    def uniform(self, *parts: Column | str | int) -> Column:
        """Strictly inside (0, 1), with 52 bits, a function of the key and ``parts``."""
        joined = F.concat_ws("|", F.lit(self.key), *[_text(p) for p in parts]).cast("binary")
        digest = F.sha2(joined, 256) if self.private else F.md5(joined)
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    def laplace(self, scale: float | Column, *parts: Column | str | int) -> Column:
        """Laplace with mean 0; zero for scales that are not positive and finite."""
        if isinstance(scale, Column):
            return F.when(scale > 0, scale * self.laplace(1.0, *parts)).otherwise(F.lit(0.0))
        if not scale > 0 or math.isinf(scale) or math.isnan(scale):
            return F.lit(0.0)
        u = self.uniform(*parts) - 0.5
        return -F.lit(float(scale)) * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))

    def integer(self, *parts: Column | str | int) -> Column:
        """At least 0 and below 2**60."""
        joined = F.concat_ws("|", F.lit(self.key), *[_text(p) for p in parts]).cast("binary")
        digest = F.sha2(joined, 256) if self.private else F.md5(joined)
        return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")

    def number(self, *parts: str | int) -> float:
        """``uniform`` of constants, on the driver or inside a task."""
        joined = "|".join([self.key, *map(str, parts)]).encode()
        digest = (hashlib.sha256 if self.private else hashlib.md5)(joined).hexdigest()
        return (int(digest[:13], 16) + 0.5) / float(1 << 52)

    def integers(self, parts: Iterable[tuple]) -> list[int]:
        """``integer`` of constants, inside a task."""
        digest = hashlib.sha256 if self.private else hashlib.md5
        return [int(digest("|".join([self.key, *map(str, p)]).encode()).hexdigest()[:DIGITS], 16) for p in parts]

    def discrete_normals(self, sigma: float, parts: tuple, places: Iterable[int]) -> list[int]:
        """``discrete_normal`` of (``parts``, place) for each place, inside a task."""
        places = list(places)
        if not sigma > 0:
            return [0] * len(places)
        times = math.ceil((sigma / WIDEST) ** 2)
        table = normal_table(sigma / math.sqrt(times))
        drawn = [bisect_right(table, u) - len(table) // 2 for u in self.integers((*parts, at, i) for at in places for i in range(times))]
        return [sum(drawn[i : i + times]) for i in range(0, len(drawn), times)]

    def laplace_number(self, scale: float, *parts: str | int) -> float:
        """``laplace`` of constants, on the driver."""
        u = self.number(*parts) - 0.5
        return -scale * math.copysign(1.0, u) * math.log(1.0 - 2.0 * abs(u))

    def discrete_laplace(self, epsilon: float, *parts: Column | str | int) -> Column:
        """An integer k with a chance proportional to exp(-epsilon |k|); zero for an infinite epsilon."""
        if not epsilon > 0:
            raise ValueError("epsilon must be positive")
        if infinite(epsilon):
            return F.lit(0).cast("long")
        side = lambda s: sum((F.when(self.integer(*parts, s, j) < t, 1 << j).otherwise(0).cast("long") for j, t in enumerate(laplace_bits(float(epsilon)))), F.lit(0).cast("long"))
        return side("+") - side("-")

    def discrete_normal(self, sigma: float, *parts: Column | str | int) -> Column:
        """An integer k with a chance proportional to exp(-k**2 / (2 sigma**2)); zero for a sigma that is not positive.

        Beyond ``WIDEST`` it is a sum of independent discrete normals of equal sigma, whose
        distribution differs from the single one by less than one part in 2**60.
        """
        if not sigma > 0:
            return F.lit(0).cast("long")
        times = math.ceil((sigma / WIDEST) ** 2)
        table = normal_table(sigma / math.sqrt(times))
        ends, whole = _longs(table[_BLOCK - 1 :: _BLOCK]), _longs(table)

        def below(u: Column) -> Column:
            blocks = F.size(F.filter(ends, lambda t: t <= u)) * _BLOCK
            return blocks + F.size(F.filter(F.slice(whole, blocks + 1, F.lit(_BLOCK)), lambda t: t <= u))

        drawn = F.transform(F.array(*[self.integer(*parts, i) for i in range(times)]), below)
        return F.aggregate(drawn, F.lit(-times * (len(table) // 2)).cast("long"), lambda s, x: s + x)

    def normal(self, sigma: float, *parts: Column | str | int) -> Column:
        """Gaussian by Box and Muller."""
        if not sigma > 0:
            return F.lit(0.0)
        r = F.sqrt(-2.0 * F.log(self.uniform(*parts, "r")))
        return F.lit(float(sigma)) * r * F.cos(2.0 * math.pi * self.uniform(*parts, "t"))


def infinite(epsilon: float | None) -> bool:
    """No privacy asked for: None, infinity, or beyond 1e20."""
    return epsilon is None or math.isinf(epsilon) or epsilon > 1e20


def order_key(seed: int | str | Column, *parts: Column | str | int) -> Column:
    """A hash to order rows by in place of a random number; break ties by the rows' key."""
    return F.md5(F.concat_ws("|", _text(seed), *[_text(p) for p in parts]).cast("binary"))
