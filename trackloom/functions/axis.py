"""Binned axes: regular (clamped), circular (wrapped) and irregular, and their neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trunc(x: Column) -> Column:
    """Towards zero, as an integer conversion does."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


@dataclass(frozen=True)
class Regular:
    bins: int
    low: float
    high: float

    def raw(self, v: Column) -> Column:
        return _trunc((v - self.low) / (self.high - self.low) * float(self.bins))

    def bin(self, v: Column) -> Column:
        return F.least(F.greatest(self.raw(v), F.lit(0)), F.lit(self.bins - 1)).cast("long")

    def range(self, v: Column, below: int, above: int) -> tuple[Column, Column]:
        """First and last bin of the neighbourhood in bins."""
        raw = self.raw(v)
        return F.greatest(raw - below, F.lit(0)).cast("long"), F.least(raw + above, F.lit(self.bins - 1)).cast("long")

    def range_by(self, v: Column, below: float, above: float) -> tuple[Column, Column]:
        """First and last bin of the neighbourhood in units of the axis."""
        return F.greatest(self.raw(v - below), F.lit(0)).cast("long"), F.least(self.raw(v + above), F.lit(self.bins - 1)).cast("long")

    def zone(self, v: Column, below: int, above: int) -> Column:
        lo, hi = self.range(v, below, above)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Circular:
    bins: int
    low: float
    high: float

    def raw(self, v: Column) -> Column:
        return F.floor((v - self.low) / (self.high - self.low) * float(self.bins)).cast("long")

    def remap(self, i: Column) -> Column:
        return F.pmod(i, F.lit(self.bins)).cast("long")

    def bin(self, v: Column) -> Column:
        return self.remap(self.raw(v))

    def zone(self, v: Column, below: int, above: int) -> Column:
        """Bins around that of ``v``; every bin once, however wide the neighbourhood."""
        raw = self.raw(v)
        return F.array_distinct(F.transform(F.sequence(raw - below, raw + above), self.remap))


@dataclass(frozen=True)
class Irregular:
    edges: tuple[float, ...]

    def bin(self, v: Column) -> Column:
        """The bin whose lower edge is the last one below ``v``, clamped to the axis."""
        below = sum((F.when(v > e, 1).otherwise(0) for e in self.edges), F.lit(0))
        return F.least(F.greatest(below - 1, F.lit(0)), F.lit(len(self.edges) - 2)).cast("long")


def serialize(first: Column, second: Column, first_bins: int) -> Column:
    return second * F.lit(first_bins) + first


def deserialize(serial: Column, first_bins: int) -> tuple[Column, Column]:
    second = F.floor(serial / F.lit(float(first_bins))).cast("long")
    return serial - second * F.lit(first_bins), second
