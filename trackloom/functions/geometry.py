"""Conformal map, three-point estimates and local coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uv_transform(x: Column, y: Column) -> tuple[Column, Column]:
    """Circles through the origin become lines; null at the origin."""
    d = F.nullif(x * x + y * y, F.lit(0.0))
    return x / d, y / d


def three_point_curvature(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Signed curvature of the circle through three points: four times their area over the product of the sides."""
    area2 = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
    side = lambda a, b, c, d: F.sqrt((a - c) * (a - c) + (b - d) * (b - d))
    return 2 * area2 / F.nullif(side(x1, y1, x2, y2) * side(x2, y2, x3, y3) * side(x1, y1, x3, y3), F.lit(0.0))


def local_coordinate(index: int, loc0: Column, loc1: Column, first_axis: Column) -> Column:
    """Coordinate ``index`` of a measurement whose first value belongs to axis ``first_axis`` (0 or 1)."""
    straight, swapped = (loc0, loc1) if index == 0 else (loc1, loc0)
    return F.when(first_axis == 0, straight).otherwise(swapped)


def same_measurement(a: str, b: str, uncertainty: float) -> Column:
    """Equality of two measurements (struct columns): the surface exactly, positions and variances relatively."""
    out = F.col(f"{a}.surface_link") == F.col(f"{b}.surface_link")
    for c in ("loc0", "loc1", "var0", "var1"):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = out & (F.abs(x - y) <= F.lit(uncertainty) * ((F.abs(x) + F.abs(y)) / 2))
    return out
