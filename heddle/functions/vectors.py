"""Vectors as arrays of doubles, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this, so that a zero vector stays zero.
LEAST_NORM = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda done, x: done + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalised(v: Column) -> Column:
    """A null component stays null and adds nothing to the norm; a zero keeps its sign."""
    norm = F.greatest(F.sqrt(total(F.transform(v, lambda x: F.coalesce(x * x, F.lit(0.0))))), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x / norm)


def six_digits(x: Column) -> Column:
    """A double to six digits, half away from zero; unlike with Spark's `round`, a zero keeps the sign of `x`, as in DuckDB."""
    near = F.signum(x) * F.round(F.abs(x) * 1e6) / 1e6
    return F.when(F.abs(x * 1e6) < float("inf"), near).otherwise(x)


def patch_x(patch_id: Column, side: int) -> Column:
    """The horizontal place of a patch in [0, 1]; rows of patches run along x."""
    return (patch_id % side) / F.lit(float(max(1, side - 1)))


def patch_y(patch_id: Column, side: int) -> Column:
    return F.floor(patch_id / side) / F.lit(float(max(1, side - 1)))


def grid_side(patch_count: int) -> int:
    side = round(patch_count**0.5)
    if side < 1 or side * side != patch_count:
        raise ValueError(f"{patch_count} patches are no square grid")
    return side
