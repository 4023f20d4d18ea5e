"""Three-component vectors as tuples of columns, and cell arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """The columns ``{prefix}x{suffix}``, y and z as doubles."""
    return tuple(F.col(f"{prefix}{a}{suffix}").cast("double") for a in "xyz")


def const(*values: float) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s: Column) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cell(value: Column | str, size: float) -> Column:
    """The integer cell of a coordinate: floor(value / size); negative below zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value.cast("double") / F.lit(float(size))).cast("long")


def cells(shape: tuple[float, float, float], names: str = "g") -> dict[str, Column]:
    """Cell columns ``gx, gy, gz`` (or another first letter) of x, y, z."""
    return {f"{names}{a}": cell(a, s) for a, s in zip("xyz", shape, strict=True)}


def half_even(value: Column) -> Column:
    """Rounding with ties to the even integer."""
    return F.bround(value).cast("long")
