"""Cell geometry as Column builders and, for constants, as plain Python on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = ("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")
INVERSE = tuple(f"i{r}{c}" for r in range(3) for c in range(3))


def cell_vectors(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> tuple[tuple[float, float, float], ...]:
    """The three cell vectors of lengths and angles in degrees; the first lies on x, the second in the xy plane."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    rest = c * c - cx * cx - cy * cy
    return (a, 0.0, 0.0), (b * cg, b * sg, 0.0), (cx, cy, math.sqrt(rest) if rest > 0 else 0.0)


def cell_columns(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> list[Column]:
    """``cell_vectors`` over columns, as nine columns named by ``CELL``."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    rest = c * c - cx * cx - cy * cy
    zero = F.lit(0.0)
    made = [a, zero, zero, b * cg, b * sg, zero, cx, cy, F.when(rest > 0, F.sqrt(rest)).otherwise(zero)]
    return [m.alias(n) for m, n in zip(made, CELL, strict=True)]


def determinant() -> Column:
    ax, ay, az, bx, by, bz, cx, cy, cz = map(F.col, CELL)
    return ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)


def inverse_columns() -> list[Column]:
    """Rows of the inverse of the matrix whose columns are the cell vectors, as nine columns named by ``INVERSE``."""
    ax, ay, az, bx, by, bz, cx, cy, cz = map(F.col, CELL)
    d = determinant()
    cofactors = [
        by * cz - bz * cy, bz * cx - bx * cz, bx * cy - by * cx,
        az * cy - ay * cz, ax * cz - az * cx, ay * cx - ax * cy,
        ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx,
    ]
    checked = F.when(F.abs(d) < 1e-12, F.raise_error(F.lit("singular cell"))).otherwise(d)
    return [(x / checked).alias(n) for x, n in zip(cofactors, INVERSE, strict=True)]


def length(axis: str) -> Column:
    x, y, z = (F.col(f"{axis}{k}") for k in "xyz")
    return F.sqrt(x * x + y * y + z * z)


def round_half_away(x: float) -> int:
    """Nearest integer, halves away from zero, exact for every double; Spark's ``round`` is the same."""
    whole = math.trunc(x)
    if abs(x) >= 2.0**52:
        return int(whole)
    part = x - whole
    return whole + (1 if part >= 0.5 else -1 if part <= -0.5 else 0)


def wrap(index: Column, n: Column) -> Column:
    return F.pmod(index, n)


def minimum_image(distance: Column, n: Column) -> Column:
    """Least absolute difference of two grid indices on an axis of ``n`` voxels."""
    return F.least(F.abs(distance), n - F.abs(distance))


def invert(m: list[list[float]]) -> list[list[float]]:
    """Inverse of a 3x3 matrix given by rows."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if abs(det) < 1e-12:
        raise ValueError("singular cell")
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]
