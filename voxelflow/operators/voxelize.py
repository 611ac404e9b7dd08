"""Rasterisation of atoms to a sparse set of occupied voxels."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelflow.config import Config
from voxelflow.functions.geometry import CELL, INVERSE, inverse_columns

MARGIN = 1e-9
AXES = ("x", "y", "z")
COUNTS = ("nx", "ny", "nz")


def _corner() -> Column:
    """Largest half diagonal of one voxel of the cell."""
    found = []
    for signs in itertools.product((1, -1), repeat=2):
        parts = []
        for k in AXES:
            v = F.col(f"a{k}") / F.col("nx") + signs[0] * F.col(f"b{k}") / F.col("ny") + signs[1] * F.col(f"c{k}") / F.col("nz")
            parts.append(v * v)
        found.append(F.sqrt(parts[0] + parts[1] + parts[2]) / 2)
    return F.greatest(*found)


def _inverse_row(r: int) -> Column:
    return F.sqrt(sum((F.col(f"i{r}{c}") * F.col(f"i{r}{c}") for c in range(3)), F.lit(0.0)))


def rasterize(atoms: DataFrame, grid: DataFrame, config: Config) -> DataFrame:
    """(frame, i, j, k, lin) of occupied voxels, each once.

    ANY marks voxels whose centre lies within cutoff plus the voxel's largest half diagonal of an atom, ALL those
    within cutoff minus it; a cutoff of 0 under ANY marks the atom's own voxel. Periodic atoms and voxels wrap;
    others outside the grid are dropped. The grid is one row a frame and is read with its geometry worked out once.
    """
    wide = grid.select("*", *inverse_columns()).withColumn("corner", _corner())
    radius = F.lit(config.cutoff) + F.col("corner") + MARGIN if config.occupancy == "any" else F.lit(config.cutoff) - F.col("corner") - MARGIN
    wide = wide.withColumn("radius", radius)
    for r in range(3):
        wide = wide.withColumn(f"reach{r}", F.col("radius") * _inverse_row(r) + MARGIN)
    at = atoms.select("frame", "x", "y", "z").join(wide, "frame")
    shifted = [F.col(k) - F.col(f"o{k}") for k in AXES]
    for r in range(3):
        f = sum((F.col(f"i{r}{c}") * shifted[c] for c in range(3)), F.lit(0.0))
        at = at.withColumn(f"f{r}", F.when(F.col("periodic"), f - F.floor(f)).otherwise(f))
    for r, n in enumerate(COUNTS):
        base = F.floor(F.col(f"f{r}") * F.col(n))
        at = at.withColumn(f"b{r}_", F.when(F.col("periodic"), F.least(base, F.col(n) - 1)).otherwise(base).cast("long"))
    if config.cutoff <= 0 and config.occupancy == "any":
        marked = at.select("frame", "periodic", *COUNTS, *[F.col(f"b{r}_").alias(f"v{r}") for r in range(3)])
    else:
        # The atom's wrapped place, as a fractional coordinate times the cell; distances use unwrapped centres.
        for c, k in enumerate(AXES):
            place = sum((F.col(f"{v}{k}") * F.col(f"f{r}") for r, v in enumerate("abc")), F.lit(0.0))
            at = at.withColumn(f"p{c}", place)
        at = at.where("radius >= 0")
        for r in range(3):
            # Voxel centres between the two planes of this axis that lie a radius from the atom.
            low, high = (F.col(f"f{r}") + sign * F.col(f"reach{r}") for sign in (-1, 1))
            at = at.withColumn(f"lo{r}", F.ceil(low * F.col(COUNTS[r]) - 0.5)).withColumn(f"hi{r}", F.floor(high * F.col(COUNTS[r]) - 0.5))
            if not config.periodic:
                at = at.withColumn(f"lo{r}", F.greatest(F.col(f"lo{r}"), F.lit(0))).withColumn(f"hi{r}", F.least(F.col(f"hi{r}"), F.col(COUNTS[r]) - 1))
            at = at.where(F.col(f"lo{r}") <= F.col(f"hi{r}")).withColumn(f"v{r}", F.explode(F.sequence(f"lo{r}", f"hi{r}")))
        middle = [(F.col(f"v{r}") + 0.5) / F.col(n) for r, n in enumerate(COUNTS)]
        apart = []
        for c, k in enumerate(AXES):
            d = sum((F.col(f"{v}{k}") * middle[r] for r, v in enumerate("abc")), F.lit(0.0)) - F.col(f"p{c}")
            apart.append(d * d)
        marked = at.where(F.sqrt(apart[0] + apart[1] + apart[2]) <= F.col("radius"))
        marked = marked.select("frame", "periodic", *COUNTS, "v0", "v1", "v2")
    inside = F.lit(True)
    for r, n in enumerate(COUNTS):
        inside = inside & F.col(f"v{r}").between(0, F.col(n) - 1)
    kept = marked.where(F.col("periodic") | inside)
    index = [F.pmod(F.col(f"v{r}"), F.col(n)).cast("int").alias(name) for r, (n, name) in enumerate(zip(COUNTS, "ijk", strict=True))]
    cells = kept.select("frame", *index, "ny", "nz").distinct()
    return cells.select("frame", "i", "j", "k", ((F.col("i").cast("long") * F.col("ny") + F.col("j")) * F.col("nz") + F.col("k")).alias("lin"))


__all__ = ["CELL", "INVERSE", "rasterize"]
