"""Selection of atoms and frames, and one grid per frame."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelflow.config import Config, FrameWindow, Selection
from voxelflow.functions.geometry import CELL, determinant, length

log = logging.getLogger("voxelflow")
TINY = 1e-8
LOOSE = 10.0  # a cell that many times the atoms' extent is no cell to grid


def window_frames(df: DataFrame, window: FrameWindow) -> DataFrame:
    """Rows of the frames in the window; the source prunes by the bounds."""
    out = df.where(F.col("frame") >= window.start)
    if window.stop is not None:
        out = out.where(F.col("frame") <= window.stop)
    stride = max(1, window.stride)
    return out if stride == 1 else out.where((F.col("frame") - window.start) % stride == 0)


def select_atoms(atoms: DataFrame, selection: Selection, topology: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Atoms that the selection names. ``strict`` refuses one that names none; else ranges beyond all atoms mean all atoms."""
    if selection.kind == "all":
        return atoms
    if selection.kind == "index":
        hit = F.lit(False)
        for low, high in selection.ranges:
            hit = hit | F.col("atom").between(low - 1, high - 1)
        chosen = atoms.where(hit)
        if chosen.limit(1).count() == 0:
            if strict:
                raise ValueError("no atom lies in the selected index ranges")
            return atoms
        return chosen
    if topology is None:
        raise ValueError("selection by name needs a topology")
    named = topology.where(F.col("name").isin(*selection.names))
    found = {r["name"] for r in named.select("name").distinct().collect()}
    for name in selection.names:
        if name not in found:
            log.warning("no atom is named %s", name)
    if not found:
        raise ValueError("no atom has a selected name")
    return atoms.join(named.select("atom"), "atom", "left_semi")


def grid_spec(atoms: DataFrame, frames: DataFrame, config: Config) -> DataFrame:
    """One row per frame: nx, ny, nz, origin ox, oy, oz, cell vectors, spacing, periodic."""
    s = config.spacing
    if config.box == "manual":
        x0, x1, y0, y1, z0, z1 = config.bounds
        size = (x1 - x0, y1 - y0, z1 - z0)
        if min(size) <= 0:
            raise ValueError("a manual box needs positive extents")
        cell = [size[0], 0.0, 0.0, 0.0, size[1], 0.0, 0.0, 0.0, size[2]]
        boxed = frames.select("frame", *[F.lit(o).alias(n) for o, n in zip((x0, y0, z0), ("ox", "oy", "oz"), strict=True)], *[F.lit(c).alias(n) for c, n in zip(cell, CELL, strict=True)])
    elif config.box == "cell":
        bad = (F.least(length("a"), length("b"), length("c")) < TINY) | (F.abs(determinant()) < TINY)
        boxed = frames.select(
            "frame",
            F.when(bad, F.raise_error(F.lit("the frame has no usable cell"))).otherwise(F.lit(0.0)).cast("double").alias("ox"),
            F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"), *CELL,
        )
    else:
        ranges = [f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
        extent = atoms.groupBy("frame").agg(*ranges)
        both = frames.select("frame", *CELL).join(extent, "frame", "left")
        lengths = [length(v) for v in "abc"]
        spans = [F.col(f"hi_{k}") - F.col(f"lo_{k}") for k in "xyz"]
        synthetic = F.lit(False)
        for one, span in zip(lengths, spans, strict=True):
            synthetic = synthetic | (one < TINY) | (one > LOOSE * span)
        diagonal = {"ax": 0, "by": 1, "cz": 2}
        boxed = both.select(
            "frame",
            *[F.when(synthetic, F.col(f"lo_{k}")).otherwise(0.0).alias(f"o{k}") for k in "xyz"],
            *[F.when(synthetic, spans[diagonal[c]] + 2 * s if c in diagonal else F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in CELL],
        )
    counts = [F.greatest(F.lit(1), F.ceil(length(v) / s)).cast("int").alias(n) for v, n in zip("abc", ("nx", "ny", "nz"), strict=True)]
    return boxed.select("frame", *counts, "ox", "oy", "oz", *CELL, F.lit(float(s)).alias("spacing"), F.lit(config.periodic).alias("periodic"))
