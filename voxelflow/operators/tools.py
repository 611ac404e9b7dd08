"""Derived analyses: detection over shifted lattices, a fixed cell for such sweeps, and supervoxel seed counts."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelflow.config import Config, ConfigError
from voxelflow.functions.statistics import diagonal, halton
from voxelflow.operators.compare import recall_by_size, size_floor
from voxelflow.operators.components import Cells, components
from voxelflow.operators.kernels import resolution, supervoxel_seeds
from voxelflow.operators.lattice import lattice_clusters, scaled_basis, seeds

PAD_VOXELS = 10  # free voxels on each side of the atoms
ROOM_VOXELS = 7  # and room on top, so that shifted grids still hold them


def fixed_cell(atoms: DataFrame, spacing: float) -> tuple[float, ...]:
    """Manual bounds around all atoms of all frames, whole voxels wide, so that every shift sees the same grid."""
    r = atoms.agg(*[f(k).alias(f"{n}{k}") for k in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bounds = []
    for k in "xyz":
        low = r[f"lo{k}"] - PAD_VOXELS * spacing
        voxels = math.ceil((r[f"hi{k}"] - r[f"lo{k}"]) / spacing) + 2 * PAD_VOXELS + ROOM_VOXELS
        bounds += [low, low + voxels * spacing]
    return tuple(bounds)


def shifted(config: Config, offsets: list[tuple[float, float, float]]) -> list[Config]:
    """The configuration once per lattice origin; offsets are fractions of the lattice's edges."""
    basis = scaled_basis(config)
    return [replace(config, lattice_origin=tuple(sum(o[v] * basis[v][k] for v in range(3)) for k in range(3))) for o in offsets]


def offset_set(config: Config, name: str) -> list[Config]:
    """The configuration at every origin of a named set: ``halton64`` over the lattice's cell, ``diagonal8`` in whole voxels."""
    if name == "halton64":
        return shifted(config, halton(64))
    if name == "diagonal8":
        return [replace(config, lattice_origin=o) for o in diagonal(8)]
    raise ConfigError(f"no offset set named {name}")


def offset_sweep(voxels: DataFrame, grid: DataFrame, config: Config, offsets: list[tuple[float, float, float]] | str) -> DataFrame:
    """(offset, size, present, missed, recall): the true components are found once and met by every shifted lattice."""
    configs = offset_set(config, offsets) if isinstance(offsets, str) else shifted(config, offsets)
    truth = components(voxels, config.connectivity, grid if config.periodic else None).cache()
    runs = []
    for n, c in enumerate(configs):
        found = lattice_clusters(truth, seeds(voxels, grid, c))
        runs.append(recall_by_size(size_floor(truth, found)).withColumn("offset", F.lit(n)))
    return reduce(DataFrame.unionByName, runs).select("offset", "size", "present", "missed", "recall")


def recall(sweep: DataFrame) -> DataFrame:
    """(offset, present, detected, recall); -1 where there is nothing to detect."""
    out = sweep.groupBy("offset").agg(F.sum("present").alias("present"), F.sum(F.col("present") - F.col("missed")).alias("detected"))
    return out.withColumn("recall", F.when(F.col("present") > 0, F.col("detected") / F.col("present")).otherwise(-1.0))


def supervoxel_probe(voxels: DataFrame, eps: float) -> DataFrame:
    """(frame, occupied, candidates, seeds, threshold, kept_share, seeds_per_voxel) of the published supervoxel seeding."""
    s = resolution(eps)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(rows[["i", "j", "k"]].to_numpy())
        candidates, kept = supervoxel_seeds(cells, s)
        return pd.DataFrame({"frame": [rows["frame"].iloc[0]], "occupied": [len(cells)], "candidates": [len(candidates)], "seeds": [len(kept)], "threshold": [np.pi * (s / 2) ** 2], "kept_share": [len(kept) / max(1, len(candidates))], "seeds_per_voxel": [len(kept) / max(1, len(cells))]})

    return voxels.select("frame", "i", "j", "k").groupBy("frame").applyInPandas(run, "frame long, occupied long, candidates long, seeds long, threshold double, kept_share double, seeds_per_voxel double")
