"""The result row of a frame, in the column order of the metrics file, and occupancy fingerprints."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelflow.config import Config
from voxelflow.functions.statistics import occupancy_sha256
from voxelflow.operators.cluster import summarize
from voxelflow.operators.lattice import probe_counts

# The columns of the metrics file, in order.
COLUMNS = (
    "frame", "time_ps", "natoms", "NX", "NY", "NZ", "dNN_vox", "lattice", "centering", "seeds", "seed_hits", "nclusters", "max_cluster",
    "refined_voxels", "elapsed_ms", "replicate", "total_ms", "h_x", "h_y", "h_z", "origin_x", "origin_y", "origin_z", "pbc", "occ_sha256",
    "probes", "clear_ms", "probe_ms", "refine_ms", "refinement",
)


def fingerprints(voxels: DataFrame, grid: DataFrame) -> DataFrame:
    """(frame, occ_sha256) of every frame of the grid that has a voxel."""
    placed = voxels.select("frame", "lin").join(grid.select("frame", (F.col("nx").cast("long") * F.col("ny") * F.col("nz")).alias("total")), "frame")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame": [rows["frame"].iloc[0]], "occ_sha256": [occupancy_sha256(rows["lin"].to_numpy(), int(rows["total"].iloc[0]))]})

    return placed.groupBy("frame").applyInPandas(run, "frame long, occ_sha256 string")


def metrics(frames: DataFrame, grid: DataFrame, voxels: DataFrame, labels: DataFrame, config: Config, method: str, seed_voxels: DataFrame | None = None, replicate: int = 1) -> DataFrame:
    """One row per frame with ``COLUMNS`` and cluster_sizes. Stage times are not kept apart here: they are null, as is elapsed time."""
    per = summarize(labels)
    out = frames.select("frame", "time_ps", "natoms").join(grid, "frame").join(per, "frame", "left").join(fingerprints(voxels, grid), "frame", "left")
    lattice = method == "bls"
    if lattice:
        seeded = seed_voxels.groupBy("frame").agg(F.count(F.lit(1)).cast("int").alias("seeds"))
        out = out.join(seeded, "frame", "left")
        out = out.join(probe_counts(config, grid.select("nx", "ny", "nz").distinct()), ["nx", "ny", "nz"])
    else:
        out = out.withColumns({"seeds": F.lit(0), "probes": F.lit(0).cast("long"), "dNN_vox": F.lit(0.0)})
    steps = {f"h_{k}": F.sqrt(sum((F.col(f"{v}{c}") * F.col(f"{v}{c}") for c in "xyz"), F.lit(0.0))) / F.col(n) for k, v, n in zip("xyz", "abc", ("nx", "ny", "nz"), strict=True)}
    unknown = F.lit(None).cast("double")
    values = {
        "NX": F.col("nx"), "NY": F.col("ny"), "NZ": F.col("nz"),
        "lattice": F.lit(config.lattice.kind if lattice else method), "centering": F.lit(config.lattice.centering if lattice else "-"),
        "seeds": F.coalesce("seeds", F.lit(0)), "seed_hits": F.coalesce("nclusters", F.lit(0)) if lattice else F.lit(0),
        "nclusters": F.coalesce("nclusters", F.lit(0)), "max_cluster": F.coalesce("max_cluster", F.lit(0)),
        "refined_voxels": F.coalesce("refined_voxels", F.lit(0)), "elapsed_ms": unknown, "replicate": F.lit(replicate), "total_ms": unknown,
        **steps, "origin_x": F.col("ox"), "origin_y": F.col("oy"), "origin_z": F.col("oz"),
        "pbc": F.when(F.col("periodic"), "xyz").otherwise("none"), "clear_ms": unknown, "probe_ms": unknown, "refine_ms": unknown,
        "refinement": F.lit(config.refinement if lattice else "n/a"),
    }
    chosen = [(values[c] if c in values else F.col(c)).alias(c) for c in COLUMNS]
    return out.select(*chosen, F.coalesce("cluster_sizes", F.array().cast("array<int>")).alias("cluster_sizes"))


def number_text(x: float | None) -> str:
    """A double with six significant digits, as text files of results have it; nothing measured is ``nan``."""
    return "nan" if x is None or math.isnan(x) else f"{x:.6g}"
