"""A whole run: trajectory to metrics, with every method on the same grid and voxels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from voxelflow.config import ClusterParams, Config, FrameWindow, effective_stride
from voxelflow.operators.cluster import cluster, method
from voxelflow.operators.grid import grid_spec, select_atoms, window_frames
from voxelflow.operators.lattice import seeds
from voxelflow.operators.metrics import metrics
from voxelflow.operators.voxelize import rasterize
from voxelflow.sources.trajectory import read_topology, read_trajectory


@dataclass(frozen=True)
class Run:
    """The tables of a run, all lazy; ``metrics`` has one row a frame."""

    grid: DataFrame
    voxels: DataFrame
    labels: DataFrame
    metrics: DataFrame

    def create_views(self, prefix: str = "run") -> None:
        for name in ("grid", "voxels", "labels", "metrics"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}_{name}")


def analyze(
    spark: SparkSession,
    path: str,
    config: Config,
    algorithm: str = "bls",
    params: ClusterParams | None = None,
    topology: str | None = None,
    window: FrameWindow | None = None,
    kind: str = "auto",
    replicate: int = 1,
    strict: bool = True,
    scale: float = 1.0,
) -> Run:
    atoms, frames = read_trajectory(spark, path, kind, scale)
    names = read_topology(spark, topology) if topology else None
    window = window or FrameWindow(stride=effective_stride(config))
    return analyze_tables(window_frames(atoms, window), window_frames(frames, window), config, algorithm, params, names, replicate, strict)


def analyze_tables(
    atoms: DataFrame,
    frames: DataFrame,
    config: Config,
    algorithm: str = "bls",
    params: ClusterParams | None = None,
    topology: DataFrame | None = None,
    replicate: int = 1,
    strict: bool = True,
) -> Run:
    name = method(algorithm)
    params = params or ClusterParams(connectivity=config.connectivity)
    chosen = select_atoms(atoms, config.selection, topology, strict)
    grid = grid_spec(chosen, frames, config).cache()
    voxels = rasterize(chosen, grid, config).cache()
    labels = cluster(voxels, name, params, grid, config.periodic, config)
    seeded = seeds(voxels, grid, config) if name == "bls" else None
    return Run(grid, voxels, labels, metrics(frames, grid, voxels, labels, config, name, seeded, replicate))
