"""All clustering methods under their names, and the per-frame results made from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelflow.config import ClusterParams, Config
from voxelflow.operators import kernels
from voxelflow.operators.components import components, per_frame
from voxelflow.operators.lattice import lattice_clusters, seeds

# Method names and their aliases.
METHODS = ("bls", "traditional_dfs", "skip_dfs", "dbscan", "hierarchical", "kmeans", "gcbd", "hdbscan", "cc3d", "cc3d_optimized", "rle_ccl", "rle_ccl_optimized", "vccs", "vccs_optimized")
ALIASES = {
    "default": "bls", "dfs": "traditional_dfs", "traditional": "traditional_dfs", "skipdfs": "skip_dfs", "skip": "skip_dfs",
    "single_linkage": "hierarchical", "k-means": "kmeans", "k_means": "kmeans", "union_find": "gcbd", "uf": "gcbd",
    "cc3d_basic": "cc3d", "cc3d_opt": "cc3d_optimized", "rleccl": "rle_ccl", "rle": "rle_ccl",
    "rleccloptimized": "rle_ccl_optimized", "vccsoptimized": "vccs_optimized",
}
PERIODIC = {"bls", "traditional_dfs", "skip_dfs", "gcbd", "cc3d_optimized", "rle_ccl_optimized", "vccs_optimized", "dbscan", "hdbscan"}
EXACT6 = {"traditional_dfs", "gcbd", "rle_ccl", "rle_ccl_optimized"}


def method(name: str) -> str:
    lower = name.lower()
    lower = ALIASES.get(lower, lower)
    if lower not in METHODS:
        raise ValueError(f"unknown clustering method {name}")
    return lower


def cluster(voxels: DataFrame, name: str, params: ClusterParams | None = None, grid: DataFrame | None = None, periodic: bool = False, config: Config | None = None) -> DataFrame:
    """(frame, i, j, k, label) of clustered voxels; noise is left out. Periodic frames need ``grid``, ``bls`` also a config."""
    name, params = method(name), params or ClusterParams()
    if periodic and name not in PERIODIC:
        raise ValueError(f"{name} has no periodic form")
    axes = grid if periodic else None
    if name == "bls":
        return lattice_clusters(components(voxels, config.connectivity, axes), seeds(voxels, grid, config))
    if name in EXACT6:
        return components(voxels, 6, axes)
    if name in ("cc3d", "cc3d_optimized"):
        return components(voxels, 26 if params.connectivity == 26 else 6, axes)
    if name == "kmeans" and params.k < 1 or name == "skip_dfs" and params.skip < 1:
        raise ValueError(f"{name}: parameter below 1")
    p = params
    kernel = {
        "skip_dfs": lambda c: kernels.skip_dfs(c, p.skip),
        "dbscan": lambda c: kernels.dbscan(c, p.eps, p.min_pts),
        "hierarchical": lambda c: kernels.single_linkage(c, p.threshold),
        "kmeans": lambda c: kernels.kmeans(c, p.k),
        "hdbscan": lambda c: kernels.hdbscan(c, p.min_samples, p.min_cluster_size),
        "vccs": lambda c: kernels.vccs(c, p.eps),
        "vccs_optimized": lambda c: kernels.vccs_optimized(c, p.eps),
    }[name]
    return per_frame(voxels, kernel, axes)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(frame, label, size)."""
    return labels.groupBy("frame", "label").agg(F.count(F.lit(1)).cast("int").alias("size"))


def summarize(labels: DataFrame) -> DataFrame:
    """(frame, nclusters, max_cluster, refined_voxels, cluster_sizes): the sizes are in descending order."""
    return cluster_sizes(labels).groupBy("frame").agg(
        F.count(F.lit(1)).cast("int").alias("nclusters"),
        F.max("size").alias("max_cluster"),
        F.sum("size").alias("refined_voxels"),
        F.sort_array(F.collect_list("size"), asc=False).alias("cluster_sizes"),
    )


def size_histogram(labels: DataFrame) -> DataFrame:
    """(size, clusters) over all frames."""
    return cluster_sizes(labels).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))
