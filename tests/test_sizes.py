"""Methods on frames so large that steps quadratic in a frame would not end, and the same methods against plain versions on small ones."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracles as o
from voxelflow.functions.statistics import kendall_tau
from voxelflow.operators import components as parts
from voxelflow.operators import kernels
from voxelflow.operators.compare import compare_runs
from voxelflow.operators.components import Cells, components


def plain_tau(a, b):
    n, sign = min(len(a), len(b)), lambda d: (d > 0) - (d < 0)
    found = [sign(a[p] - a[q]) * sign(b[p] - b[q]) for p in range(n) for q in range(p + 1, n)]
    untied = [s for s in found if s]
    return sum(untied) / len(untied) if untied else 1.0


def test_tau_is_that_of_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(top) for _ in range(rng.randrange(30))] for top in (rng.choice([2, 6, 90]), rng.choice([2, 6, 90])))
        assert kendall_tau(a, b) == plain_tau(a, b)
    assert kendall_tau([3, None, 2, 1], [1, 7, 2, 3]) == -1


def test_comparison_of_many_clusters(spark):
    sizes = F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: (x * 7919 % 97).cast("int")), asc=False)
    run = spark.range(2).select(F.col("id").alias("frame"), F.lit(96).alias("max_cluster"), F.lit(60_000).alias("nclusters"), F.lit(1.0).alias("elapsed_ms"), sizes.alias("cluster_sizes"))
    start = time.perf_counter()
    assert compare_runs(run, run).first().mean_tau == 1.0
    assert time.perf_counter() - start < 60


def wide_frame(planes, seed):
    """A frame like those of the tables: dense at low k, thin above, many planes along i."""
    rng = np.random.default_rng(seed)
    n = 14 * planes
    k = np.minimum(rng.exponential(2.5, n).astype(int), 27)
    return Cells(np.stack([rng.integers(0, planes, n), rng.integers(0, 24, n), k], axis=1))


@pytest.mark.parametrize("seed", range(12))
def test_hdbscan_with_far_voxels_is_the_complete_graphs(seed):
    rng = random.Random(seed)
    voxels = {(rng.randrange(5) + 30 * rng.randrange(2), rng.randrange(5), rng.randrange(4)) for _ in range(70)} | {(90, 0, 70), (200, 5, 5)}
    min_samples, min_size = rng.randint(2, 6), rng.randint(1, 6)
    c = Cells(np.array(sorted(voxels)))
    labels = kernels.hdbscan(c, min_samples, min_size)
    got = {frozenset(map(tuple, c.ijk[labels == x].tolist())) for x in set(labels.tolist()) - {-1}}
    assert got == o.hdbscan_levels(sorted(voxels), min_samples, min_size, None)


def test_hdbscan_of_a_large_frame():
    c = wide_frame(5000, 1)
    start = time.perf_counter()
    labels = kernels.hdbscan(c, 5, 5)
    assert len(c) > 50_000 and labels.max() > 0
    assert time.perf_counter() - start < 30


def nearest_to_centres(cells, s):
    """Per occupied cell the voxel nearest to its centre, the first of equally near ones, by trying all."""
    found = set()
    for corner in np.unique(cells.ijk // s, axis=0) * s:
        d = np.abs(2 * (cells.ijk - corner) - (s - 1))
        if cells.dims is not None:
            d = np.minimum(d, np.abs(2 * cells.dims - d))
        found.add(int((d * d).sum(axis=1).argmin()))
    return sorted(found)


@pytest.mark.parametrize("seed", range(8))
def test_supervoxel_seeds_are_those_of_all_voxels(seed):
    rng = random.Random(seed)
    dims, s = (7, 6, 9), rng.randint(1, 5)
    voxels = np.array([v for v in np.ndindex(*dims) if rng.random() < 0.5])
    for c in (Cells(voxels), Cells(voxels, dims)):
        candidates, kept = kernels.supervoxel_seeds(c, s)
        assert candidates.tolist() == nearest_to_centres(c, s)
        assert kept.tolist() == [v for v in candidates if (4 * kernels.squared(c, c.ijk, c.ijk[v]) <= s * s).sum() >= np.pi * (s / 2) ** 2]


def test_supervoxels_of_a_large_frame():
    c = wide_frame(5000, 2)
    start = time.perf_counter()
    assert (kernels.vccs_optimized(c, 3.0) >= 0).all()
    assert time.perf_counter() - start < 15


def test_components_across_cubes(spark, monkeypatch):
    monkeypatch.setattr(parts, "CUBE", 4)
    rng = random.Random(8)
    cells = {(f, rng.randrange(-3, 14), rng.randrange(13), rng.randrange(11)) for f in range(2) for _ in range(700)}
    voxels = spark.createDataFrame(sorted(cells), "frame long, i int, j int, k int")
    for connectivity in (6, 26):
        want = sorted(map(tuple, components(voxels, connectivity).collect()))
        assert sorted(map(tuple, components(voxels, connectivity, strategy="distributed").collect())) == want
    wrapped = voxels.where("i >= 0")
    grid = spark.createDataFrame([(f, 14, 13, 11) for f in range(2)], "frame long, nx int, ny int, nz int")
    want = sorted(map(tuple, components(wrapped, 18, grid).collect()))
    assert sorted(map(tuple, components(wrapped, 18, grid, "distributed").collect())) == want


def test_only_edges_between_cubes_are_spread(spark):
    solid = spark.createDataFrame([(0, i, j, k) for i in range(40) for j in range(8) for k in range(8)], "frame long, i int, j int, k int")
    local = parts.cube_components(solid, 26)
    assert local.select("own").distinct().count() == 2
    edges = parts.cube_edges(local, 26)
    assert edges.count() == 1
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
