import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import oracles as o
from voxelflow.config import ClusterParams
from voxelflow.operators import kernels
from voxelflow.operators.cluster import METHODS, cluster, method, summarize
from voxelflow.operators.components import Cells, component_labels, components

VOXELS = "frame long, i int, j int, k int"


def labelled(cells, labels):
    return o.from_labels([(*v, x) for v, x in zip(cells.ijk.tolist(), labels, strict=True) if x >= 0])


def cells_of(voxels, dims=None):
    return Cells(np.array(sorted(voxels)).reshape(-1, 3), dims)


def random_grid(rng, dims=None, share=None):
    dims = dims or tuple(rng.randint(1, 6) for _ in range(3))
    share = share or rng.choice([0.05, 0.2, 0.3116, 0.5, 0.9])
    return dims, [v for v in np.ndindex(*dims) if rng.random() < share]


SHAPES = {
    "empty": [], "single": [(0, 0, 0)], "full": o.boxes(((0, 0, 0), (3, 3, 3))), "plane": o.boxes(((0, 2, 0), (4, 2, 4))),
    "diagonal": [(t, t, t) for t in range(5)], "corner contact": [(0, 0, 0), (1, 1, 0)], "opposite corners": [(0, 0, 0), (1, 1, 1)],
    "two cubes": o.boxes(((2, 2, 2), (4, 4, 4)), ((6, 6, 6), (8, 8, 8))), "comb": [(0, 0, t) for t in range(0, 64, 2)],
    "checkerboard": [v for v in np.ndindex(4, 4, 4) if sum(v) % 2], "u": o.boxes(((0, 0, 0), (4, 0, 0)), ((0, 1, 0), (0, 4, 0)), ((4, 1, 0), (4, 4, 0))),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_of_shapes(name, connectivity):
    c = cells_of(SHAPES[name])
    assert labelled(c, component_labels(c, connectivity)) == o.components(SHAPES[name], connectivity)


@pytest.mark.parametrize("seed", range(60))
def test_components_of_random_grids(seed):
    rng = random.Random(seed)
    dims, voxels = random_grid(rng)
    for connectivity in (6, 18, 26):
        for periodic in (None, dims):
            c = cells_of(voxels, periodic)
            assert labelled(c, component_labels(c, connectivity)) == o.components(voxels, connectivity, periodic)


@given(st.sets(st.tuples(*[st.integers(0, 5)] * 3), max_size=60))
@settings(max_examples=60, deadline=None)
def test_labels_are_dense_and_in_raster_order(voxels):
    c = cells_of(voxels)
    labels = component_labels(c, 6)
    first = [int(np.flatnonzero(labels == x)[0]) for x in range(labels.max(initial=-1) + 1)]
    assert first == sorted(first) and set(labels.tolist()) == set(range(len(first)))


@pytest.mark.parametrize("seed", range(30))
def test_reductions_to_components(seed):
    dims, voxels = random_grid(random.Random(seed))
    for periodic in (None, dims):
        c = cells_of(voxels, periodic)
        want = o.components(voxels, 6, periodic)
        assert labelled(c, kernels.skip_dfs(c, 1)) == want
        assert labelled(c, kernels.dbscan(c, 1.0, 1)) == want
        assert labelled(c, kernels.single_linkage(c, 1.3)) == want


@pytest.mark.parametrize("seed", range(40))
def test_dbscan_is_the_textbooks(seed):
    rng = random.Random(seed)
    dims, voxels = random_grid(rng)
    eps, min_pts = rng.choice([1.0, 1.5, 2.0, 3.0]), rng.randint(1, 9)
    for periodic in (None, dims):
        c = cells_of(voxels, periodic)
        assert labelled(c, kernels.dbscan(c, eps, min_pts)) == o.dbscan(voxels, eps, min_pts, periodic)


def test_dbscan_cube_and_chain():
    voxels = o.boxes(((0, 0, 0), (4, 4, 4)), ((5, 2, 2), (8, 2, 2)))
    c = cells_of(voxels)
    assert labelled(c, kernels.dbscan(c, 1.0, 7)) == o.dbscan(voxels, 1.0, 7)


@pytest.mark.parametrize("seed", range(25))
def test_hdbscan_is_the_complete_graphs(seed):
    rng = random.Random(seed)
    dims, voxels = random_grid(rng, (5, 5, 4), rng.choice([0.1, 0.25, 0.4]))
    min_samples, min_size = rng.randint(2, 5), rng.randint(1, 5)
    for periodic in (None, dims):
        c = cells_of(voxels, periodic)
        labels = kernels.hdbscan(c, min_samples, min_size) if len(c) else np.zeros(0, int)
        got = {frozenset(map(tuple, c.ijk[labels == x].tolist())) for x in set(labels.tolist()) - {-1}}
        assert got == (o.hdbscan_levels(voxels, min_samples, min_size, periodic) if voxels else set())


def test_hdbscan_known_cases():
    blobs = [((a, b, 0), (a + 2, b + 2, 2)) for a, b in ((0, 0), (12, 0), (0, 12), (12, 12), (24, 24))]
    c = cells_of(o.boxes(*blobs))
    labels = kernels.hdbscan(c, 5, 5)
    assert sorted(np.bincount(labels).tolist()) == [27] * 5
    assert (kernels.hdbscan(cells_of(o.boxes(blobs[0])), 5, 5) == -1).all()
    assert len(kernels.hdbscan(cells_of([(0, 0, 0)]), 2, 1)) == 1
    with pytest.raises(ValueError):
        kernels.hdbscan(c, 1, 5)
    plus = [(1, 1, 1), (0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1)]
    two = cells_of(plus + [(x + 6, y, z) for x, y, z in plus])
    assert sorted(np.bincount(kernels.hdbscan(two, 2, 2)).tolist()) == [5, 5]


def test_kmeans_fixed_point_and_errors():
    voxels = o.boxes(((0, 0, 0), (2, 2, 2)), ((20, 0, 0), (22, 2, 2)))
    c = cells_of(voxels)
    assert sorted(np.bincount(kernels.kmeans(c, 2)).tolist()) == [27, 27]
    assert len(set(kernels.kmeans(c, 500).tolist())) == len(voxels)
    assert len(kernels.kmeans(cells_of([]), 0)) == 0
    with pytest.raises(ValueError):
        kernels.kmeans(c, 0)


def test_skip_walk_bridges_gaps():
    c = cells_of([(0, 0, 0), (3, 0, 0), (9, 0, 0)])
    assert kernels.skip_dfs(c, 3).tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        kernels.skip_dfs(c, 0)


@pytest.mark.parametrize("seed", range(15))
def test_supervoxels_cover_and_refine_components(seed):
    dims, voxels = random_grid(random.Random(seed), (8, 7, 9), 0.45)
    for kernel, connectivity in ((kernels.vccs, 6), (kernels.vccs_optimized, 26)):
        c = cells_of(voxels)
        labels = kernel(c, 3.0)
        assert (labels >= 0).all()
        truth = o.components(voxels, connectivity)
        for x in set(labels.tolist()):
            assert len({truth[tuple(v)] for v in c.ijk[labels == x].tolist()}) == 1
        assert (kernel(c, 3.0) == labels).all()


def test_supervoxel_diagonal_is_one_cluster():
    c = cells_of([(t, t, t) for t in range(2, 9)])
    assert set(kernels.vccs_optimized(c, 12.0).tolist()) == {0}


@pytest.mark.parametrize("roll", [(1, 0, 0), (2, 3, 1)])
def test_periodic_methods_do_not_mind_where_the_cell_starts(roll):
    dims, voxels = random_grid(random.Random(3), (6, 5, 4), 0.3)
    moved = [tuple((x + r) % n for x, r, n in zip(v, roll, dims, strict=True)) for v in voxels]
    for run in (lambda c: component_labels(c, 6), lambda c: kernels.hdbscan(c, 3, 3), lambda c: kernels.single_linkage(c, 2.0)):
        sizes = [sorted(np.bincount(x[x >= 0]).tolist()) for x in (run(cells_of(v, dims)) for v in (voxels, moved))]
        assert sizes[0] == sizes[1]


def test_strategies_agree_on_spark(spark):
    rng = random.Random(11)
    frames = {f: random_grid(rng, (6, 6, 6), 0.3)[1] for f in range(4)}
    rows = spark.createDataFrame([(f, *map(int, v)) for f, vs in frames.items() for v in vs], VOXELS)
    grid = spark.createDataFrame([(f, 6, 6, 6) for f in frames], "frame long, nx int, ny int, nz int")
    for options in ({"strategy": "grouped"}, {"strategy": "distributed"}, {"strategy": "runs"}, {"connectivity": 26, "strategy": "distributed"}, {"grid": grid, "strategy": "distributed"}, {"grid": grid}):
        out = components(rows, **options).collect()
        for f, voxels in frames.items():
            own = sorted((r.i, r.j, r.k, r.label) for r in out if r.frame == f)
            assert o.from_labels(own) == o.components(voxels, options.get("connectivity", 6), (6, 6, 6) if "grid" in options else None)
            assert [x for x, _ in sorted({r[3]: r[:3] for r in reversed(own)}.items(), key=lambda p: p[1])] == list(range(len({r[3] for r in own})))


def test_every_name_and_alias(spark):
    rows = spark.createDataFrame([(0, i, 0, 0) for i in range(6)] + [(1, 9, 9, 9)], VOXELS)
    for name in METHODS:
        if name != "bls":
            assert cluster(rows, name, ClusterParams(k=2, min_pts=2, eps=2.0)).count() > 0 or name == "hdbscan"
    assert method("UF") == "gcbd" and method("k-means") == "kmeans"
    with pytest.raises(ValueError):
        method("spectral")
    for name in ("cc3d", "rle_ccl", "vccs", "kmeans", "hierarchical"):
        with pytest.raises(ValueError, match="periodic"):
            cluster(rows, name, periodic=True)


def test_summary_of_frames(spark):
    rows = spark.createDataFrame([(5, i, 0, 0) for i in (0, 1, 2, 4, 6, 7)], VOXELS)
    got = summarize(cluster(rows, "rle")).first()
    assert (got.nclusters, got.max_cluster, got.refined_voxels, got.cluster_sizes) == (3, 3, 6, [3, 2, 1])
