import itertools
import random

import pytest

from voxelflow.config import Config
from voxelflow.functions import sql, statistics
from voxelflow.operators import tools
from voxelflow.operators.components import components
from voxelflow.operators.grid import grid_spec
from voxelflow.operators.lattice import axis_table
from voxelflow.operators.voxelize import rasterize
from voxelflow.plans.bindings import frames_of


def test_sweep_over_offsets(spark):
    points = [(0, n, float(x), float(y), float(z)) for n, (x, y, z) in enumerate(itertools.product(range(2), range(2), range(2)))]
    points += [(0, 100, 9.2, 9.1, 9.3)]
    atoms = spark.createDataFrame(points, "frame long, atom int, x double, y double, z double")
    bounds = tools.fixed_cell(atoms, 1.0)
    assert bounds[0] == -10 and (bounds[1] - bounds[0]) == pytest.approx(10 + 20 + 7)
    config = Config(box="manual", bounds=bounds, spacing=1.0, dnn=3.0)
    grid = grid_spec(atoms, frames_of(atoms), config)
    sweep = tools.offset_sweep(rasterize(atoms, grid, config), grid, config, statistics.halton(4)).cache()
    rows = sweep.collect()
    assert {r.offset for r in rows} == {0, 1, 2, 3} and all(r.present == 1 for r in rows) and {r.size for r in rows} == {1, 8}
    assert all(0 <= r.recall <= 1 and r.present == 2 for r in tools.recall(sweep).collect())


def test_offset_sets():
    config = Config(box="manual", bounds=(0.0, 8.0) * 3, spacing=1.0, dnn=3.0)
    assert [c.lattice_origin for c in tools.offset_set(config, "diagonal8")] == [(-float(i),) * 3 for i in range(8)]
    origins = [c.lattice_origin for c in tools.offset_set(config, "halton64")]
    assert len(set(origins)) == 64 and origins[0] == (0, 0, 0) and all(0 <= x < 9 for o in origins for x in o)
    with pytest.raises(ValueError):
        tools.offset_set(config, "other")


def test_strategies_reject_what_they_do_not_do(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0)], "frame long, i int, j int, k int")
    grid = spark.createDataFrame([(0, 2, 2, 1)], "frame long, nx int, ny int, nz int")
    for connectivity, wrapped, strategy in ((26, None, "runs"), (6, grid, "runs"), (6, None, "other")):
        with pytest.raises(ValueError):
            components(voxels, connectivity, wrapped, strategy)


def test_distributed_labels_are_the_grouped_ones(spark):
    rng = random.Random(5)
    cells = {(f, rng.randrange(12), rng.randrange(12), rng.randrange(12)) for f in range(3) for _ in range(300)}
    voxels = spark.createDataFrame(sorted(cells), "frame long, i int, j int, k int")
    for connectivity in (6, 18, 26):
        want = sorted(map(tuple, components(voxels, connectivity).collect()))
        assert sorted(map(tuple, components(voxels, connectivity, strategy="distributed").collect())) == want
    assert sorted(map(tuple, components(voxels, 6, strategy="runs").collect())) == sorted(map(tuple, components(voxels, 6).collect()))


def test_supervoxel_probe(spark):
    voxels = spark.createDataFrame([(0, *v) for v in itertools.product(range(6), repeat=3)], "frame long, i int, j int, k int")
    got = tools.supervoxel_probe(voxels, 3.0).first()
    assert (got.occupied, got.candidates) == (216, 8) and 0 < got.seeds <= 8 and got.threshold == pytest.approx(7.0686, abs=1e-3)


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("select voxel_index(1, 2, 3, 10, 20) a, wrap_index(-1, 5) b, minimum_image(-4, 5) c").first()
    assert tuple(got) == (243, 4, 1)
    hits = spark.sql("select id from range(40) where lattice_hit(id, 2.7D, 0.5D, 0.3D)").collect()
    assert sorted(r.id for r in hits) == sorted(set(axis_table(2.7, 0.5, 0.3, 40)))
