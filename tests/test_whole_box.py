import datetime
import random

import pytest

from voxelflow.plans import bindings as b
from voxelflow.plans import catalogue

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"
SEEDS = ["lattice_seeds_cubic_p", "lattice_seeds_cubic_i", "lattice_seeds_cubic_f", "lattice_seeds_hex"]


def events(spark, folder, users):
    """Events of two days, written where the queries read them."""
    rng = random.Random(1)
    rows = [(n, datetime.datetime(2024, 1, 1 + n % 2, rng.randrange(24)), u, rng.uniform(0, 500)) for n, u in enumerate(u for u in users for _ in range(3))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("name", SEEDS)
def test_seeds_beyond_the_first_planes(spark, tmp_path, name):
    near, far = events(spark, tmp_path / "near", range(0, 180)), events(spark, tmp_path / "far", [*range(0, 180), *range(600, 5000, 5)])
    some, every = rows_of(catalogue.QUERIES[name](spark, near)), rows_of(catalogue.QUERIES[name](spark, far))
    planes = {r[1] for r in every}
    assert some and max(planes) > 700
    assert len(planes) > 3 * len({r[1] for r in some})


def test_lattice_clusters_and_recall_cover_all_planes(spark, tmp_path):
    far = events(spark, tmp_path / "far", [*range(0, 5000, 5), *range(9000, 9060)])
    assert catalogue.QUERIES["lattice_clusters"](spark, far).where("i >= 1500").count() > 0
    assert catalogue.QUERIES["lattice_clusters"](spark, far).where("i >= 700").count() > 0
    present = sum(r["size"] * r["present"] for r in catalogue.QUERIES["size_floor"](spark, far).collect())
    assert present == b.event_voxels(spark, far).count()


def test_periodic_components_keep_every_voxel(spark, tmp_path):
    folder = events(spark, tmp_path / "all", range(0, 1600, 4))
    voxels = {(r.frame, r.i % 256, r.j % 16, r.k % 16) for r in b.event_voxels(spark, folder).collect()}
    sizes, left = {}, set(voxels)
    while left:  # a plain search over the wrapped neighbours
        stack, size = [left.pop()], 0
        frame = stack[0][0]
        while stack:
            _, i, j, k = stack.pop()
            size += 1
            for step in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                near = (frame, (i + step[0]) % 256, (j + step[1]) % 16, (k + step[2]) % 16)
                if near in left:
                    left.remove(near)
                    stack.append(near)
        sizes.setdefault(frame, []).append(size)
    want = sorted((f, len(s), max(s), sum(s)) for f, s in sizes.items())
    assert rows_of(catalogue.QUERIES["components6_pbc"](spark, folder)) == want
