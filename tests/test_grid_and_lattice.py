import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from tests import oracles as o
from voxelflow.config import Config, ConfigError, Lattice, Selection, parse_deck
from voxelflow.functions import geometry, statistics
from voxelflow.operators.components import components
from voxelflow.operators.grid import grid_spec, select_atoms
from voxelflow.operators.lattice import OFFSETS, census, commensurate, lattice_clusters, nearest, probes, scaled_basis, seeds, sites
from voxelflow.operators.voxelize import rasterize

ATOMS = "frame long, atom int, x double, y double, z double"
FRAMES = "frame long, time_ps double, natoms int, " + ", ".join(f"{c} double" for c in geometry.CELL)
DECK = """BLS ...  # comment
GROUP ATOMS=INDEX:5-2,9
BOX MANUAL XLO -5 XHI 45 YLO 0 YHI 20 ZLO 0 ZHI 21
PBC none
grid_spacing 2.0
CONNECTIVITY 18
SKIP 2
REFINEMENT dfs
ALPHA 1.5
RADII 1.4,2.0
CUTOFF 0.75
OCCUPANCY all
LATTICE Hexagonal
CENTERING i
HEX_C_OVER_A 1.5
STRIDE 3
WHATEVER 1
... BLS
"""


def tables(spark, atoms, cell=None):
    frames = [(0, 0.0, len(atoms), *map(float, cell or (0.0,) * 9))]
    return spark.createDataFrame([(0, n, *map(float, a)) for n, a in enumerate(atoms)], ATOMS), spark.createDataFrame(frames, FRAMES)


def spec(spark, atoms, cell=None, **config):
    a, f = tables(spark, atoms, cell)
    return grid_spec(a, f, Config(**config)).first()


def test_deck_is_read():
    c = parse_deck(DECK)
    assert c.selection.ranges == ((2, 5), (9, 9)) and c.bounds == (-5, 45, 0, 20, 0, 21) and c.spacing == 2
    assert (c.connectivity, c.skip, c.refinement, c.occupancy, c.stride) == (18, 2, "dfs", "all", 3)
    assert c.lattice == Lattice("hexagonal", "I", 1.5) and c.dnn_voxels == pytest.approx(1.5 * 2.8 / 2)


@pytest.mark.parametrize(
    "change",
    [("LATTICE Hexagonal\n", ""), ("CENTERING i\n", ""), (" ZHI 21", ""), ("ZHI 21", "XHI 21"), ("ZHI", "ZZZ"), ("PBC none", "PBC xy"), ("BOX MANUAL XLO -5 XHI 45 YLO 0 YHI 20 ZLO 0 ZHI 21\nPBC none", "BOX AUTO\nPBC xyz"), ("... BLS", ""), ("CUTOFF 0.75", "CUTOFF x"), ("all\n", "some\n")],
)
def test_deck_is_strict(change):
    assert change[0] in DECK
    with pytest.raises(ConfigError):
        parse_deck(DECK.replace(*change, 1))


def test_grid_cases(spark):
    atoms = [(1, 2, 3), (11, 12, 13)]
    g = spec(spark, atoms, spacing=2.0)
    assert (g.nx, g.ny, g.nz, g.ox, g.oy, g.oz) == (7, 7, 7, 1, 2, 3)
    g = spec(spark, atoms, (30.0, 0, 0, 0, 30.0, 0, 0, 0, 30.0), spacing=2.0)
    assert (g.nx, g.ox) == (15, 0)
    g = spec(spark, atoms, box="manual", bounds=(-5, 45, 0, 20, 0, 21), spacing=2.0)
    assert (g.nx, g.ny, g.nz) == (25, 10, 11) and g.cz / g.nz == 21 / 11
    with pytest.raises(Exception, match="no usable cell"):
        spec(spark, atoms, box="cell", spacing=2.0)
    with pytest.raises(ValueError):
        spec(spark, atoms, box="manual", bounds=(0, 0, 0, 1, 0, 1))


def test_selection(spark):
    atoms, _ = tables(spark, [(n, 0, 0) for n in range(10)])
    ids = lambda df: sorted(r.atom for r in df.collect())
    assert ids(select_atoms(atoms, Selection(ranges=((2, 3), (10, 99))))) == [1, 2, 9]
    with pytest.raises(ValueError):
        select_atoms(atoms, Selection(ranges=((50, 60),)))
    assert len(ids(select_atoms(atoms, Selection(ranges=((50, 60),)), strict=False))) == 10
    names = spark.createDataFrame([(n, "OH"[n % 2]) for n in range(10)], "atom int, name string")
    assert ids(select_atoms(atoms, Selection(names=("H", "X")), names)) == [1, 3, 5, 7, 9]
    with pytest.raises(ValueError):
        select_atoms(atoms, Selection(names=("X",)), names)


CELLS = {
    "cubic": (12.0, 0, 0, 0, 12.0, 0, 0, 0, 12.0),
    "orthorhombic": (9.0, 0, 0, 0, 13.0, 0, 0, 0, 11.0),
    "triclinic": tuple(x for v in geometry.cell_vectors(12, 11, 13, 75, 82, 64) for x in v),
    "hexagonal": tuple(x for v in geometry.cell_vectors(12, 12, 10, 90, 90, 120) for x in v),
}


@pytest.mark.parametrize("cell", CELLS.values(), ids=CELLS)
@pytest.mark.parametrize("occupancy, cutoff", [("any", 1.4), ("all", 2.9), ("any", 0.0)])
@pytest.mark.parametrize("periodic", [False, True])
def test_voxels_are_those_whose_centre_is_near(spark, cell, occupancy, cutoff, periodic):
    rng = random.Random(1)
    b = np.array(cell).reshape(3, 3)
    atoms = [tuple(np.array([rng.uniform(-0.1, 1.1) for _ in range(3)]) @ b) for _ in range(6)]
    config = Config(box="cell", spacing=1.0, cutoff=cutoff, occupancy=occupancy, periodic=periodic)
    a, f = tables(spark, atoms, cell)
    grid = grid_spec(a, f, config)
    g = grid.first()
    n = np.array([g.nx, g.ny, g.nz])
    got = {(r.i, r.j, r.k) for r in rasterize(a, grid, config).collect()}
    half = np.array(list(itertools.product((-0.5, 0.5), repeat=3))) / n @ b
    corner = np.sqrt((half**2).sum(axis=1)).max()
    want = set()
    for p in atoms:
        q = np.array(p) @ np.linalg.inv(b)
        q = q - np.floor(q) if periodic else q
        if occupancy == "any" and cutoff == 0:
            found = [np.floor(q * n).astype(int)]
        else:
            radius = cutoff + corner + 1e-9 if occupancy == "any" else cutoff - corner - 1e-9
            wide = range(-9, int(n.max()) + 9)
            every = np.array(list(itertools.product(wide, repeat=3)))
            apart = np.sqrt((((every + 0.5) / n @ b - q @ b) ** 2).sum(axis=1))
            found = every[apart <= radius]
        for v in found:
            if periodic:
                want.add(tuple(int(x) for x in np.mod(v, n)))
            elif ((v >= 0) & (v < n)).all():
                want.add(tuple(int(x) for x in v))
    assert got == want


def test_wrap_of_a_single_atom(spark):
    for periodic, want in ((True, [(3, 0, 0)]), (False, [])):
        config = Config(box="manual", bounds=(0, 4, 0, 1, 0, 1), spacing=1.0, periodic=periodic)
        a, f = tables(spark, [(-0.1, 0.5, 0.5)])
        assert [(r.i, r.j, r.k) for r in rasterize(a, grid_spec(a, f, config), config).collect()] == want


def brute_sites(config, dims):
    basis, found = scaled_basis(config), []
    reach = int(3 * max(dims) / min(config.dnn_voxels, 1e9)) + 6
    for o_ in OFFSETS[config.lattice.centering]:
        for t in itertools.product(range(-reach, reach + 1), repeat=3):
            c = [a + b for a, b in zip(t, o_, strict=True)]
            v = tuple(geometry.round_half_away((c[0] * basis[0][k] + c[1] * basis[1][k]) + c[2] * basis[2][k] + config.lattice_origin[k]) for k in range(3))
            if all(0 <= x < n for x, n in zip(v, dims, strict=True)):
                found.append(v)
    return found


@pytest.mark.parametrize("kind", ["cubic", "hexagonal", "triclinic"])
@pytest.mark.parametrize("centering", "PFI")
def test_seeds_and_probes_match_all_sites(spark, kind, centering):
    lattice = Lattice(kind, centering, lengths=(1.0, 1.1, 1.3), angles=(80.0, 95.0, 70.0))
    config = Config(box="manual", bounds=(0, 7, 0, 6, 0, 5), spacing=1.0, dnn=2.4, lattice=lattice, lattice_origin=(0.3, -0.2, 0.5))
    a, f = tables(spark, [(i + 0.5, j + 0.5, k + 0.5) for i, j, k in itertools.product(range(7), range(6), range(5)) if (i + j + k) % 3])
    grid = grid_spec(a, f, config)
    voxels = rasterize(a, grid, config)
    every = brute_sites(config, (7, 6, 5))
    occupied = {(r.i, r.j, r.k) for r in voxels.collect()}
    assert {(r.i, r.j, r.k) for r in seeds(voxels, grid, config).collect()} == occupied & set(every)
    assert probes(config, (7, 6, 5)) == len(every)
    assert {tuple(r) for r in census(spark, config, (7, 6, 5)).collect()} == set(every)
    assert sorted(tuple(r) for r in sites(spark, config, (7, 6, 5)).collect()) == sorted(every)


def test_dense_lattice_finds_every_component_and_coarse_ones_only_whole(spark):
    rng = random.Random(2)
    points = [(x + 0.5, y + 0.5, z + 0.5) for x, y, z in itertools.product(range(12), repeat=3) if rng.random() < 0.2]
    a, f = tables(spark, points)
    for dnn in (0.5, 3.5):
        config = Config(box="manual", bounds=(0, 12, 0, 12, 0, 12), spacing=1.0, dnn=dnn)
        grid = grid_spec(a, f, config)
        voxels = rasterize(a, grid, config)
        truth = components(voxels, 6)
        found = lattice_clusters(truth, seeds(voxels, grid, config))
        whole = o.from_labels([(r.i, r.j, r.k, r.label) for r in truth.collect()])
        got = o.from_labels([(r.i, r.j, r.k, r.label) for r in found.collect()])
        assert got.items() <= whole.items() and (dnn > 1 or got == whole)


def test_periodic_bridge(spark):
    points = [(u + 0.5, 0.5, 0.5) for u in (0, 1, 2, 17, 18, 19)]
    for periodic, want in ((True, [6]), (False, [3, 3])):
        config = Config(box="manual", bounds=(0, 20, 0, 5, 0, 5), spacing=1.0, dnn=0.7, periodic=periodic)
        a, f = tables(spark, points)
        grid = grid_spec(a, f, config)
        voxels = rasterize(a, grid, config)
        found = lattice_clusters(components(voxels, 6, grid if periodic else None), seeds(voxels, grid, config))
        assert sorted(r["count"] for r in found.groupBy("label").count().collect()) == want


def test_commensurate_lattice():
    config = Config(dnn=2.4, lattice=Lattice("cubic", "F"))
    edges, cells, near = commensurate(config, (20, 21, 22))
    assert all(c * e == pytest.approx(n) and e <= scaled_basis(config)[0][0] + 1e-9 for c, e, n in zip(cells, edges, (20, 21, 22), strict=True))
    assert near == pytest.approx(nearest([(edges[0], 0, 0), (0, edges[1], 0), (0, 0, edges[2])], OFFSETS["F"]))
    with pytest.raises(ConfigError):
        commensurate(Config(lattice=Lattice("hexagonal", "P")), (5, 5, 5))


def test_rounding_is_half_away_from_zero():
    cases = {0.5: 1, -0.5: -1, 2.5: 3, -2.5: -3, 0.49999999999999994: 0, 1.4999999999999998: 1, 4503599627370497.0: 4503599627370497}
    assert {x: geometry.round_half_away(x) for x in cases} == cases


def test_fingerprint_is_the_hash_of_packed_bits():
    rng = np.random.default_rng(0)
    for total in (1, 7, 8, 9, 1000):
        dense = rng.integers(0, 2, total).astype(np.uint8)
        want = hashlib.sha256(np.packbits(dense, bitorder="little").tobytes()).hexdigest()
        assert statistics.occupancy_sha256(np.flatnonzero(dense), total) == want


def test_rank_agreement_and_points():
    assert statistics.kendall_tau([3, 2, 1], [1, 2, 3]) == -1 and statistics.kendall_tau([3, 2, 1], [9, 5, 5]) == 1
    assert statistics.kendall_tau([1], [2]) == 1 and statistics.kendall_tau([], None) == 1
    points = statistics.halton(64)
    assert points[0] == (0, 0, 0) and len(set(points)) == 64 and points[1] == (0.5, pytest.approx(1 / 3), 0.2)


def test_cell_vectors_have_their_lengths_and_angles():
    a, b, c = (np.array(v) for v in geometry.cell_vectors(3, 4, 5, 80, 95, 110))
    angle = lambda u, v: math.degrees(math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v)))
    assert [np.linalg.norm(v) for v in (a, b, c)] == pytest.approx([3, 4, 5])
    assert (angle(b, c), angle(a, c), angle(a, b)) == pytest.approx((80, 95, 110))
    assert np.array(geometry.invert(np.stack([a, b, c], axis=1).tolist())) @ np.stack([a, b, c], axis=1) == pytest.approx(np.eye(3))
