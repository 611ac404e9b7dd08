"""Probe lattices: bases, seeds on occupied voxels, probe counts and the components that seeds reach.

Whether a voxel is a site's rounded place is asked per occupied voxel, so the sites themselves, of which there may be
many millions, are never made. On cubic lattices the question splits into one set membership per axis, in
generated code; other bases test the few candidate sites around a voxel in numpy.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelflow.config import Config, ConfigError, Lattice
from voxelflow.functions.geometry import cell_vectors, invert, round_half_away

BROADCAST_FRAMES = 100_000
OFFSETS = {
    "P": ((0.0, 0.0, 0.0),),
    "F": ((0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)),
    "I": ((0.0, 0.0, 0.0), (0.5, 0.5, 0.5)),
}


def unit_basis(lattice: Lattice) -> list[tuple[float, float, float]]:
    if lattice.kind == "cubic":
        return [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    if lattice.kind == "hexagonal":
        return [(1.0, 0.0, 0.0), (-0.5, math.sqrt(3) / 2, 0.0), (0.0, 0.0, lattice.hex_c_over_a)]
    return list(cell_vectors(*lattice.lengths, *lattice.angles))


def nearest(basis, offsets) -> float:
    """Least distance between two sites."""
    found = []
    for p, q in itertools.product(offsets, repeat=2):
        for cell in itertools.product((-1, 0, 1), repeat=3):
            f = [c + b - a for c, a, b in zip(cell, p, q, strict=True)]
            d = math.sqrt(sum(sum(f[v] * basis[v][k] for v in range(3)) ** 2 for k in range(3)))
            if d > 1e-8:
                found.append(d)
    return min(found)


def scaled_basis(config: Config) -> list[tuple[float, float, float]]:
    """Basis in voxels whose nearest sites are the configured distance apart."""
    basis = unit_basis(config.lattice)
    scale = config.dnn_voxels / nearest(basis, OFFSETS[config.lattice.centering])
    return [tuple(x * scale for x in v) for v in basis]


def commensurate(config: Config, dims: tuple[int, int, int]) -> tuple[list[float], list[int], float]:
    """Edge and number of cells per axis of the cubic lattice fitted into a periodic grid, and its nearest distance."""
    if config.lattice.kind != "cubic":
        raise ConfigError("a periodic grid takes a cubic lattice only")
    a = scaled_basis(config)[0][0]
    cells = [max(1, math.ceil(n / a - 1e-9)) for n in dims]
    edges = [n / c for n, c in zip(dims, cells, strict=True)]
    basis = [tuple(edges[v] if v == k else 0.0 for k in range(3)) for v in range(3)]
    return edges, cells, nearest(basis, OFFSETS[config.lattice.centering])


def seeds(voxels: DataFrame, grid: DataFrame, config: Config) -> DataFrame:
    """Occupied voxels (frame, i, j, k, lin) that are the rounded place of a lattice site."""
    offsets = OFFSETS[config.lattice.centering]
    at = voxels.select("frame", "i", "j", "k", "lin")
    if config.lattice.kind != "cubic":
        if config.periodic:
            raise ConfigError("a periodic grid takes a cubic lattice only")
        return at.where(_general_hit(config)("i", "j", "k"))
    if config.periodic:
        # Asked by arithmetic, so that grids may be of any number of shapes.
        shapes, edge = grid.select("frame", "nx", "ny", "nz"), F.lit(scaled_basis(config)[0][0])
        for c, n in zip("ijk", ("nx", "ny", "nz"), strict=True):
            shapes = shapes.withColumn(f"cells_{c}", F.greatest(F.lit(1.0), F.ceil(F.col(n) / edge - 1e-9).cast("double")))
            shapes = shapes.withColumn(f"edge_{c}", F.col(n).cast("double") / F.col(f"cells_{c}"))
        wide = at.join(F.broadcast(shapes) if grid.count() <= BROADCAST_FRAMES else shapes, "frame")
        parts = sorted({o[k] for o in offsets for k in range(3)})
        hits = {(k, o): f"hit_{c}_{m}" for k, c in enumerate("ijk") for m, o in enumerate(parts)}
        for (k, o), name in hits.items():
            wide = wide.withColumn(name, _wrapped_hit("ijk"[k], ("nx", "ny", "nz")[k], o, config.lattice_origin[k]))
        met = reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.col(hits[k, o[k]]) for k in range(3)]) for o in offsets])
        return wide.where(met).select("frame", "i", "j", "k", "lin")
    # The largest grid's per-axis tables become literal sets of at most nx + ny + nz integers.
    largest = grid.agg(F.max("nx"), F.max("ny"), F.max("nz")).first()
    if largest[0] is None:
        return at
    return at.where(_table_hit(axis_tables(config, tuple(largest))))


def _wrapped_hit(index: str, length: str, offset: float, origin: float) -> Column:
    """Whether a site of a periodic cubic lattice, made commensurate with an axis, rounds to an index on it."""
    edge, cells = F.col(f"edge_{index}"), F.col(f"cells_{index}")
    near = F.floor((F.col(index) - F.lit(origin)) / edge - F.lit(offset) + 0.5).cast("double")
    # The nearest site and its neighbours, each as it is numbered within the box.
    steps = F.array(*[F.lit(float(d)) for d in (-1, 0, 1)])

    def rounds_to(step: Column) -> Column:
        place = edge * (F.pmod(near + step, cells) + F.lit(offset)) + F.lit(origin)
        away = F.signum(place) * F.floor(F.abs(place) + 0.5)
        return F.pmod(away.cast("long"), F.col(length).cast("long")) == F.col(index)

    return F.exists(steps, rounds_to)


def axis_tables(config: Config, dims: tuple[int, int, int]) -> list[list[set[int]]]:
    """Per centering offset and axis, the indices in a grid that a site of a cubic lattice rounds to."""
    offsets, origin = OFFSETS[config.lattice.centering], config.lattice_origin
    if not config.periodic:
        a = scaled_basis(config)[0][0]
        return [[set(axis_table(a, o[k], origin[k], dims[k])) for k in range(3)] for o in offsets]
    edges, cells, _ = commensurate(config, dims)
    return [[{round_half_away(edges[k] * (t + o[k]) + origin[k]) % dims[k] for t in range(cells[k])} for k in range(3)] for o in offsets]


def _table_hit(tables: list[list[set[int]]]) -> Column:
    hits = [reduce(lambda x, y: x & y, [F.col(c).isin(*sorted(t)) for c, t in zip("ijk", one, strict=True)]) for one in tables]
    return reduce(lambda x, y: x | y, hits)


def general_sites(config: Config, voxels: np.ndarray) -> np.ndarray:
    """For each voxel, whether a site of any basis rounds to it."""
    basis = np.array(scaled_basis(config))  # rows are the vectors
    inverse = np.array(invert([list(r) for r in basis.T]))
    half = np.abs(inverse).sum(axis=1) / 2 + 1e-9
    hit = np.zeros(len(voxels), bool)
    origin = config.lattice_origin
    for o in OFFSETS[config.lattice.centering]:
        start = basis.T @ np.array(o) + np.array(origin)
        f = (voxels - start) @ inverse.T
        low, high = np.ceil(f - half).astype(int), np.floor(f + half).astype(int)
        for step in itertools.product(*[range(int((high - low)[:, k].max(initial=0)) + 1) for k in range(3)]):
            t = low + np.array(step)
            c = t + np.array(o)
            same = (t <= high).all(axis=1)
            for k in range(3):
                x = (c[:, 0] * basis[0][k] + c[:, 1] * basis[1][k]) + c[:, 2] * basis[2][k] + origin[k]
                whole = np.trunc(x)
                same &= (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)) == voxels[:, k]
            hit |= same
    return hit


def _general_hit(config: Config):
    @F.pandas_udf("boolean")
    def hit(i: pd.Series, j: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(general_sites(config, np.stack([i, j, k], axis=1).astype(np.int64)))

    return hit


def axis_table(edge: float, offset: float, origin: float, n: int) -> list[int]:
    """Rounded places in [0, n) of one axis's sites, repeats and order kept."""
    first = math.floor((-1 - origin) / edge - offset) - 1
    last = math.ceil((n + 1 - origin) / edge - offset) + 1
    places = (round_half_away(edge * (t + offset) + origin) for t in range(first, last + 1))
    return [p for p in places if 0 <= p < n]


def probes(config: Config, dims: tuple[int, int, int]) -> int:
    """Sites that fall into a grid, with repeats."""
    offsets = OFFSETS[config.lattice.centering]
    if config.periodic:
        return math.prod(commensurate(config, dims)[1]) * len(offsets)
    if config.lattice.kind == "cubic":
        a = scaled_basis(config)[0][0]
        return sum(math.prod(len(axis_table(a, o[k], config.lattice_origin[k], dims[k])) for k in range(3)) for o in offsets)
    first, last = site_planes(config, dims)
    return sum(len(at) for t in range(first, last) for at in plane_sites(config, dims, t))


def probe_counts(config: Config, shapes: DataFrame) -> DataFrame:
    """(nx, ny, nz, probes, dNN_vox) of each of the given grid shapes, counted in tasks."""

    def run(batches):
        for batch in batches:
            found = [(x, y, z, probes(config, (x, y, z)), commensurate(config, (x, y, z))[2] if config.periodic else float(config.dnn_voxels)) for x, y, z in batch.astype(int).itertuples(index=False)]
            yield pd.DataFrame(found, columns=["nx", "ny", "nz", "probes", "dNN_vox"])

    return shapes.select("nx", "ny", "nz").mapInPandas(run, "nx int, ny int, nz int, probes long, dNN_vox double")


def _reach(config: Config, dims: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last lattice indices that can fall into a grid, on each vector of the basis."""
    inverse = np.array(invert([list(r) for r in np.array(scaled_basis(config)).T]))
    corners = np.array(list(itertools.product(*[(-1, n) for n in dims]))) - np.array(config.lattice_origin)
    reach = corners @ inverse.T
    return np.floor(reach.min(axis=0)).astype(int) - 2, np.ceil(reach.max(axis=0)).astype(int) + 2


def site_planes(config: Config, dims: tuple[int, int, int]) -> tuple[int, int]:
    low, high = _reach(config, dims)
    return int(low[0]), int(high[0]) + 1


def plane_sites(config: Config, dims: tuple[int, int, int], t: int):
    """Rounded places, in a grid and with repeats, of the sites of one plane of lattice indices."""
    basis, origin = np.array(scaled_basis(config)), np.array(config.lattice_origin)
    low, high = _reach(config, dims)
    second, third = (g.ravel() for g in np.meshgrid(np.arange(low[1], high[1] + 1), np.arange(low[2], high[2] + 1), indexing="ij"))
    for o in OFFSETS[config.lattice.centering]:
        c0, c1, c2 = t + o[0], second + o[1], third + o[2]
        x = np.stack([(c0 * basis[0][k] + c1 * basis[1][k]) + c2 * basis[2][k] + origin[k] for k in range(3)], axis=1)
        whole = np.trunc(x)
        at = (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)).astype(np.int64)
        yield at[((at >= 0) & (at < np.array(dims))).all(axis=1)]


def sites(spark: SparkSession, config: Config, dims: tuple[int, int, int]) -> DataFrame:
    """(i, j, k) of every site in a grid, with repeats; one plane of lattice indices is made at a time."""

    def run(batches):
        for batch in batches:
            for t in batch["id"]:
                for at in plane_sites(config, dims, int(t)):
                    yield pd.DataFrame(at, columns=["i", "j", "k"])

    return spark.range(*site_planes(config, dims)).mapInPandas(run, "i int, j int, k int")


def census(spark: SparkSession, config: Config, dims: tuple[int, int, int]) -> DataFrame:
    """(i, j, k) of voxels that some site falls into, occupied or not."""
    if config.lattice.kind != "cubic":
        return sites(spark, config, dims).distinct()
    made = None
    for tables in axis_tables(config, dims):
        axes = [F.array(*map(F.lit, sorted(t))).cast("array<int>") for t in tables]
        one = spark.range(1).select(F.explode(axes[0]).alias("i")).select("i", F.explode(axes[1]).alias("j")).select("i", "j", F.explode(axes[2]).alias("k"))
        made = one if made is None else made.unionAll(one)
    return made.distinct()


def met_components(labels: DataFrame, seed_voxels: DataFrame) -> DataFrame:
    """Labels (frame, i, j, k, label) with ``found``: components that hold a seed, numbered in order of their first seed; null for others.

    The labels are read once. A component is no larger than its frame, which a labelling task holds as well.
    """
    marked = labels.join(seed_voxels.select("frame", "i", "j", "k", F.lit(True).alias("seeded")), ["frame", "i", "j", "k"], "left")
    first = F.min(F.when(F.col("seeded"), F.struct("i", "j", "k"))).over(Window.partitionBy("frame", "label"))
    ranked = (F.dense_rank().over(Window.partitionBy("frame").orderBy(F.col("seed").asc_nulls_last())) - 1).cast("long")
    out = marked.withColumn("seed", first).withColumn("found", F.when(F.col("seed").isNotNull(), ranked))
    return out.select("frame", "i", "j", "k", "label", "found")


def lattice_clusters(labels: DataFrame, seed_voxels: DataFrame) -> DataFrame:
    """The components that hold a seed, labelled anew in order of their first seed; voxels of others are left out."""
    return met_components(labels, seed_voxels).where("found is not null").select("frame", "i", "j", "k", F.col("found").alias("label"))
