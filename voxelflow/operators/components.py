"""Exact connected components of sparse voxels under 6-, 18- or 26-adjacency.

``grouped`` solves each frame in one task with vectorised numpy; ``distributed`` is for frames too big for
that: cubes of a frame are solved in tasks of their own, neighbours in different cubes meet in equi-joins on exploded offsets, and smallest
labels spread among the cubes' components with pointer jumping. The joins are merges, so that the driver holds no table.
``runs`` joins runs of voxels along k, found with a window, in place of single voxels.
Labels are dense per frame, in raster order of each component's first voxel.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = "frame long, i int, j int, k int, label long"
ORDER = ["i", "j", "k"]
CUBE = 32  # voxels along a cube's edge


def half_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite neighbour offsets."""
    reach = {6: 1, 18: 2, 26: 3}.get(connectivity, 3)
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= reach]


def minimum_labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component, by hooking and pointer jumping over edge arrays."""
    label = np.arange(count)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_edges = low < high
        if not open_edges.any():
            break
        np.minimum.at(label, high[open_edges], low[open_edges])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        a, b = a[open_edges], b[open_edges]
    return label


class Cells:
    """Occupied voxels of a frame in raster order, with lookup by index; ``dims`` makes the axes periodic."""

    def __init__(self, ijk: np.ndarray, dims: tuple[int, int, int] | None = None):
        ijk = np.unique(np.asarray(ijk, np.int64).reshape(-1, 3), axis=0)
        self.ijk, self.dims = ijk, None if dims is None else np.asarray(dims, np.int64)
        self.low = ijk.min(axis=0) - 1 if len(ijk) else np.zeros(3, np.int64)
        self.span = (ijk.max(axis=0) - self.low + 2) if len(ijk) else np.ones(3, np.int64)
        self.keys = self._key(ijk)

    def __len__(self) -> int:
        return len(self.ijk)

    def _key(self, ijk: np.ndarray) -> np.ndarray:
        at = ijk - self.low
        return (at[..., 0] * self.span[1] + at[..., 1]) * self.span[2] + at[..., 2]

    def find(self, ijk: np.ndarray) -> np.ndarray:
        """Position of each voxel in raster order, -1 where there is none."""
        ijk = np.asarray(ijk, np.int64)
        if self.dims is not None:
            ijk = ijk % self.dims
        inside = ((ijk >= self.low) & (ijk < self.low + self.span)).all(axis=-1)
        key = np.where(inside, self._key(ijk), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(inside & (self.keys[at] == key), at, -1)

    def edges(self, offsets) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros((0, 2), np.int64)]
        here = np.arange(len(self))
        for o in offsets:
            there = self.find(self.ijk + np.asarray(o))
            found.append(np.stack([here, there], axis=1)[there >= 0])
        both = np.concatenate(found)
        return both[:, 0], both[:, 1]


def dense(first: np.ndarray) -> np.ndarray:
    """Labels 0.. in order of the representative, -1 kept."""
    out = np.full(len(first), -1, np.int64)
    kept = first >= 0
    out[kept] = np.unique(first[kept], return_inverse=True)[1]
    return out


def component_labels(cells: Cells, connectivity: int = 6) -> np.ndarray:
    return dense(minimum_labels(len(cells), *cells.edges(half_offsets(connectivity))))


def per_frame(voxels: DataFrame, kernel, grid: DataFrame | None = None) -> DataFrame:
    """Run ``kernel(Cells) -> labels`` on every frame; voxels labelled -1 are left out.

    With ``grid`` (frame, nx, ny, nz) the axes are periodic.
    """
    narrow = voxels.select("frame", *ORDER)
    if grid is not None:
        narrow = narrow.join(grid.select("frame", "nx", "ny", "nz"), "frame")
    periodic = grid is not None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(rows[ORDER].to_numpy(), tuple(int(rows[n].iloc[0]) for n in ("nx", "ny", "nz")) if periodic else None)
        label = np.asarray(kernel(cells), np.int64)
        out = pd.DataFrame(cells.ijk.astype(np.int32), columns=ORDER)
        out.insert(0, "frame", rows["frame"].iloc[0])
        out["label"] = label
        return out[label >= 0]

    return narrow.groupBy("frame").applyInPandas(run, LABELS)


def components(voxels: DataFrame, connectivity: int = 6, grid: DataFrame | None = None, strategy: str = "grouped") -> DataFrame:
    """(frame, i, j, k, label) of every occupied voxel.

    ``runs`` knows 6-adjacency on open axes only and rejects others.
    """
    if strategy == "grouped":
        return per_frame(voxels, lambda cells: component_labels(cells, connectivity), grid)
    if strategy not in ("runs", "distributed"):
        raise ValueError(f"no strategy named {strategy}")
    if strategy == "runs" and (connectivity != 6 or grid is not None):
        raise ValueError("runs join 6-adjacent voxels on open axes; use the distributed strategy for others")
    units = voxels.select("frame", *ORDER).distinct()
    if strategy == "runs":
        return number_labels(spread_labels(units, run_edges(units)))
    local = cube_components(units, connectivity).checkpoint()
    spread = spread_labels(local.where(F.col("own") == F.struct(*ORDER)), cube_edges(local, connectivity, grid))
    spread = spread.select("frame", F.struct(*ORDER).alias("own"), "first")
    return number_labels(local.join(spread.hint("merge"), ["frame", "own"]).select("frame", *ORDER, "first"))


def number_labels(spread: DataFrame) -> DataFrame:
    """Labels 0.. per frame in order of each component's first voxel, without bringing a frame's components into one task.

    The first voxels are range-partitioned and numbered within their partitions; a frame's counts before a partition are then added.
    """
    firsts = spread.where(F.col("first") == F.struct(*ORDER)).select("frame", "first")
    parts = firsts.repartitionByRange("frame", "first").withColumn("part", F.spark_partition_id()).checkpoint()
    within = F.row_number().over(Window.partitionBy("part", "frame").orderBy("first")) - 1
    counts = parts.groupBy("frame", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("frame").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = parts.withColumn("place", within).join(counts.select("frame", "part", before.alias("before")), ["frame", "part"])
    numbered = numbered.select("frame", "first", (F.col("place") + F.col("before")).cast("long").alias("label"))
    return spread.join(numbered.hint("merge"), ["frame", "first"]).select("frame", *ORDER, "label")


def cube_components(voxels: DataFrame, connectivity: int) -> DataFrame:
    """(frame, i, j, k, own): each voxel's first voxel of its component within its cube, whose edges are open."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(rows[ORDER].to_numpy())
        first = cells.ijk[minimum_labels(len(cells), *cells.edges(half_offsets(connectivity)))]
        out = pd.DataFrame(np.concatenate([cells.ijk, first], axis=1).astype(np.int32), columns=[*ORDER, "fi", "fj", "fk"])
        out.insert(0, "frame", rows["frame"].iloc[0])
        return out

    cubes = [F.floor(F.col(c) / CUBE).alias(f"cube_{c}") for c in ORDER]
    local = voxels.groupBy("frame", *cubes).applyInPandas(run, "frame long, i int, j int, k int, fi int, fj int, fk int")
    return local.select("frame", *ORDER, F.struct(*[F.col(f"f{c}").alias(c) for c in ORDER]).alias("own"))


def cube_edges(local: DataFrame, connectivity: int, grid: DataFrame | None = None) -> DataFrame:
    """(frame, a, b): pairs of components of cubes that hold adjacent voxels, from equi-joins on the exploded offsets that leave a cube."""
    offsets = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(o, ("di", "dj", "dk"), strict=True)]) for o in half_offsets(connectivity)])
    here = local if grid is None else local.join(grid.select("frame", "nx", "ny", "nz"), "frame")
    here = here.withColumn("o", F.explode(offsets))
    there = [F.col(c) + F.col(f"o.d{c}") for c in ORDER]
    leaves = F.lit(False)
    for t, c, n in zip(there, ORDER, ("nx", "ny", "nz"), strict=True):
        leaves = leaves | (F.floor(t / CUBE) != F.floor(F.col(c) / CUBE))
        if grid is not None:
            leaves = leaves | (t != F.pmod(t, F.col(n)))
    if grid is not None:
        there = [F.pmod(t, F.col(n)) for t, n in zip(there, ("nx", "ny", "nz"), strict=True)]
    moved = here.where(leaves).select("frame", F.col("own").alias("a"), *[t.cast("int").alias(c) for t, c in zip(there, ORDER, strict=True)])
    met = moved.hint("merge").join(local.withColumnRenamed("own", "b"), ["frame", *ORDER])
    return met.where("a <> b").select("frame", "a", "b").distinct()


def runs_of(voxels: DataFrame) -> DataFrame:
    """(frame, i, j, start, stop): maximal runs along k, by the gaps-and-islands difference."""
    island = F.col("k") - F.row_number().over(Window.partitionBy("frame", "i", "j").orderBy("k"))
    marked = voxels.select("frame", *ORDER).distinct().withColumn("island", island)
    return marked.groupBy("frame", "i", "j", "island").agg(F.min("k").alias("start"), F.max("k").alias("stop")).drop("island")


def run_edges(voxels: DataFrame) -> DataFrame:
    """Edges of 6-adjacency with one edge inside each run per voxel, and one per pair of overlapping runs of neighbouring rows."""
    runs = runs_of(voxels)
    inside = runs.where("stop > start").withColumn("k", F.explode(F.sequence(F.col("start") + 1, F.col("stop"))))
    inside = inside.select("frame", F.struct("i", "j", F.col("start").alias("k")).alias("a"), F.struct("i", "j", F.col("k").cast("int").alias("k")).alias("b"))
    across = []
    for di, dj in ((1, 0), (0, 1)):
        other = runs.select("frame", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
        met = runs.join(other, ["frame", "i", "j"]).where((F.col("start") <= F.col("e2")) & (F.col("s2") <= F.col("stop")))
        ends = F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("s2").alias("k"))
        across.append(met.select("frame", F.struct("i", "j", F.col("start").alias("k")).alias("a"), ends.alias("b")))
    return inside.unionAll(across[0]).unionAll(across[1])


def spread_labels(voxels: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, i, j, k, first): each voxel's first voxel of its component; rounds are checkpointed, only a count is fetched."""
    one = edges.select("frame", F.col("a").alias("src"), F.col("b").alias("dst"))
    both = one.unionAll(edges.select("frame", F.col("b").alias("src"), F.col("a").alias("dst"))).distinct().checkpoint()
    labels = voxels.select("frame", F.struct(*ORDER).alias("at"), F.struct(*ORDER).alias("first")).checkpoint()
    while True:
        near = both.hint("merge").join(labels.select("frame", F.col("at").alias("dst"), F.col("first").alias("near")), ["frame", "dst"])
        near = near.groupBy("frame", F.col("src").alias("at")).agg(F.min("near").alias("near"))
        lower = labels.hint("merge").join(near, ["frame", "at"], "left").select("frame", "at", F.col("first").alias("old"), F.least("first", "near").alias("mid"))
        jump = lower.select("frame", F.col("at").alias("mid"), F.col("mid").alias("far"))
        after = lower.hint("merge").join(jump, ["frame", "mid"]).select("frame", "at", "old", F.least("mid", "far").alias("first")).checkpoint()
        labels = after.select("frame", "at", "first")
        if not after.where(F.col("old") != F.col("first")).limit(1).count():
            return labels.select("frame", "at.*", "first")
