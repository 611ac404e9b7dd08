"""Registered queries of the trajectory engine and their DuckDB oracles."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.config import ClusterParams, FrameWindow, Lattice, Selection
from voxelflow.operators.cluster import cluster, cluster_sizes, size_histogram, summarize
from voxelflow.operators.compare import compare_runs, merged, outcomes, recall_by_size, running_totals
from voxelflow.operators.components import components, runs_of
from voxelflow.operators.grid import grid_spec, select_atoms, window_frames
from voxelflow.operators.lattice import OFFSETS, census, met_components, probes, scaled_basis, seeds
from voxelflow.operators.metrics import fingerprints
from voxelflow.operators.tools import offset_set, offset_sweep, recall
from voxelflow.operators.voxelize import rasterize
from voxelflow.plans import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


# --- voxelisation ------------------------------------------------------------------------------------------------


def _voxels(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    atoms, config = b.event_atoms(spark, sf_dir), b.config(**changes)
    return rasterize(atoms, grid_spec(atoms, b.frames_of(atoms), config), config)


def _in_grid(select: str, dims=b.DIMS) -> str:
    nx, ny, nz = dims
    return f"select frame, i, j, k, ((i::bigint * {ny} + j) * {nz} + k)::bigint as lin from ({select}) where i between 0 and {nx - 1} and j between 0 and {ny - 1} and k between 0 and {nz - 1}"


@query("voxelize_base", _in_grid(b.EVENT_VOXELS))
def voxelize_base(spark, sf_dir):
    return _voxels(spark, sf_dir)


def _stencil(cutoff: float, sign: int) -> str:
    reach = math.ceil((cutoff + sign * math.sqrt(3) / 2) + 1e-9 + 0.5)
    index = f"select unnest(range({-reach}, {reach + 1}))::int"
    return _in_grid(
        f"""select distinct frame, i, j, k from (
            select frame, x, y, z, floor(x)::int + di as i, floor(y)::int + dj as j, floor(z)::int + dk as k
            from ({b.EVENT_ATOMS}), ({index} as di), ({index} as dj), ({index} as dk))
        where sqrt((i + 0.5::double - x) * (i + 0.5::double - x) + (j + 0.5::double - y) * (j + 0.5::double - y) + (k + 0.5::double - z) * (k + 0.5::double - z))
            <= {cutoff}::double + {sign} * (sqrt(3::double) / 2) + {sign} * 1e-9::double"""
    )


@query("voxelize_cutoff_any", _stencil(0.75, 1))
def voxelize_cutoff_any(spark, sf_dir):
    return _voxels(spark, sf_dir, cutoff=0.75)


@query("voxelize_cutoff_all", _stencil(1.75, -1))
def voxelize_cutoff_all(spark, sf_dir):
    return _voxels(spark, sf_dir, cutoff=1.75, occupancy="all")


WRAPPED = f"select distinct frame, i % 16 as i, j % 16 as j, k % 16 as k from ({b.EVENT_VOXELS})"


@query("voxelize_periodic", _in_grid(WRAPPED, b.WRAPPED_DIMS))
def voxelize_periodic(spark, sf_dir):
    return _voxels(spark, sf_dir, bounds=b.WRAPPED_BOUNDS, periodic=True)


WIDE_WRAPPED_BOUNDS, WIDE_WRAPPED_DIMS = (0.0, 256.0, 0.0, 32.0, 0.0, 32.0), (256, 32, 32)


def _wrapped_stencil(cutoff: float, dims) -> str:
    """Voxels whose centre lies within a cutoff plus half a diagonal of an atom, both wrapped; distances go the way the stencil reaches."""
    reach = math.ceil(cutoff + math.sqrt(3) / 2 + 0.5)
    index = f"select unnest(range({-reach}, {reach + 1}))::int"
    place = [f"({c} / {n} - floor({c} / {n})) * {n}" for c, n in zip("xyz", dims, strict=True)]
    near = " + ".join(f"({v} + 0.5::double - {c}) * ({v} + 0.5::double - {c})" for v, c in zip("ijk", "xyz", strict=True))
    return f"""select distinct frame, ((i % {dims[0]}) + {dims[0]}) % {dims[0]} as i, ((j % {dims[1]}) + {dims[1]}) % {dims[1]} as j, ((k % {dims[2]}) + {dims[2]}) % {dims[2]} as k
        from (select frame, x, y, z, floor(x)::int + di as i, floor(y)::int + dj as j, floor(z)::int + dk as k
            from (select frame, {place[0]} as x, {place[1]} as y, {place[2]} as z from ({b.EVENT_ATOMS})), ({index} as di), ({index} as dj), ({index} as dk))
        where sqrt({near}) <= {cutoff}::double + sqrt(3::double) / 2 + 1e-9::double"""


@query("voxelize_periodic_cutoff", _in_grid(_wrapped_stencil(0.75, WIDE_WRAPPED_DIMS), WIDE_WRAPPED_DIMS))
def voxelize_periodic_cutoff(spark, sf_dir):
    return _voxels(spark, sf_dir, bounds=WIDE_WRAPPED_BOUNDS, periodic=True, cutoff=0.75)


# Frames with cells of their own, of two lengths along x; powers of two for the same reason as the bindings' edges.
CELLS = "select distinct frame, 512.0 * (1 + frame % 2) as ax, 32.0 as by, 32.0 as cz"


@query("grid_spec_cell", f"select frame, ceil(ax)::int as nx, 32 as ny, 32 as nz, 0.0::double as ox from ({CELLS} from ({b.EVENT_ATOMS}))")
def grid_spec_cell(spark, sf_dir):
    return _cell_grid(spark, sf_dir)[1].select("frame", "nx", "ny", "nz", "ox")


@query(
    "voxelize_cell",
    f"""select frame, i, j, k, ((i::bigint * 32 + j) * 32 + k)::bigint as lin from ({b.EVENT_VOXELS})
    where i between 0 and 512 * (1 + frame % 2) - 1 and j between 0 and 31 and k between 0 and 31""",
)
def voxelize_cell(spark, sf_dir):
    atoms, grid, config = _cell_grid(spark, sf_dir)
    return rasterize(atoms, grid, config)


def _cell_grid(spark, sf_dir):
    atoms, config = b.event_atoms(spark, sf_dir), b.config(box="cell", bounds=None)
    own = {"ax": F.lit(512.0) * (1 + F.col("frame") % 2), "by": F.lit(32.0), "cz": F.lit(32.0)}
    return atoms, grid_spec(atoms, b.frames_of(atoms).withColumns(own), config), config


@query(
    "grid_spec_auto",
    f"""select frame, greatest(1, ceil(hx - lx + 2))::int as nx, greatest(1, ceil(hy - ly + 2))::int as ny, greatest(1, ceil(hz - lz + 2))::int as nz,
        lx as ox, ly as oy, lz as oz
    from (select frame, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, min(z) as lz, max(z) as hz from ({b.EVENT_ATOMS}) group by frame)""",
)
def grid_spec_auto(spark, sf_dir):
    atoms = b.event_atoms(spark, sf_dir)
    return grid_spec(atoms, b.frames_of(atoms), b.config(box="auto", bounds=None)).select("frame", "nx", "ny", "nz", "ox", "oy", "oz")


@query("grid_spec_manual", f"select distinct frame, 1024 as nx, 32 as ny, 32 as nz, 1.0::double as spacing from ({b.EVENT_ATOMS})")
def grid_spec_manual(spark, sf_dir):
    atoms = b.event_atoms(spark, sf_dir)
    return grid_spec(atoms, b.frames_of(atoms), b.config()).select("frame", "nx", "ny", "nz", "spacing")


@query("select_index", f"select frame, atom from ({b.EVENT_ATOMS}) where atom between 9 and 499 or atom between 999 and 1999")
def select_index(spark, sf_dir):
    return select_atoms(b.event_atoms(spark, sf_dir), Selection(ranges=((10, 500), (1000, 2000)))).select("frame", "atom")


@query(
    "select_name",
    "select c_custkey % 10 as frame, count(*)::bigint as natoms from customer join nation on c_nationkey = n_nationkey where n_name in ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_3') group by 1",
)
def select_name(spark, sf_dir):
    topology = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("atom"), F.col("n_name").alias("name"))
    atoms = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 10).alias("frame"), F.col("c_nationkey").alias("atom"))
    chosen = select_atoms(atoms, Selection(names=("FRANCE", "GERMANY", "NATION_1", "NATION_3")), topology)
    return chosen.groupBy("frame").agg(F.count(F.lit(1)).alias("natoms"))


@query("frame_window", f"select frame, count(*)::bigint as natoms from ({b.EVENT_ATOMS}) where frame between 3 and 25 and (frame - 3) % 4 = 0 group by frame")
def frame_window(spark, sf_dir):
    return window_frames(b.event_atoms(spark, sf_dir), FrameWindow(3, 25, 4)).groupBy("frame").agg(F.count(F.lit(1)).alias("natoms"))


# --- components --------------------------------------------------------------------------------------------------


def _adjacent(manhattan: int) -> str:
    return f"greatest(abs(p.i - q.i), abs(p.j - q.j), abs(p.k - q.k)) <= 1 and abs(p.i - q.i) + abs(p.j - q.j) + abs(p.k - q.k) <= {manhattan}"


def _labelled(voxels: str, near: str, members: str = "true", tag: str = "") -> str:
    """CTEs v (with lin), e (edges), c (component's first voxel per voxel) and l (dense labels), all with ``tag`` behind; a tagged one goes on after another."""
    t = tag
    return f"""{", " if t else "with recursive "}v{t} as (select *, (i::bigint * 100000 + j) * 100000 + k as lin from ({voxels}))
    , m{t} as (select * from v{t} where {members})
    , e{t} as (select p.frame, p.lin as a, q.lin as b from m{t} p join m{t} q on p.frame = q.frame and p.lin <> q.lin and {near})
    , r{t}(frame, a, root) as (select frame, lin, lin from m{t} union select e{t}.frame, e{t}.b, r{t}.root from r{t} join e{t} on e{t}.frame = r{t}.frame and e{t}.a = r{t}.a)
    , c{t} as (select frame, a as lin, min(root) as first from r{t} group by frame, a)
    , l{t} as (select frame, m{t}.i, m{t}.j, m{t}.k, lin, (dense_rank() over (partition by frame order by first) - 1)::bigint as label from m{t} join c{t} using (frame, lin))"""


def _components_oracle(voxels: str, near: str) -> str:
    return _labelled(voxels, near) + " select frame, i, j, k, label from l"


EV6, EV18, EV26 = (_labelled(b.EVENT_VOXELS, _adjacent(m)) for m in (1, 2, 3))
FRAME_METRICS = """ select frame, count(*)::int as nclusters, max(size)::int as max_cluster, sum(size)::bigint as refined_voxels
    from (select frame, label, count(*) as size from l group by frame, label) group by frame"""


def _metrics(labels: DataFrame) -> DataFrame:
    return summarize(labels).select("frame", "nclusters", "max_cluster", "refined_voxels")


@query("components6", EV6 + FRAME_METRICS)
def components6(spark, sf_dir):
    return _metrics(cluster(b.event_voxels(spark, sf_dir), "traditional_dfs"))


@query("components18", EV18 + FRAME_METRICS)
def components18(spark, sf_dir):
    return _metrics(components(b.event_voxels(spark, sf_dir), 18))


@query("components26", EV26 + FRAME_METRICS)
def components26(spark, sf_dir):
    return _metrics(cluster(b.event_voxels(spark, sf_dir), "cc3d", ClusterParams(connectivity=26)))


@query("components6_lineitem", _labelled(b.LINEITEM_VOXELS, _adjacent(1)) + FRAME_METRICS)
def components6_lineitem(spark, sf_dir):
    return _metrics(cluster(b.lineitem_voxels(spark, sf_dir), "gcbd"))


@query("components26_embeddings", _labelled(b.EMBEDDING_VOXELS, _adjacent(3)) + FRAME_METRICS)
def components26_embeddings(spark, sf_dir):
    return _metrics(cluster(b.embedding_voxels(spark, sf_dir), "cc3d_optimized", ClusterParams(connectivity=26)))


def _wrapped_near(dims=b.WRAPPED_DIMS) -> str:
    d = " + ".join(f"least(abs(p.{c} - q.{c}), {n} - abs(p.{c} - q.{c}))" for c, n in zip("ijk", dims, strict=True))
    return f"{d} <= 1"


LONG_BOUNDS, LONG_DIMS = (0.0, 256.0, 0.0, 16.0, 0.0, 16.0), (256, 16, 16)
LONG_WRAPPED = f"select distinct frame, i % 256 as i, j % 16 as j, k % 16 as k from ({b.EVENT_VOXELS})"


@query("components6_pbc", _labelled(LONG_WRAPPED, _wrapped_near(LONG_DIMS)) + FRAME_METRICS)
def components6_pbc(spark, sf_dir):
    # All voxels, in a box long enough that larger tables do not fill it at once.
    config = b.config(bounds=LONG_BOUNDS, periodic=True)
    atoms = b.event_atoms(spark, sf_dir)
    grid = grid_spec(atoms, b.frames_of(atoms), config)
    return _metrics(cluster(rasterize(atoms, grid, config), "traditional_dfs", grid=grid, periodic=True))


@query("partition_labels", EV6 + " select frame, i, j, k, label from l")
def partition_labels(spark, sf_dir):
    return cluster(b.event_voxels(spark, sf_dir), "rle_ccl_optimized")


@query("components_distributed", EV6 + " select frame, i, j, k, label from l")
def components_distributed(spark, sf_dir):
    b.shared_checkpoints(spark)
    return components(b.event_voxels(spark, sf_dir), strategy="runs")


@query("components26_distributed", EV26 + " select frame, i, j, k, label from l")
def components26_distributed(spark, sf_dir):
    b.shared_checkpoints(spark)
    return components(b.event_voxels(spark, sf_dir), 26, strategy="distributed")


@query("cluster_sizes", EV6 + " select frame, label, count(*)::int as size from l group by frame, label")
def sizes(spark, sf_dir):
    return cluster_sizes(cluster(b.event_voxels(spark, sf_dir), "rle_ccl"))


@query("size_histogram", EV6 + " select size::int as size, count(*)::bigint as clusters from (select frame, label, count(*) as size from l group by frame, label) group by size")
def histogram(spark, sf_dir):
    return size_histogram(cluster(b.event_voxels(spark, sf_dir), "traditional_dfs"))


@query(
    "rle_runs",
    f"""select frame, i, j, min(k)::int as start, max(k)::int as stop from (
        select *, k - row_number() over (partition by frame, i, j order by k) as island from ({b.EVENT_VOXELS})) group by frame, i, j, island""",
)
def rle_runs(spark, sf_dir):
    return runs_of(b.event_voxels(spark, sf_dir))


# --- lattices ----------------------------------------------------------------------------------------------------


def _sites(config) -> str:
    """All sites around the grid of the bindings, rounded, with repeats."""
    basis = scaled_basis(config)
    offsets = ", ".join(f"({', '.join(map(repr, o))})" for o in OFFSETS[config.lattice.centering])
    reach = [range(-40, 80) if config.lattice.kind != "cubic" else range(-2, 60)] * 3
    span = [f"(select unnest(range({r.start}, {r.stop}))::double as t{n}) as s{n}" for n, r in enumerate(reach)]
    place = [f"round(((t0 + o0) * {basis[0][k]!r}::double + (t1 + o1) * {basis[1][k]!r}::double) + (t2 + o2) * {basis[2][k]!r}::double + {config.lattice_origin[k]!r}::double)::int" for k in range(3)]
    return f"select {place[0]} as i, {place[1]} as j, {place[2]} as k from {', '.join(span)}, (values {offsets}) as o(o0, o1, o2)"


# The queries run in the bindings' box, made longer where a table reaches beyond it. Their oracles generate sites for its first 32 planes only, which hold all of sf0.01 and number
# voxels alike; on larger tables the oracles do not apply.
SMALL_BOUNDS, SMALL_DIMS = (0.0, 32.0, 0.0, 32.0, 0.0, 32.0), (32, 32, 32)


def _whole_box(atoms: DataFrame) -> tuple[float, ...]:
    """The bindings' box, its upper edges doubled until they hold all atoms."""
    ends = atoms.agg(*[F.max(c) for c in "xyz"]).first()
    edges = list(b.BOUNDS[1::2])
    for axis, end in enumerate(ends):
        while end is not None and end >= edges[axis]:
            edges[axis] *= 2
    return (0.0, edges[0], 0.0, edges[1], 0.0, edges[2])


def _seed_query(name: str, kind: str, centering: str, dnn: float = 2.4, origin=(0.0, 0.0, 0.0), **shape):
    config = b.config(bounds=SMALL_BOUNDS, lattice=Lattice(kind, centering, **shape), dnn=dnn, lattice_origin=origin)
    voxels = _in_grid(b.EVENT_VOXELS, SMALL_DIMS)

    @query(name, f"select v.frame, v.i, v.j, v.k, v.lin from ({voxels}) v where exists (select 1 from ({_sites(config)}) s where s.i = v.i and s.j = v.j and s.k = v.k)")
    def run(spark, sf_dir):
        atoms = b.event_atoms(spark, sf_dir)
        whole = replace(config, bounds=_whole_box(atoms))
        grid = grid_spec(atoms, b.frames_of(atoms), whole)
        return seeds(rasterize(atoms, grid, whole), grid, whole)


_seed_query("lattice_seeds_cubic_p", "cubic", "P")
_seed_query("lattice_seeds_cubic_i", "cubic", "I")
_seed_query("lattice_seeds_cubic_f", "cubic", "F")
_seed_query("lattice_seeds_hex", "hexagonal", "F")
_seed_query("lattice_seeds_triclinic", "triclinic", "P", lengths=(1.0, 1.2, 1.4), angles=(80.0, 95.0, 105.0))
_seed_query("lattice_seeds_origin", "cubic", "F", origin=(0.3, -1.25, 0.7))
CENSUS = b.config(bounds=SMALL_BOUNDS)


def _periodic_sites(config, dims) -> str:
    """Places per axis and centering offset of a cubic lattice stretched to a periodic box, and the voxels that they meet on all three."""
    edge = scaled_basis(config)[0][0]
    cells = [max(1, math.ceil(n / edge - 1e-9)) for n in dims]
    axes = [
        f"select distinct {n} as o, (round({dims[k] / cells[k]!r}::double * (t + {o[k]!r}::double) + {config.lattice_origin[k]!r}::double)::int % {dims[k]} + {dims[k]}) % {dims[k]} as {c}"
        f" from (select unnest(range(0, {cells[k]}))::double as t)"
        for n, o in enumerate(OFFSETS[config.lattice.centering]) for k, c in enumerate("ijk")
    ]
    at = {c: " union all ".join(axes[k::3]) for k, c in enumerate("ijk")}
    return f"select distinct v.* from v join ({at['i']}) si on si.i = v.i join ({at['j']}) sj on sj.j = v.j and sj.o = si.o join ({at['k']}) sk on sk.k = v.k and sk.o = si.o"


PERIODIC_LATTICE = b.config(bounds=WIDE_WRAPPED_BOUNDS, periodic=True, lattice_origin=(0.25, -0.5, 1.75))
PERIODIC_VOXELS = f"select distinct frame, i % 256 as i, j % 32 as j, k % 32 as k from ({b.EVENT_VOXELS})"


@query("lattice_seeds_periodic", f"with v as ({_in_grid(PERIODIC_VOXELS, WIDE_WRAPPED_DIMS)}) " + _periodic_sites(PERIODIC_LATTICE, WIDE_WRAPPED_DIMS))
def lattice_seeds_periodic(spark, sf_dir):
    atoms = b.event_atoms(spark, sf_dir)
    grid = grid_spec(atoms, b.frames_of(atoms), PERIODIC_LATTICE)
    return seeds(rasterize(atoms, grid, PERIODIC_LATTICE), grid, PERIODIC_LATTICE)


@query(
    "probe_census",
    f"select count(*)::bigint as probes, count(distinct (i, j, k))::bigint as voxels from ({_sites(CENSUS)}) where i between 0 and 31 and j between 0 and 31 and k between 0 and 31",
)
def probe_census(spark, sf_dir):
    return census(spark, CENSUS, SMALL_DIMS).agg(F.count(F.lit(1)).alias("voxels")).select(F.lit(probes(CENSUS, SMALL_DIMS)).cast("long").alias("probes"), "voxels")


def _lattice_run(spark, sf_dir):
    atoms = b.event_atoms(spark, sf_dir)
    config = b.config(bounds=_whole_box(atoms))
    grid = grid_spec(atoms, b.frames_of(atoms), config)
    voxels = rasterize(atoms, grid, config)
    return met_components(components(voxels, 6), seeds(voxels, grid, config))


LATTICE_CTES = _labelled(f"select frame, i, j, k from ({_in_grid(b.EVENT_VOXELS, SMALL_DIMS)})", _adjacent(1)) + f"""
    , site as (select distinct i, j, k from ({_sites(CENSUS)}))
    , hit as (select l.frame, l.label, min(l.lin) as seed from l join site using (i, j, k) group by l.frame, l.label)
    , found as (select frame, label, (dense_rank() over (partition by frame order by seed) - 1)::bigint as id from hit)"""


@query("lattice_clusters", LATTICE_CTES + " select l.frame, l.i, l.j, l.k, found.id as label from l join found using (frame, label)")
def lattice_run(spark, sf_dir):
    return _lattice_run(spark, sf_dir).where("found is not null").select("frame", "i", "j", "k", F.col("found").alias("label"))


@query(
    "size_floor",
    LATTICE_CTES + """
    , s as (select frame, label, count(*) as size from l group by frame, label)
    select size::bigint as size, count(*)::bigint as present, sum(case when id is null then 1 else 0 end)::bigint as missed,
        (count(*) - sum(case when id is null then 1 else 0 end))::double / count(*)::double as recall
    from s left join found using (frame, label) group by size""",
)
def floor_by_size(spark, sf_dir):
    return recall_by_size(outcomes(_lattice_run(spark, sf_dir)))


def _sweep_oracle() -> str:
    """Recall at each origin of the diagonal set."""
    origins = offset_set(CENSUS, "diagonal8")
    each = " union all ".join(f"select {n} as offset_no, i, j, k from (select distinct i, j, k from ({_sites(c)}))" for n, c in enumerate(origins))
    return _labelled(f"select frame, i, j, k from ({_in_grid(b.EVENT_VOXELS, SMALL_DIMS)})", _adjacent(1)) + f"""
    , site as ({each}), every as (select distinct frame, label from l)
    , met as (select distinct offset_no, frame, label from l join site using (i, j, k))
    select o::int as "offset", (select count(*) from every)::bigint as present, count(met.label)::bigint as detected, round(count(met.label)::double / (select count(*) from every), 12) as recall
    from (select unnest(range(0, 8)) as o) left join met on met.offset_no = o group by o"""


@query("offset_sweep_diagonal", _sweep_oracle())
def offset_sweep_diagonal(spark, sf_dir):
    atoms = b.event_atoms(spark, sf_dir)
    config = b.config(bounds=_whole_box(atoms))
    grid = grid_spec(atoms, b.frames_of(atoms), config)
    return recall(offset_sweep(rasterize(atoms, grid, config), grid, config, "diagonal8")).withColumn("recall", F.round("recall", 12))


@query(
    "truncation_outcomes",
    LATTICE_CTES + """
    , per as (select l.frame, l.label, count(*) as size, count(t.id) as reached, count(distinct t.id) as ids
        from l left join (select l.frame, l.lin, found.id from l join found using (frame, label) where l.k % 3 <> 0) t using (frame, lin) group by l.frame, l.label)
    select case when reached = 0 then 'missed' when ids > 1 then 'split' when reached < size then 'truncated' else 'found' end as outcome,
        count(*)::bigint as components, sum(size)::bigint as voxels, sum(reached)::bigint as reached
    from per group by 1""",
)
def truncation_outcomes(spark, sf_dir):
    # A labelling that lost every third plane along k, so that all outcomes but splits occur.
    run = _lattice_run(spark, sf_dir)
    both = run.withColumn("found", F.when(F.col("k") % 3 != 0, F.col("found")))
    return outcomes(both).groupBy("outcome").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("voxels"), F.sum("reached").alias("reached"))


@query(
    "merged_components",
    EV6 + _labelled(b.EVENT_VOXELS, _adjacent(3), tag="26")
    + " select frame, l26.label as id, count(distinct l.label)::bigint as components from l join l26 using (frame, lin) group by frame, l26.label having count(distinct l.label) > 1",
)
def merged_components(spark, sf_dir):
    voxels = b.event_voxels(spark, sf_dir)
    return merged(components(voxels, 6), components(voxels, 26))


# --- density, linkage and centroid methods -----------------------------------------------------------------------

_APART = "(p.i - q.i) * (p.i - q.i) + (p.j - q.j) * (p.j - q.j) + (p.k - q.k) * (p.k - q.k)"


def _dbscan(eps: int, min_pts: int) -> str:
    counted = f"""select *, (select count(*) from ({b.EVENT_VOXELS}) q where q.frame = p.frame and {_APART} <= {eps * eps}) >= {min_pts} as core from ({b.EVENT_VOXELS}) p"""
    return _labelled(counted, f"{_APART} <= {eps * eps}", "core") + f"""
    , every as (select frame, i, j, k, label from l union all
        select p.frame, p.i, p.j, p.k, min(q.label) from v p join l q on p.frame = q.frame and {_APART} <= {eps * eps} where not p.core group by all)"""


@query("dbscan", _dbscan(2, 4) + " select frame, i, j, k, label from every")
def dbscan(spark, sf_dir):
    return cluster(b.event_voxels(spark, sf_dir), "dbscan", ClusterParams(eps=2.0, min_pts=4))


@query("dbscan_noise", _dbscan(2, 4) + " select v.frame, count(*)::bigint as voxels, (count(*) - count(every.label))::bigint as noise from v left join every using (frame, i, j, k) group by v.frame")
def dbscan_noise(spark, sf_dir):
    voxels = b.event_voxels(spark, sf_dir)
    members = cluster(voxels, "dbscan", ClusterParams(eps=2.0, min_pts=4)).groupBy("frame").agg(F.count(F.lit(1)).alias("members"))
    every = voxels.groupBy("frame").agg(F.count(F.lit(1)).alias("voxels"))
    return every.join(members, "frame", "left").select("frame", "voxels", (F.col("voxels") - F.coalesce("members", F.lit(0))).alias("noise"))


@query("single_linkage", _labelled(b.EVENT_VOXELS, f"{_APART} <= 4") + " select frame, i, j, k, label from l")
def linkage(spark, sf_dir):
    return cluster(b.event_voxels(spark, sf_dir), "hierarchical", ClusterParams(threshold=2.0))


@query("skip_dfs1", EV6 + " select frame, i, j, k, label from l")
def skip_dfs1(spark, sf_dir):
    return cluster(b.event_voxels(spark, sf_dir), "skip_dfs", ClusterParams(skip=1))


def _method_query(key: str, method: str, params: ClusterParams):
    @query(key)
    def run(spark, sf_dir):
        return summarize(cluster(b.event_voxels(spark, sf_dir), method, params))


_method_query("kmeans", "kmeans", ClusterParams(k=20))
_method_query("skip_dfs3", "skip_dfs", ClusterParams(skip=3))
_method_query("hdbscan", "hdbscan", ClusterParams())
_method_query("vccs", "vccs", ClusterParams(eps=3.0))
_method_query("vccs_optimized", "vccs_optimized", ClusterParams(eps=3.0))


# Eight voxels a byte in raster order, lowest bit first.
@query(
    "occupancy_sha256",
    f"""with held as (select frame, lin // 8 as byte, bit_or(1 << (lin % 8)::int) as bits from ({_in_grid(b.EVENT_VOXELS)}) group by 1, 2)
    , every as (select frame, byte from (select distinct frame from held), (select unnest(range(0, {math.prod(b.DIMS) // 8})) as byte))
    select frame, sha256(unhex(string_agg(printf('%02x', coalesce(bits, 0)::int), '' order by byte))) as occ_sha256 from every left join held using (frame, byte) group by frame""",
)
def occupancy(spark, sf_dir):
    atoms, config = b.event_atoms(spark, sf_dir), b.config()
    grid = grid_spec(atoms, b.frames_of(atoms), config)
    return fingerprints(rasterize(atoms, grid, config), grid)


# --- running totals and comparison -------------------------------------------------------------------------------


@query(
    "bench_running",
    """select frame, sum(elapsed_ms) over w as cumulative_ms, max(rss_bytes) over w as peak_rss_bytes, 1 as replicate
    from (select day(ts)::bigint as frame, count(*)::bigint as elapsed_ms, max(user_id)::bigint as rss_bytes from events group by 1)
    window w as (order by frame rows between unbounded preceding and current row)""",
)
def bench_running(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.groupBy(F.dayofmonth("ts").cast("long").alias("frame")).agg(F.count(F.lit(1)).alias("elapsed_ms"), F.max("user_id").alias("rss_bytes"))
    return running_totals(rows.withColumn("replicate", F.lit(1)))


def _compared(ours: str, other: str) -> str:
    """All columns of a comparison of two CTEs (place, n, m, ms, sizes): ``sizes`` descending lists."""
    return f"""
    , paired as (select x.n as n1, x.m as m1, x.ms as ms1, x.sizes as s1, y.n as n2, y.m as m2, y.ms as ms2, y.sizes as s2, place from {ours} x join {other} y using (place))
    , spots as (select place, s1, s2, unnest(range(1, least(len(s1), len(s2)) + 1)) as p, least(len(s1), len(s2)) as common from paired)
    , signs as (select place, sign(s1[p] - s1[q]) * sign(s2[p] - s2[q]) as s from (select *, unnest(range(p + 1, common + 1)) as q from spots))
    , taus as (select place, coalesce(sum(s)::double / nullif(count(*) filter (where s <> 0), 0), 1.0) as tau from paired left join signs using (place) group by place)
    select count(*)::bigint as frames, avg(abs(m1 - m2))::double as mean_abs_max_cluster, round(sqrt(avg((m1 - m2)::double * (m1 - m2))), 9) as rmse_max_cluster,
        avg(abs(n1 - n2))::double as mean_abs_nclusters, round(sqrt(avg((n1 - n2)::double * (n1 - n2))), 9) as rmse_nclusters,
        round(avg(ms1 - ms2), 9) as mean_elapsed_difference, round(sum(ms2)::double / sum(ms1), 9) as speedup, round(avg(tau), 9) as mean_tau
    from paired join taus using (place)"""


def _rounded(comparison: DataFrame) -> DataFrame:
    """Sums of fractions depend on their order, so those columns are compared to nine places."""
    fractions = ("rmse_max_cluster", "rmse_nclusters", "mean_elapsed_difference", "speedup", "mean_tau")
    return comparison.withColumns({c: F.round(c, 9) for c in fractions})


def _run_cte(name: str, labels: str, ms: str) -> str:
    return f"""
    , {name} as (select row_number() over (order by frame) as place, count(*) as n, max(size) as m, {ms} as ms, list(size order by size desc) as sizes
        from (select frame, label, count(*) as size from {labels} group by frame, label) group by frame)"""


_EVENTS_RUN = """
    , z as (select row_number() over (order by frame) as place, n, m, 1.0::double as ms, list_reverse_sort([m, n, n // 2, n // 3]) as sizes
        from (select day(ts)::bigint as frame, count(*)::int as n, max(user_id)::int as m from events group by 1))"""


@query("compare_runs", EV6 + _run_cte("a", "l", "count(*)::double") + _EVENTS_RUN + _compared("a", "z"))
def compare(spark, sf_dir):
    ours = summarize(components(b.event_voxels(spark, sf_dir), 6)).withColumn("elapsed_ms", F.col("nclusters").cast("double"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    other = events.groupBy(F.dayofmonth("ts").cast("long").alias("frame")).agg(
        F.count(F.lit(1)).cast("int").alias("nclusters"), F.max("user_id").cast("int").alias("max_cluster")
    ).withColumn("elapsed_ms", F.lit(1.0))
    sizes = F.array("max_cluster", "nclusters", F.floor(F.col("nclusters") / 2).cast("int"), F.floor(F.col("nclusters") / 3).cast("int"))
    return _rounded(compare_runs(ours, other.withColumn("cluster_sizes", F.sort_array(sizes, asc=False))))


@query(
    "compare_methods",
    EV6 + _labelled(b.EVENT_VOXELS, _adjacent(3), tag="26") + _run_cte("a", "l", "sum(size)::double / count(*)") + _run_cte("z", "l26", "sum(size)::double / count(*)") + _compared("a", "z"),
)
def compare_methods(spark, sf_dir):
    voxels = b.event_voxels(spark, sf_dir)

    def run(connectivity: int) -> DataFrame:
        return summarize(components(voxels, connectivity)).withColumn("elapsed_ms", F.col("refined_voxels") / F.col("nclusters"))

    return _rounded(compare_runs(run(6), run(26)))
