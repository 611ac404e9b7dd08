import struct

import numpy as np
import pytest

from tests import oracles as o
from voxelflow.config import Config, FrameWindow, Lattice, Selection
from voxelflow.operators.compare import compare_runs, running_totals, size_floor
from voxelflow.operators.metrics import COLUMNS, number_text
from voxelflow.plans.analyze import analyze
from voxelflow.sources import binary_formats, results, text_formats
from voxelflow.sources.trajectory import read_topology, read_trajectory, resolve_format
from voxelflow.streaming.ingest import stream_metrics


def write(path, data):
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


# --- writers of test files ---------------------------------------------------------------------------------------


# The format's size table as published, kept apart from the reader's.
SIZES = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048,
    2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144,
    330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
]


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - k)) & 1 for k in range(n)]

    def mixed(self, numbers, sizes, n):
        value = (numbers[0] * sizes[1] + numbers[1]) * sizes[2] + numbers[2]
        count = (n + 7) // 8
        for k in range(count):
            self.put((value >> (8 * k)) & 255, 8 if k < count - 1 else n - 8 * (count - 1))

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << (7 - k) for k, b in enumerate(padded[i : i + 8])) for i in range(0, len(padded), 8))


def pack(points, small, grow):
    """Coordinates as full ones with runs of up to two differences where they fit; ``grow`` changes the size index on the way."""
    low, high = points.min(axis=0), points.max(axis=0)
    sizes = [int(x) for x in high - low + 1]
    width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    w, at, first, run = BitWriter(), 0, small, 0

    def full(p):
        if max(sizes) > 0xFFFFFF:
            for x, s in zip(p - low, sizes, strict=True):
                w.put(int(x), s.bit_length())
        else:
            w.mixed([int(x) for x in p - low], sizes, width)

    while at < len(points):
        radix = SIZES[small]
        half = radix // 2
        fits = lambda a, b: (np.abs(a - b) < half).all()  # noqa: E731, B023
        length = 0
        if at + 1 < len(points) and fits(points[at], points[at + 1]):
            length = 2 if at + 2 < len(points) and fits(points[at + 2], points[at + 1]) else 1
        # Of a run the first two atoms change places: the second is written whole.
        full(points[at + 1] if length else points[at])
        change = grow if length and small + grow < 60 else 0
        if length * 3 != run or change:
            w.put(1, 1)
            w.put(length * 3 + change + 1, 5)
            run = length * 3
        else:
            w.put(0, 1)
        if length:
            w.mixed([int(x) + half for x in points[at] - points[at + 1]], [radix] * 3, small)
            if length == 2:
                w.mixed([int(x) + half for x in points[at + 2] - points[at + 1]], [radix] * 3, small)
        at += 1 + length
        small += change
    return w.bytes(), low, high, first


def xtc_bytes(frames, precision=1000.0, small=20, grow=0):
    out = b""
    for n, (points, box) in enumerate(frames):
        out += struct.pack(">iiif", 1995, len(points), n, n * 1.5) + np.asarray(box, ">f4").tobytes() + struct.pack(">i", len(points))
        if len(points) <= 9:
            out += np.asarray(points, ">f4").tobytes()
            continue
        whole = np.rint(np.asarray(points) * precision).astype(np.int64)
        data, low, high, first = pack(whole, small, grow)
        out += struct.pack(">f8i", precision, *low, *high, first, len(data)) + data + b"\0" * (-len(data) % 4)
    return out


def trr_bytes(frames, kind, velocities=False):
    out, size = b"", struct.calcsize(kind)
    for n, (points, box) in enumerate(frames):
        body = 3 * len(points) * size
        out += struct.pack(">iii", 1993, 13, 12) + b"GMX_trn_file"
        out += struct.pack(">13i", 0, 0, 9 * size, 0, 0, 0, 0, body, body * velocities, 0, len(points), n, 0)
        out += struct.pack(f">{kind}{kind}", n * 2.0, 0.0) + np.asarray(box, f">f{size}").tobytes() + np.asarray(points, f">f{size}").tobytes() * (1 + velocities)
    return out


BOX = [[5, 0, 0], [1, 6, 0], [0.5, 0.25, 7]]


def walk(n, seed=0, step=0.02):
    return np.cumsum(np.random.default_rng(seed).normal(0, step, (n, 3)), axis=0) + 3


# --- formats -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, step, grow", [(3, 0.1, 0), (9, 0.1, 0), (10, 0.02, 0), (200, 0.02, 0), (200, 0.01, 1), (200, 0.02, -1), (50, 30.0, 0), (12, 9000.0, 0)])
def test_xtc_round_trip(tmp_path, n, step, grow):
    frames = [(walk(n, s, step), BOX) for s in range(3)]
    path = write(tmp_path / "a.xtc", xtc_bytes(frames, small=27, grow=grow))
    with open(path, "rb") as f:
        got = list(binary_formats.frames(f, "xtc"))
    assert [g.time_ps for g in got] == [0, 1.5, 3]
    for g, (points, _) in zip(got, frames, strict=True):
        assert g.cell == (5, 0, 0, 1, 6, 0, 0.5, 0.25, 7)
        assert np.abs(g.positions - points).max() <= (0.00051 if n > 9 else 1e-6) * max(1, np.abs(points).max() / 100)


def test_small_sizes():
    assert list(binary_formats.SMALL_SIZES) == SIZES and len(SIZES) == 73


@pytest.mark.parametrize("kind", ["f", "d"])
@pytest.mark.parametrize("velocities", [False, True])
def test_trr_round_trip(tmp_path, kind, velocities):
    frames = [(walk(7, s), BOX) for s in range(4)]
    path = write(tmp_path / "a.trr", trr_bytes(frames, kind, velocities))
    with open(path, "rb") as f:
        got = list(binary_formats.frames(f, "trr"))
    assert [g.time_ps for g in got] == [0, 2, 4, 6]
    assert all(np.abs(g.positions - p).max() < 1e-6 for g, (p, _) in zip(got, frames, strict=True))
    with pytest.raises(text_formats.FormatError), open(path, "rb") as f:
        list(binary_formats.frames(f, "xtc"))


def test_pdb_rules():
    text = o.pdb_text([[("O", 1, 2, 3)], [("O", 4, 5, 6), ("H", 7, 8, 9)]], [(30, 30, 30, 90, 90, 90), (44, 40, 36, 80, 85, 75)])
    a, b = text_formats.pdb(text.splitlines())
    assert a.positions.tolist() == [[1, 2, 3]] and a.cell[0] == 30 and (a.time_ps, b.time_ps) == (0, 2.5) and b.cell[0] == 44
    line = text.splitlines()[2]
    no_end = ["MODEL 1", line, "MODEL 2", line, line[:50], "#CRYST1" + " " * 70, "CRYST1 1 1 1"]
    assert [len(f.positions) for f in text_formats.pdb(no_end)] == [1, 1]
    assert [len(f.positions) for f in text_formats.pdb(["MODEL 1", "ENDMDL", line, "ENDMDL"])] == [1]


def test_gro_xyz_mol():
    atom = "    1SOL     OW    1   0.100   0.200   0.300"
    one = ["water t= 12.5", "1", atom, "   1.0 2.0 3.0 0 0 0 0 0 0"]
    got = list(text_formats.gro(one + one))
    assert [g.time_ps for g in got] == [12.5, 12.5] and got[0].cell == (1, 0, 0, 0, 2, 0, 0, 0, 3) and got[0].positions.tolist() == [[0.1, 0.2, 0.3]]
    with pytest.raises(text_formats.FormatError):
        list(text_formats.gro(["x", "1", "short", ""]))
    lines = ["1", 'Lattice="1 0 0 0 2 0 0 1 3" time=4.5', "O 1 2 3", "", "1", "10 11 12 90 90 90 t: 7", "O 1 2 3", "1", "5 6 7", "O 0 0 0", "1", "none", "O 0 0 0"]
    cells = [(g.cell[:5], g.time_ps) for g in text_formats.xyz(lines)]
    assert cells[0] == ((1, 0, 0, 0, 2), 4.5) and cells[1][0][0] == 10 and cells[1][1] == 7 and cells[2][0] == (5, 0, 0, 0, 6) and cells[3][0] == (0,) * 5
    v2 = ["m", "", "", "  2  0  0  0  0  0            999 V2000", "    1.0000    2.0000    3.0000 O", "4 5 6 H", "M  END", "> <tag>", "x", "$$$$"]
    v3 = ["m", "", "", "  0  0  0     0  0            999 V3000", "M  V30 BEGIN CTAB", "M  V30 COUNTS 1 0 0 0 0", "M  V30 BEGIN ATOM", "M  V30 1 O 1 2 3 0", "M  V30 END ATOM", "M  V30 END CTAB", "M  END", "$$$$"]
    got = list(text_formats.mol(v2 + v3))
    assert [g.positions.tolist() for g in got] == [[[1, 2, 3], [4, 5, 6]], [[1, 2, 3]]] and [g.time_ps for g in got] == [0, 1]


def test_format_dispatch():
    assert resolve_format("a/B.PDB") == "pdb" and resolve_format("x.dat", "XTC") == "xtc"
    for bad in ("x.dat", "x.tng"):
        with pytest.raises(ValueError):
            resolve_format(bad)


# --- the data source ---------------------------------------------------------------------------------------------


def test_source_reads_splits_and_prunes(spark, tmp_path, monkeypatch):
    frames = [(walk(12, s), BOX) for s in range(150)]
    path = write(tmp_path / "t.xtc", xtc_bytes(frames))
    atoms, meta = read_trajectory(spark, path)
    assert atoms.rdd.getNumPartitions() == 3 and atoms.count() == 150 * 12
    assert atoms.where("frame >= 140").rdd.getNumPartitions() == 1
    assert sorted(r.frame for r in meta.where("frame > 60 and frame <= 63").collect()) == [61, 62, 63]
    one = meta.where("frame = 7").first()
    assert (one.natoms, one.time_ps, one.cz) == (12, 10.5, 7)
    assert meta.where("frame = 999").count() == 0


def test_folders_scale_and_topology(spark, tmp_path):
    write(tmp_path / "1.pdb", o.pdb_text([[("O", 1, 2, 3), ("H", 1, 2, 4)]] * 2))
    write(tmp_path / "2.pdb", o.pdb_text([[("O", 9, 9, 9)]]))
    atoms, meta = read_trajectory(spark, str(tmp_path), scale=10.0)
    assert [(r.frame, r.natoms) for r in meta.orderBy("frame").collect()] == [(0, 2), (1, 2), (2, 1)]
    assert atoms.where("frame = 2").first().x == 90
    assert [tuple(r) for r in read_topology(spark, str(tmp_path / "1.pdb")).collect()] == [(0, "O"), (1, "H")]
    gro = write(tmp_path / "t.gro", "x\n2\n    1SOL     OW    1   0.100   0.200   0.300\n    1SOL    HW1    2   0.100   0.200   0.300\n 1 1 1\n")
    assert [r.name for r in read_topology(spark, gro).collect()] == ["OW", "HW1"]
    with pytest.raises(ValueError):
        read_topology(spark, str(tmp_path / "t.xyz"))


# --- whole runs --------------------------------------------------------------------------------------------------


def chain_and_blob():
    chain = [("O", 1 + 3.2 * n, 20, 20) for n in range(13)]
    return chain + [("H", 20 + 2 * (n % 2), 5 + 2 * (n // 2 % 2), 5 + 2 * (n // 4)) for n in range(8)]


def test_run_over_a_trajectory(spark, tmp_path):
    path = write(tmp_path / "t.pdb", o.pdb_text([chain_and_blob()] * 4, [(40, 40, 40, 90, 90, 90)] * 4))
    config = Config(box="cell", spacing=2.0, cutoff=1.0, dnn=0.5, lattice=Lattice("cubic", "F"))
    run = analyze(spark, path, config, window=FrameWindow(1, 3, 2))
    rows = run.metrics.orderBy("frame").collect()
    assert [r.frame for r in rows] == [1, 3] and run.metrics.columns == [*COLUMNS, "cluster_sizes"]
    assert all(r.natoms == 21 and r.nclusters == 2 == r.seed_hits and r.lattice == "cubic" for r in rows)
    exact = analyze(spark, path, config, "dfs").metrics.first()
    assert (exact.nclusters, exact.max_cluster, exact.centering, exact.probes) == (2, rows[0].max_cluster, "-", 0)
    only = analyze(spark, path, Config(box="cell", spacing=2.0, cutoff=1.0, selection=Selection(names=("H",))), "uf", topology=path).metrics.first()
    assert (only.nclusters, only.natoms) == (1, 21)
    run.create_views("t")
    assert spark.sql("select count(*) as n from t_metrics").first().n == 2


def test_result_files(spark, tmp_path):
    path = write(tmp_path / "t.pdb", o.pdb_text([chain_and_blob()] * 3))
    metrics = analyze(spark, path, Config(spacing=2.0, cutoff=1.0), "rle").metrics
    results.write_metrics_csv(metrics, str(tmp_path / "m.csv"))
    lines = (tmp_path / "m.csv").read_text().splitlines()
    assert lines[0] == ",".join(COLUMNS) and len(lines) == 4 and lines[1].split(",")[14] == "nan" and lines[1].endswith(",n/a")
    results.write_metrics(metrics, str(tmp_path / "j"), "json")
    row = spark.read.json(str(tmp_path / "j")).orderBy("frame").first()
    assert len(row.h) == 3 and len(row.origin) == 3 and "replicate" not in row.asDict()
    results.write_metrics(metrics, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    assert (number_text(1 / 3), number_text(None), number_text(1e-9)) == ("0.333333", "nan", "1e-09")


def test_comparison_with_another_program(spark, tmp_path):
    text = "@ skipped\n#! FIELDS time ncluster max_cluster elapsed cluster_sizes\n# note\n0 2 5 1.0 5;3\n1 1 9 3.0 9\n2 4 4 1 4;4;4;4\n"
    other = results.read_results(spark, write(tmp_path / "r.dat", text))
    assert [tuple(r)[:4] for r in other.orderBy("frame").collect()] == [(0, 0.0, 2, 5), (1, 1.0, 1, 9), (2, 2.0, 4, 4)]
    ours = spark.createDataFrame([(10, 3, 4, 2.0, [4, 3, 1]), (11, 1, 9, 2.0, [9])], "frame long, nclusters int, max_cluster int, elapsed_ms double, cluster_sizes array<int>")
    got = compare_runs(ours, other).first()
    assert (got.frames, got.mean_abs_max_cluster, got.mean_abs_nclusters, got.mean_elapsed_difference, got.speedup, got.mean_tau) == (2, 0.5, 0.5, 0.0, 1.0, 1.0)
    assert got.rmse_max_cluster == pytest.approx(0.5**0.5)
    assert results.parse_results("frame,t,nclusters\n4,1.5,2\n")[0][:3] == (4, 1.5, 2)
    with pytest.raises(ValueError):
        results.parse_results("a,b\n1,2\n")


def test_running_totals_and_size_floor(spark):
    rows = spark.createDataFrame([(0, 1.0, 5, 1), (1, 2.0, 9, 1), (2, 4.0, 7, 1), (0, 8.0, 1, 2)], "frame long, elapsed_ms double, rss_bytes long, replicate int")
    assert [tuple(r) for r in running_totals(rows).orderBy("replicate", "frame").collect()] == [(0, 1, 5, 1), (1, 3, 9, 1), (2, 7, 9, 1), (0, 8, 1, 2)]
    labels = "frame long, i int, j int, k int, label long"
    truth = spark.createDataFrame([(0, i, 0, 0, i // 3) for i in range(12)], labels)
    found = spark.createDataFrame([(0, 0, 0, 0, 7), (0, 1, 0, 0, 7), (0, 2, 0, 0, 7), (0, 3, 0, 0, 8), (0, 6, 0, 0, 1), (0, 7, 0, 0, 2)], labels)
    assert {r.label: r.outcome for r in size_floor(truth, found).collect()} == {0: "found", 1: "truncated", 2: "split", 3: "missed"}


def test_streaming_appends_each_file_once(spark, tmp_path):
    def atoms(frame):
        return spark.createDataFrame([(frame, n, float(x), float(y), float(z)) for n, (_, x, y, z) in enumerate(chain_and_blob())], "frame long, atom int, x double, y double, z double")

    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    config = Config(spacing=2.0, cutoff=1.0)
    for frame in (0, 1):
        atoms(frame).write.mode("append").parquet(source)
        stream_metrics(spark, source, sink, check, config).awaitTermination()
    out = spark.read.parquet(sink)
    assert sorted((r.frame, r.nclusters) for r in out.collect()) == [(0, 2), (1, 2)]


@pytest.mark.parametrize("small", [20, 36, 37, 38, 45])
def test_runs_at_every_kind_of_size_index(small):
    rng = np.random.default_rng(small)
    reach = SIZES[small] // 2 - 1
    points = np.cumsum(rng.integers(-reach, reach + 1, (60, 3)), axis=0)
    data, low, high, first = pack(points, small, 0)
    assert np.array_equal(binary_formats.unpack_coordinates(data, 60, list(map(int, low)), list(map(int, high)), first), points)


def test_empty_models_are_passed_over():
    atom = "ATOM      1  O   HOH A   1    %8.3f%8.3f%8.3f  1.00  0.00           O"
    lines = ["MODEL        1", atom % (1, 2, 3), "ENDMDL", "MODEL        2", "ENDMDL", "MODEL        3", atom % (4, 5, 6), "ENDMDL"]
    frames = list(text_formats.pdb(lines))
    assert [f.positions.tolist() for f in frames] == [[[1, 2, 3]], [[4, 5, 6]]]


def test_result_tables_with_blanks_and_commas_in_sizes():
    rows = results.parse_results("#! FIELDS time nclusters max_cluster elapsed cluster_sizes\n0.0 3 5 1.5 5,3,1\n1.0 2 4 2.5 1;4\n")
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows] == [(0.0, 3, 5, 1.5, [5, 3, 1]), (1.0, 2, 4, 2.5, [4, 1])]
    rows = results.parse_results("frame,time,nclusters,max_cluster,elapsed_ms,cluster_sizes\n7,0.5,2,9,1.0,3;9\n")
    assert rows == [(7, 0.5, 2, 9, 1.0, [9, 3])]
