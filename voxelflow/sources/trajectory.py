"""Trajectory files as Spark tables through a Python data source.

    spark.dataSource.register(TrajectorySource)
    spark.read.format("trajectory").option("table", "atoms").load(path)

``table`` is ``atoms`` (frame, atom, x, y, z) or ``frames`` (frame, time_ps, natoms, nine cell components). Binary files are
split by their frame offsets; a text file is one partition. Several files are one sequence of frames in order of
their names. Bounds on ``frame`` reach the source, which then plans no partition outside and decodes no frame outside.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from voxelflow.functions.geometry import CELL
from voxelflow.sources import binary_formats, text_formats

ATOMS = "frame long, atom int, x double, y double, z double"
FRAMES = "frame long, time_ps double, natoms int, " + ", ".join(f"{c} double" for c in CELL)
FRAMES_PER_PARTITION = 64
FORMATS = ("xtc", "trr", "tng", "gro", "pdb", "xyz", "mol", "sdf")


def resolve_format(path: str, chosen: str = "auto") -> str:
    """The format of a file, by name or by its extension."""
    kind = os.path.splitext(path)[1].lstrip(".").lower() if chosen == "auto" else chosen.lower()
    if kind not in FORMATS:
        raise ValueError(f"no format is known for {path}")
    if kind == "tng":
        raise ValueError("TNG needs a library that is not available here")
    return kind


def open_file(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))
    return fs.open_input_file(inner)


def list_files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")) and n.rsplit(".", 1)[-1].lower() in FORMATS)
    return [path]


class Part(InputPartition):
    def __init__(self, path: str, kind: str, first: int, offsets: list[int] | None):
        self.path, self.kind, self.first, self.offsets = path, kind, first, offsets


class TrajectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return FRAMES if self.options.get("table", "atoms") == "frames" else ATOMS

    def reader(self, schema) -> DataSourceReader:
        return TrajectoryReader(self.options)


class TrajectoryReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "atoms")
        self.chosen, self.scale = options.get("format", "auto"), float(options.get("scale", "1"))
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("frame",) and isinstance(bound, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, bound + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    top = bound - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark still checks each row; the bounds only save work

    def _wanted(self, frame: int) -> bool:
        return frame >= self.low and (self.high is None or frame <= self.high)

    def partitions(self) -> list[Part]:
        parts, first = [], 0
        files = list_files(self.path)
        for path in files:
            kind = resolve_format(path, self.chosen)
            if kind in binary_formats.READERS:
                with open_file(path) as f:
                    offsets = binary_formats.READERS[kind][0](f)
                for at in range(0, len(offsets), FRAMES_PER_PARTITION):
                    own = range(first + at, first + min(at + FRAMES_PER_PARTITION, len(offsets)))
                    if self._wanted(own[0]) or self._wanted(own[-1]) or own[0] < self.low <= own[-1]:
                        parts.append(Part(path, kind, own[0], offsets[at : at + FRAMES_PER_PARTITION]))
                first += len(offsets)
            else:
                parts.append(Part(path, kind, first, None))
                if path != files[-1]:  # only files that others follow are counted
                    with open_file(path) as f:
                        first += sum(1 for _ in text_formats.READERS[kind](_lines(f)))
        return parts or [Part("", "", 0, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open_file(part.path) as f:
            if part.offsets is not None:
                decode = binary_formats.READERS[part.kind][1]
                for n, at in enumerate(part.offsets):
                    if self._wanted(part.first + n):
                        yield self._batch(part.first + n, decode(f, at))
                return
            for n, frame in enumerate(text_formats.READERS[part.kind](_lines(f)), part.first):
                if self.high is not None and n > self.high:
                    return
                if self._wanted(n):
                    yield self._batch(n, frame)

    def _batch(self, number: int, frame: text_formats.Frame) -> pa.RecordBatch:
        n = len(frame.positions)
        if self.table == "frames":
            columns = [pa.array([number], pa.int64()), pa.array([frame.time_ps], pa.float64()), pa.array([n], pa.int32())]
            columns += [pa.array([c * self.scale], pa.float64()) for c in frame.cell]
            return pa.RecordBatch.from_arrays(columns, names=["frame", "time_ps", "natoms", *CELL])
        columns = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32())]
        columns += [pa.array(frame.positions[:, k] * self.scale, pa.float64()) for k in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["frame", "atom", "x", "y", "z"])


def _lines(f) -> Iterator[str]:
    """Decoded lines of a binary file, read block by block."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace").rstrip("\r")
    if rest:
        yield rest.decode("utf-8", "replace").rstrip("\r")


def read_trajectory(spark: SparkSession, path: str, kind: str = "auto", scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of a file or folder."""
    spark.dataSource.register(TrajectorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("trajectory").option("format", kind).option("scale", str(scale))
    return read.option("table", "atoms").load(path), read.option("table", "frames").load(path)


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """(atom, name) of a .gro or .pdb file; atoms are numbered from 0 in file order."""
    kind = resolve_format(path)
    if kind not in ("gro", "pdb"):
        raise ValueError("a topology is a .gro or .pdb file")
    with open_file(path) as f:
        lines = list(_lines(f))
    if kind == "gro":
        names = [line[10:15].strip() for line in lines[2 : 2 + int(lines[1])]]
    else:
        names = []
        for line in lines:
            if line.startswith("ENDMDL"):
                break
            if line[:6] in ("ATOM  ", "HETATM"):
                names.append(line[12:16].strip())
    return spark.createDataFrame(list(enumerate(names)), "atom int, name string")
