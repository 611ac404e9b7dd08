"""Result files: metrics as CSV and JSON lines, running totals, and the reader of other programs' result tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.operators.metrics import COLUMNS, number_text

# Accepted spellings of a result table's columns.
NAMES = {
    "frame": "frame", "time": "time", "t": "time", "nclusters": "nclusters", "ncluster": "nclusters", "max_cluster": "max_cluster",
    "elapsed_ms": "elapsed_ms", "elapsed": "elapsed_ms", "cluster_sizes": "cluster_sizes",
}
REFERENCE = "frame long, time double, nclusters int, max_cluster int, elapsed_ms double, cluster_sizes array<int>"


def write_metrics_csv(rows: DataFrame, path: str) -> None:
    """One file with a header, ordered by frame. One short row a frame, so the file is small next to its trajectory."""
    header = ",".join(COLUMNS)
    with open(path, "w") as f:
        f.write(header + "\n")
        for row in rows.select(*COLUMNS).orderBy("frame").toLocalIterator():
            f.write(",".join(number_text(v) if v is None or isinstance(v, float) else str(v) for v in row) + "\n")


def write_metrics(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A folder of part files, written in parallel; frames are range-partitioned, so the parts are in order."""
    ordered = rows.repartitionByRange("frame").sortWithinPartitions("frame")
    if kind == "csv":
        ordered.select(*COLUMNS).write.mode("overwrite").option("header", "true").csv(path)
    else:
        json_rows(ordered).write.mode("overwrite").json(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """The JSON form: nested h and origin, sizes only where there are any, no replicate."""
    nested = {"h": F.array("h_x", "h_y", "h_z"), "origin": F.array("origin_x", "origin_y", "origin_z")}
    left_out = {"replicate", "h_x", "h_y", "h_z", "origin_x", "origin_y", "origin_z"}
    kept: list[Column] = [F.col(c) for c in COLUMNS if c not in left_out]
    sizes = F.when(F.size("cluster_sizes") > 0, F.col("cluster_sizes")).alias("cluster_sizes")
    return rows.select(*kept, *[c.alias(n) for n, c in nested.items()], sizes)


def parse_results(text: str) -> list[tuple]:
    """Rows of a result table: fields apart by commas if the header's are, else by blanks; @ lines skipped, the header perhaps behind # marks.

    Cluster sizes are apart by semicolons, in tables with blanks perhaps by commas.
    """
    names, commas, rows = None, False, []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("@"):
            continue
        if names is None or line.startswith("#"):
            bare = re.sub(r"^(#!\s*FIELDS|#!|#)\s*", "", line)
            fields = [x for x in re.split(r"[,\s]+", bare) if x]
            if names is None and {NAMES.get(x.lower()) for x in fields} & {"time", "nclusters", "max_cluster"}:
                names, commas = [NAMES.get(x.lower()) for x in fields], "," in bare
            continue
        fields = [x.strip() for x in line.split(",")] if commas else line.split()
        got = {n: v for n, v in zip(names, fields, strict=False) if n}
        sizes = [int(x) for x in re.split("[;,]", got.get("cluster_sizes", "")) if x.strip()]
        number = lambda n, kind, got=got: kind(float(got[n])) if got.get(n) else kind(0)
        rows.append((number("frame", int), number("time", float), number("nclusters", int), number("max_cluster", int), number("elapsed_ms", float), sorted(sizes, reverse=True)))
    if names is None:
        raise ValueError("the table names none of time, nclusters and max_cluster")
    return rows


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Another program's result table, with its rows numbered where it has no frames of its own."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path) as f:
        rows = parse_results(f.read())
    if rows and not any(r[0] for r in rows):
        rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    return spark.createDataFrame(rows, REFERENCE)
