"""Streaming over files of whole frames. Frames are independent, so each micro-batch is a batch run of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelflow.config import ClusterParams, Config
from voxelflow.functions.geometry import CELL
from voxelflow.plans.analyze import analyze_tables

ATOM_ROWS = "frame long, atom int, x double, y double, z double"


def stream_metrics(
    spark: SparkSession,
    folder: str,
    sink: str,
    checkpoint: str,
    config: Config,
    algorithm: str = "traditional_dfs",
    params: ClusterParams | None = None,
    after: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Watch a folder of parquet files of atoms and append each new frame's metrics to ``sink``.

    A file holds whole frames. A batch's result has a folder of its own that a repeated batch overwrites, so rows appear once.
    Frames have no cell here; running totals are a window over the sink.
    """
    atoms = spark.readStream.schema(ATOM_ROWS).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        frames = rows.groupBy("frame").agg(F.count(F.lit(1)).cast("int").alias("natoms"))
        frames = frames.select("frame", F.lit(0.0).alias("time_ps"), "natoms", *[F.lit(0.0).alias(c) for c in CELL])
        run = analyze_tables(rows, frames, config, algorithm, params)
        run.metrics.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if after:
            after(run.metrics, number)
        for t in (run.grid, run.voxels, rows):
            t.unpersist()

    return atoms.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
