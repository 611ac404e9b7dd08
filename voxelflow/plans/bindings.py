"""The driver's tables read as particle frames, and the same readings as DuckDB SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.config import Config, Lattice
from voxelflow.functions.geometry import CELL

# Edges are powers of two, so that fractional coordinates are exact and both engines round alike.
BOUNDS = (0.0, 1024.0, 0.0, 32.0, 0.0, 32.0)
DIMS = (1024, 32, 32)
WRAPPED_BOUNDS = (0.0, 16.0, 0.0, 16.0, 0.0, 16.0)
WRAPPED_DIMS = (16, 16, 16)


def config(**changes) -> Config:
    return Config(**({"box": "manual", "bounds": BOUNDS, "spacing": 1.0, "lattice": Lattice("cubic", "F"), "dnn": 2.4} | changes))


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names; only a local master gets one of its own."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="voxelflow-")
    spark.sparkContext.setCheckpointDir(named)


def event_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.dayofmonth("ts").cast("long").alias("frame"), F.col("event_id").alias("atom"),
        (F.col("user_id") / F.lit(6.0)).alias("x"), F.hour("ts").cast("double").alias("y"), (F.col("value") / F.lit(20.0)).alias("z"),
    )


def frames_of(atoms: DataFrame) -> DataFrame:
    """Frames without a cell of their own."""
    return atoms.groupBy("frame").agg(F.count(F.lit(1)).cast("int").alias("natoms")).select("frame", F.lit(0.0).alias("time_ps"), "natoms", *[F.lit(0.0).alias(c) for c in CELL])


def event_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_atoms(spark, sf_dir)
    return a.select("frame", F.floor("x").cast("int").alias("i"), F.col("y").cast("int").alias("j"), F.floor("z").cast("int").alias("k")).distinct()


def lineitem_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.col("l_linenumber").cast("long").alias("frame"), F.col("l_quantity").cast("int").alias("i"),
        (F.round(F.col("l_discount") * 100) * 9 + F.round(F.col("l_tax") * 100)).cast("int").alias("j"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("k"),
    ).distinct()


def embedding_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = [F.floor((F.col("embedding")[n].cast("double") + 1) * 20).cast("int").alias(c) for n, c in enumerate("ijk")]
    return rows.select(F.col("label").cast("long").alias("frame"), *index).distinct()


EVENT_ATOMS = "select day(ts)::bigint as frame, event_id as atom, user_id / 6.0::double as x, hour(ts)::double as y, value / 20.0::double as z from events"
EVENT_VOXELS = f"select distinct frame, floor(x)::int as i, y::int as j, floor(z)::int as k from ({EVENT_ATOMS})"
LINEITEM_VOXELS = """select distinct l_linenumber::bigint as frame, l_quantity::int as i, (round(l_discount * 100) * 9 + round(l_tax * 100))::int as j,
    floor(l_extendedprice / 1000)::int as k from lineitem"""
EMBEDDING_VOXELS = """select distinct label::bigint as frame, floor((embedding[1]::double + 1) * 20)::int as i,
    floor((embedding[2]::double + 1) * 20)::int as j, floor((embedding[3]::double + 1) * 20)::int as k from embeddings"""
