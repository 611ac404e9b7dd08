"""Shared helpers: scratch tables in the cluster's shared folder, label folds, text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_MODULUS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local master may do without and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="voxelflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_late(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # the JVM may be gone already; the folder's owner sweeps it then
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage; one instance serves one query.

    ``table`` writes a DataFrame and returns the reread one. ``drop`` deletes a table that no
    later step reads; what a returned DataFrame still reads is deleted when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete_late, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def release_memory(self) -> None:
        release_memory(self.spark)


def release_memory(spark: SparkSession) -> None:
    """After a step: let Spark's cleaner delete the shuffle files of steps that are over, and executors give back heap.

    An executor's heap grows with the garbage of a step and stays, while Python workers need memory in the same container. A collection
    in each executor returns what is free; it takes tenths of a second.
    """
    spark.sparkContext._jvm.System.gc()
    cores = max(1, spark.sparkContext.defaultParallelism)
    collected = spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done"))
    collected.agg(F.count("done")).collect()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MODULUS


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, y) for training: labels outside the held-out fold, one row an id, conflicting ones by majority."""
    known = labels.select("doc_id", F.col(target).cast("double").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull()
    )
    return (
        known.where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )


def bounded_sample(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, those whose hashed doc_id is smallest: the same rows whatever the partitioning."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)
