"""Run-to-run comparison, running totals, and agreement of two labellings of the same voxels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from voxelflow.functions.statistics import kendall_tau


def running_totals(rows: DataFrame, elapsed: str = "elapsed_ms", rss: str = "rss_bytes") -> DataFrame:
    """(frame, cumulative_ms, peak_rss_bytes, replicate): running sum and running maximum over the frame sequence of a replicate."""
    sofar = Window.partitionBy("replicate").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("frame", F.sum(elapsed).over(sofar).alias("cumulative_ms"), F.max(rss).over(sofar).alias("peak_rss_bytes"), "replicate")


def _numbered(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows with their position by frame. One result row a frame, so the sequence is short next to the voxels behind it."""
    place = F.row_number().over(Window.orderBy("frame"))
    named = [F.col(c).alias(f"{prefix}{c}") for c in ("max_cluster", "nclusters", "elapsed_ms", "cluster_sizes")]
    return rows.select(place.alias("place"), *named)


@F.pandas_udf(DoubleType())
def kendall(a: pd.Series, b: pd.Series) -> pd.Series:
    """Kendall's tau of two array columns over their common length; no untied pair gives 1. Lists are as long as a frame has clusters."""
    return pd.Series([kendall_tau(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def compare_runs(ours: DataFrame, other: DataFrame) -> DataFrame:
    """One row of error statistics over rows paired by position, up to the shorter run."""
    both = _numbered(ours, "a_").join(_numbered(other, "b_"), "place")
    tau = F.when((F.size("a_cluster_sizes") > 0) & (F.size("b_cluster_sizes") > 0), kendall("a_cluster_sizes", "b_cluster_sizes"))
    parts = [F.count(F.lit(1)).alias("frames")]
    for name in ("max_cluster", "nclusters"):
        d = F.col(f"a_{name}").cast("double") - F.col(f"b_{name}")
        parts += [F.avg(F.abs(d)).alias(f"mean_abs_{name}"), F.sqrt(F.avg(d * d)).alias(f"rmse_{name}")]
    a, b = F.sum("a_elapsed_ms").cast("double"), F.sum("b_elapsed_ms").cast("double")
    speedup = F.when(a > 0, F.when(b > 0, b / a).otherwise(F.lit(float("inf")))).otherwise(0.0)
    return both.agg(*parts, F.avg(F.col("a_elapsed_ms") - F.col("b_elapsed_ms")).alias("mean_elapsed_difference"), speedup.alias("speedup"), F.avg(tau).alias("mean_tau"))


def size_floor(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per true component (frame, label, size, reached, ids, outcome): what a labelling made of it.

    ``missed`` no voxel, ``truncated`` some, ``split`` several ids, else ``found``.
    """
    named = found.select("frame", "i", "j", "k", F.col("label").alias("found"))
    return outcomes(truth.join(named, ["frame", "i", "j", "k"], "left"))


def outcomes(both: DataFrame) -> DataFrame:
    """The same from voxels that have a true label and, or null, a found one."""
    per = both.groupBy("frame", "label").agg(
        F.count(F.lit(1)).alias("size"), F.count("found").alias("reached"), F.count_distinct("found").alias("ids")
    )
    outcome = F.when(F.col("reached") == 0, "missed").when(F.col("ids") > 1, "split").when(F.col("reached") < F.col("size"), "truncated").otherwise("found")
    return per.withColumn("outcome", outcome)


def merged(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(frame, id, components): ids of a labelling that span several true components."""
    named = found.select("frame", "i", "j", "k", F.col("label").alias("id"))
    per = truth.join(named, ["frame", "i", "j", "k"]).groupBy("frame", "id").agg(F.count_distinct("label").alias("components"))
    return per.where("components > 1")


def recall_by_size(floor: DataFrame) -> DataFrame:
    """(size, present, missed, recall) over all frames."""
    missed = F.sum(F.when(F.col("outcome") == "missed", 1).otherwise(0))
    out = floor.groupBy("size").agg(F.count(F.lit(1)).alias("present"), missed.alias("missed"))
    return out.withColumn("recall", (F.col("present") - F.col("missed")) / F.col("present"))
