"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame functions only).

Rows are dealt to source cells of near-equal size. The number of rows that goes from each cell to
each shard is drawn from the multivariate hypergeometric law, which is the law of those counts under
a uniform permutation of the whole table. Each cell is then permuted locally, cut by its row of the
matrix, exchanged, and each shard permuted again; the result is a uniform random assignment of rows
to (shard, slot) with exact shard sizes that no global sort was needed for.

Only (row number, doc_id, size, crc) travels; the texts stay where they are. Cells and the blocks of a
shard's second permutation are sized to ``CELL_ROWS``, whatever the table's keys look like, so
neither repeated texts nor repeated or null ids make a hot partition.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelflow.llm.common import Scratch, table

SHARDS = 24
SEED = 20240607
ROW_OVERHEAD = 8
CELL_ROWS = 200_000
MIN_CELLS, MAX_CELLS = 64, 4096


def draw_hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw (to double precision) of the marked items among ``draws`` taken without replacement.

    Inverts the distribution outward from its mode, so it needs a number of steps of the order of
    the standard deviation.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, ((draws + 1) * (good + 1)) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while u > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            moved = p_up > 0
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            moved = moved or p_down > 0
            if u <= 0:
                return down
        if not moved:  # what is left is rounding error
            return mode
    return mode


def communication_matrix(cells: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, drawn as under a uniform permutation."""
    rng = random.Random(seed)
    left = list(shards)
    matrix = []
    for size in cells:
        row, rest, pool = [], size, sum(left)
        for s, room in enumerate(left):
            take = draw_hypergeometric(rng, room, pool - room, rest)
            row.append(take)
            rest -= take
            pool -= room
            left[s] -= take
        matrix.append(row)
    return matrix


def exact_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_documents(
    spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row; the law is ``rows``.

    Null texts have size 8 and the crc of the empty text. Null, repeated and tied ids are ordinary
    rows: every row has a number of its own. Further input columns are not read. An empty table
    gives an empty result. Equal texts (groups) have no bearing under this law.
    """
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = scratch.table(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "thin",
    )
    rows = thin.count()
    n_cells = min(MAX_CELLS, max(MIN_CELLS, math.ceil(rows / cell_rows)))
    blocks = max(1, math.ceil(rows / shards / cell_rows))
    celled = thin.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "row_no"), F.lit(n_cells)).cast("int"))
    counted = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counted.get(c, 0) for c in range(n_cells)], exact_sizes(rows, shards), seed)
    # One literal array per cell: the running sums of its row of the matrix; n_cells * shards integers.
    running = []
    for row in matrix:
        total, sums = 0, []
        for n in row:
            total += n
            sums.append(total)
        running.append("array(" + ",".join(f"{x}L" for x in sums) + ")")
    cuts = spark.sql(
        "select * from values " + ",".join(f"({c}, {sums})" for c, sums in enumerate(running)) + " as t(cell, cuts)"
    )
    in_cell = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "row_no"), "row_no")
    dealt = (
        celled.withColumn("place", F.row_number().over(in_cell).cast("long"))
        .join(F.broadcast(cuts), "cell")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))).cast("int"))
        .withColumn("order", F.xxhash64(F.lit(seed + 2), "row_no"))
        # Equal-width slices of the second random order, so that a shard's permutation is not one task's work.
        .withColumn("block", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * blocks).cast("int"))
        .select("doc_id", "size", "text_crc32", "row_no", "shard", "order", "block")
    )
    exchanged = scratch.table(dealt, "exchanged")
    scratch.drop("thin")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        exchanged.groupBy("shard", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("shard", "block", "offset")
    )
    in_block = Window.partitionBy("shard", "block").orderBy("order", "row_no")
    placed = exchanged.withColumn("rank", F.row_number().over(in_block).cast("long"))
    return placed.join(F.broadcast(offsets) if shards * blocks <= 200_000 else offsets, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - 1 + F.col("offset")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"))
