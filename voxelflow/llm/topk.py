"""Exact top-k by inner product over integer vectors with KD-trees per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows by a hash of their row number. Each shard builds a KD-tree by
median splits along the widest axis, with a tight bounding box at every node, and is written out. Queries
come in blocks of bounded size. A block first meets one shard, whose k-th scores are propagated to
all others; there each query walks the tree best-first by its bound on the inner product with a box and
stops where no box can reach the k-th score, which rises from shard to shard within a task.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelflow.llm.common import Scratch, table

SCALE = 256
K = 5
QUERY_EVERY = 50
SHARD_ROWS = 8_000
LEAF_ROWS = 256
BLOCK_QUERIES = 16_384
BROADCAST_WIDTHS = 100_000
EXACT = 2.0**52


class Tree:
    """Reordered rows, and per node its box, its rows [start, end) and its children (-1 for a leaf)."""

    def __init__(self, vectors: np.ndarray, vec_ids: list, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(vectors))
        self.low, self.high, self.start, self.end, self.children = [], [], [], [], []
        stack = [(0, len(vectors), None)]
        while stack:
            start, end, parent = stack.pop()
            here = vectors[order[start:end]]
            node = len(self.low)
            if parent is not None:
                self.children[parent[0]][parent[1]] = node
            self.low.append(here.min(axis=0))
            self.high.append(here.max(axis=0))
            self.start.append(start)
            self.end.append(end)
            self.children.append([-1, -1])
            spread = self.high[node].astype(float) - self.low[node] if here.shape[1] else np.zeros(1)
            if end - start <= leaf_rows or not spread.max():
                continue
            middle = (end - start) // 2
            split = np.argpartition(here[:, int(spread.argmax())], middle)
            order[start:end] = order[start:end][split]
            stack += [(start, start + middle, (node, 0)), (start + middle, end, (node, 1))]
        self.vectors = vectors[order]
        self.vec_ids = [vec_ids[i] for i in order]
        self.rows = rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)


def _key(found: tuple) -> tuple:
    """Best first: higher score, then smaller vec_id (null last), then earlier row."""
    score, vec_id, row = found
    return (-score, vec_id is None, vec_id or 0, row)


def search(tree: Tree, queries: np.ndarray, own_rows: np.ndarray, floors: list, k: int, best: list[list[tuple]]) -> None:
    """Put what the tree has for each query into ``best``; ``floors`` are scores that k other rows are known to reach."""
    small = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * max(1, queries.shape[1]) < EXACT
    kind = np.float64 if small else object
    as_kind = lambda x: x.astype(kind) if small else np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    q, vectors, low, high = as_kind(queries), as_kind(tree.vectors), as_kind(tree.low), as_kind(tree.high)
    bounds = np.where(q > 0, q, 0) @ high.T + np.where(q < 0, q, 0) @ low.T
    for i in range(len(q)):
        found, floor = best[i], floors[i]
        bound = bounds[i]
        if len(found) >= k:
            floor = max(floor, found[-1][0]) if floor is not None else found[-1][0]
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if floor is not None and -reach < floor:
                break
            left, right = tree.children[node]
            if left >= 0:
                for child in (left, right):
                    if floor is None or bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            start, end = tree.start[node], tree.end[node]
            scores = vectors[start:end] @ q[i]
            take = np.arange(end - start) if floor is None else np.flatnonzero(scores >= floor)
            if len(take) > 4 * k:  # ties of the k-th score stay
                cut = np.sort(scores[take])[-k - 1]
                take = take[scores[take] >= cut]
            new = [(int(scores[j]), tree.vec_ids[start + j], int(tree.rows[start + j])) for j in take if tree.rows[start + j] != own_rows[i]]
            if new:
                found = sorted(found + new, key=_key)[:k]
                if len(found) >= k:
                    floor = found[-1][0] if floor is None else max(floor, found[-1][0])
        best[i] = found
        floors[i] = floor


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): rows whose vector and components are there and finite, as floor(256 * x)."""
    x = F.col("embedding")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x
    ).where(x.isNotNull() & ~odd).select("row", "vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * SCALE)).alias("v"))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row")
    width = len(rows["v"].iloc[0])
    ids = [None if pd.isna(x) else int(x) for x in rows["vec_id"]]
    tree = Tree(np.array([np.asarray(v, np.int64) for v in rows["v"]]).reshape(len(rows), width), ids, rows["row"].to_numpy())
    return pd.DataFrame({"width": [width], "shard": [rows["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})


def top_k(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows by inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; a repeated id is a query each time, and its other
    rows are candidates. Vectors of another length are no candidates. Integer components beyond the range of a long are
    held at its ends, as are scores. Null ids are candidates after all others. Vectors of any length are read whole, and an empty table gives an
    empty result. Further columns are not read.
    """
    scratch = Scratch(spark, "topk")
    rows = scratch.table(integer_vectors(vectors).withColumn("width", F.size("v")), "rows")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    # One shard of each width goes first; its trees are a table of their own, so that neither pass reads the other's.
    first = scratch.table(dealt.groupBy("width").agg(F.min("shard").alias("first")), "first")
    first = F.broadcast(first) if first.count() <= BROADCAST_WIDTHS else first
    marked = dealt.join(first, "width").withColumn("leads", F.col("shard") == F.col("first"))
    build = lambda some: some.groupBy("width", "shard").applyInPandas(_build, "width int, shard int, tree binary")
    leading = scratch.table(build(marked.where("leads")), "leading")
    others = scratch.table(build(marked.where("not leads")), "others")
    queries = rows.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(n_blocks)).cast("int"))
    schema = "query_row long, query_id long, vec_id long, row long, score long"

    def walk(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_width = {w: (list(b[0]), b[1], b[2], list(b[3])) for w, b in shared.value.items()}
            best = {w: [[] for _ in b[0]] for w, b in by_width.items()}
            for batch in batches:
                for width, raw in zip(batch["width"], batch["tree"], strict=True):
                    if width in by_width:
                        _, matrix, own, floors = by_width[width]
                        search(pickle.loads(raw), matrix, own, floors, k, best[width])
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            out = [
                (int(row), qid, vec_id, hit, clip(score))
                for w, (ids, _, own, _) in by_width.items()
                for row, qid, found in zip(own, ids, best[w], strict=True)
                for score, vec_id, hit in found
            ]
            yield pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "row", "score"]).astype({"vec_id": "Int64"})

        return run

    parts = []
    for b in range(n_blocks):
        block: dict[int, tuple] = {}
        for r in queries.where(F.col("block") == b).orderBy("row").toLocalIterator():
            block.setdefault(r["width"], ([], [], [], []))
            for column, value in zip(block[r["width"]], (r["vec_id"], r["v"], r["row"], None), strict=True):
                column.append(value)
        block = {w: (ids, np.array(v, np.int64).reshape(len(ids), w), np.array(own), floors) for w, (ids, v, own, floors) in block.items()}
        lead = leading.select("width", "tree").mapInPandas(walk(spark.sparkContext.broadcast(block)), schema)
        lead = scratch.table(lead, f"lead-{b}")
        kth = lead.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        floor = {r["query_row"]: r["kth"] for r in kth.collect()}  # a number a query of the block
        block = {w: (ids, v, own, [floor.get(int(x)) for x in own]) for w, (ids, v, own, _) in block.items()}
        rest = others.select("width", "tree").mapInPandas(walk(spark.sparkContext.broadcast(block)), schema)
        parts += [lead, scratch.table(rest, f"rest-{b}")]
    every_hit = parts[0]
    for p in parts[1:]:
        every_hit = every_hit.unionAll(p)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = every_hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), c as (select *, row_number() over () as row from v),
pairs as (
    select q.vec_id as query_id, q.row as query_row, c.vec_id, c.row,
           list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from c q join c on c.row <> q.row and len(c.v) = len(q.v) where q.vec_id % 50 = 0
), ranked as (
    select *, row_number() over (partition by query_row order by score desc, vec_id, row)::int as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
