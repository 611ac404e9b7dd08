import random
import zlib
from collections import Counter

import pytest

from voxelflow.llm import sharding

SCHEMA = "doc_id long, text string, shard int, size string, cell int, order int, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)


def test_sizes_slots_and_rows(spark):
    rows = [(i, f"text {i % 7}") for i in range(1000)] + [(None, None), (None, "é"), (5, ""), (5, ""), (6, "z" * 300_000)]
    out = sharding.shard_documents(spark, table(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    out = sharding.shard_documents(spark, table(spark, [(i, "a") for i in range(n)])).collect()
    assert len(out) == n and all(r.slot == 0 for r in out)


def test_second_permutation_in_blocks(spark):
    rows = [(1, "same") for _ in range(3000)]
    out = sharding.shard_documents(spark, table(spark, rows), shards=3, cell_rows=100).collect()
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(1000))


def test_same_seed_same_result_other_seed_other_result(spark):
    frame = table(spark, [(i, str(i)) for i in range(400)]).coalesce(2).cache()
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(spark, frame, seed=seed).collect()}
    assert place(1) == place(1) != place(2)


def test_matrix_has_its_sums():
    cells, shards = [10, 0, 25, 7], [14, 14, 14]
    m = sharding.communication_matrix(cells, shards, 3)
    assert [sum(r) for r in m] == cells and [sum(c) for c in zip(*m, strict=True)] == shards


def test_draws_follow_the_hypergeometric_law():
    from math import comb

    rng = random.Random(5)
    good, bad, draws, n = 7, 13, 6, 20_000
    seen = Counter(sharding.draw_hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(7):
        p = comb(good, k) * comb(bad, draws - k) / comb(20, 6)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_assignment_is_uniform(spark):
    frame = table(spark, [(i, "a") for i in range(48)]).coalesce(1).cache()
    seen = Counter()
    for seed in range(12):
        for r in sharding.shard_documents(spark, frame, shards=4, seed=seed).collect():
            seen[(r.doc_id < 24, r.shard)] += 1
    assert all(40 <= seen[(half, s)] <= 104 for half in (True, False) for s in range(4))
