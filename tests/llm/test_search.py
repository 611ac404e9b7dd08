import math
import random

import numpy as np
import pytest

from voxelflow.llm import decontaminate, lm, topk

VECTORS = "vec_id long, embedding array<float>, label int, row string, shard int"
DOCS = "doc_id long, text string, item_id string, start int"
ITEMS = "item_id long, text string, doc_id string"


def brute(rows, k=5, every=50):
    whole = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, j) for m, j, v in whole if m != n and len(v) == len(q)]
        out += [(i, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def search(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)
    return sorted((tuple(r) for r in topk.top_k(spark, frame, **options).collect()), key=str)


def test_matches_brute_force_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(700)]
    rows += [(2000 + i, [0.5] * 8) for i in range(40)]  # ties
    rows += [(50, [0.1] * 8), (50, [0.1] * 8)]  # a repeated id
    assert search(spark, rows, shard_rows=120) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [1.0, -1.0]), (5, [1.0]), (50, [0.0, 0.0]), (100, [])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == [] and search(spark, [(0, [1.0])]) == [] and search(spark, [(7, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e5, 1.0]), (1, [3.0e5, 2.0]), (2, [3.0e5, 1.0]), (3, [-3.0e5, 5.0])]
    assert search(spark, rows) == brute(rows)


def test_boxes_are_tight_and_hold_all_rows():
    v = np.random.default_rng(1).integers(-50, 50, (500, 3))
    tree = topk.Tree(v, list(range(500)), np.arange(500), leaf_rows=20)
    for n in range(len(tree.low)):
        own = tree.vectors[tree.start[n] : tree.end[n]]
        assert (own.min(axis=0) == tree.low[n]).all() and (own.max(axis=0) == tree.high[n]).all()
    assert sorted(tree.vec_ids) == list(range(500))


def edit_distance_inside(pattern, text):
    """Least distance of a pattern to any stretch of a text, by the plain recurrence."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def mutate(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["q"], [out[at], "z"]])
    return "".join(out)


@pytest.fixture(scope="module")
def benchmark():
    rng = random.Random(7)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    return [(n, make(n + 4)) for n in range(1, 16)] + [(50, "short"), (51, None), (None, make(9)), (52, "")], make


def test_contamination_matches_the_plain_recurrence(spark, benchmark):
    items, make = benchmark
    rng = random.Random(8)
    docs = [(d, make(12) + " " + mutate(rng, rng.choice(items[:15])[1], rng.randrange(9)) + " " + make(12)) for d in range(60)]
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[4][1].upper().replace(" ", ",\n")), (102, items[4][1]), (103, make(20_000) + items[5][1])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.contamination(spark, frame, spark.createDataFrame([(*i, "x") for i in items], ITEMS)).collect()), key=str)
    want = []
    for d, t in docs:
        text = decontaminate.normal(t)
        for i, p in items:
            own = decontaminate.normal(p)
            if i is None or len(own) < decontaminate.MIN_ITEM_CHARS or not text:
                continue
            if len(text) > 10_000:
                distance = 0 if own in text else 99
            else:
                distance = edit_distance_inside(own, text)
            if distance <= math.floor(len(own) * decontaminate.ERROR_RATE):
                want.append((d, i, distance))
    assert got == sorted(want, key=str)


def test_blocks_of_items_give_the_same(spark, benchmark):
    items, make = benchmark
    docs = spark.createDataFrame([(d, make(5) + " " + items[d][1], "x", 1) for d in range(15)], DOCS)
    table = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    parts = decontaminate.blocks(spark, table, block_chars=200)
    assert len(parts) > 2 and sum(len(p.value) for p in parts) == 17
    assert decontaminate.clean(spark, docs, table).count() == 0


def test_several_blocks_give_the_rows_of_one(spark, benchmark):
    items, make = benchmark
    rng = random.Random(9)
    docs = spark.createDataFrame([(d, make(5) + " " + mutate(rng, items[d % 15][1], 2) + " " + make(4), "x", 1) for d in range(40)] + [(None, None, "x", 1)], DOCS)
    table = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    rows = lambda size: sorted((tuple(r) for r in decontaminate.contamination(spark, docs, table, size).collect()), key=str)
    assert rows(200) == rows(1 << 20)
    kept = lambda size: sorted(map(str, map(tuple, decontaminate.clean(spark, docs, table, size).collect())))
    assert kept(200) == kept(1 << 20)


def ends(pattern, text):
    """Least distance to a stretch of a text, and the first end where it is met."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before), before.index(min(before))


def test_ties_end_first(benchmark):
    items, make = benchmark
    rng = random.Random(10)
    for _ in range(150):
        item = rng.choice(items[:15])[1]
        text = " ".join([make(6), *(mutate(rng, item, rng.randrange(3)) for _ in range(3)), make(6)])
        found = decontaminate.Items([(1, item)]).find(text)
        own, text = decontaminate.normal(item), decontaminate.normal(text)
        least, end = ends(own, text)
        if least > len(own) // 10:
            assert not found
        else:
            (_, distance, start, at), = found
            assert (distance, at) == (least, end) and ends(own, text[start:at])[0] == least


def test_clean_keeps_rows_and_columns(spark, benchmark):
    items, make = benchmark
    rows = [(1, make(30), "x", 1), (1, make(30), "x", 1), (2, None, None, None), (3, items[8][1], "y", 2), (None, "", "z", 3)]
    table = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    out = decontaminate.clean(spark, spark.createDataFrame(rows, DOCS), table).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, rows[:3] + rows[4:]))
    empty = spark.createDataFrame([], ITEMS)
    assert decontaminate.clean(spark, spark.createDataFrame(rows, DOCS), empty).count() == 5
    assert decontaminate.contamination(spark, spark.createDataFrame([], DOCS), table).count() == 0


def test_pseudo_likelihood_is_the_networks(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "the cat", None, None), (3, "The CAT", "", 0), (90, None, "", 0), (91, "", "", 0), (92, "cat " * 50_000, "", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    frequent, p = lm.fit(frame)
    ids = lm.TokenIds(frequent)
    out = lm.pseudo_likelihood(spark, frame).collect()
    assert len(out) == len(rows)
    for r, (i, t, *_) in zip(sorted(out, key=lambda r: str(tuple(r))), sorted(rows, key=str), strict=False):
        pass
    by_id = {i: t for i, t, *_ in rows if i is not None and i > 3}
    for r in out:
        if r.doc_id not in by_id:
            continue
        tokens = lm.token_ids(by_id[r.doc_id], ids).tolist()
        assert r.n_tokens == len(tokens)
        if not tokens:
            assert r.log_likelihood == 0 and r.mean_log_probability is None
        elif len(tokens) < 100:
            total = 0.0
            for left, middle, right in zip([0, *tokens], tokens, [*tokens[1:], 0], strict=False):
                z = np.tanh(p["left"][left] + p["right"][right] + p["b"]) @ p["W"] + p["c"]
                total += z[middle] - np.log(np.exp(z - z.max()).sum()) - z.max()
            assert abs(r.log_likelihood - total) < 1e-2 and abs(r.mean_log_probability - total / len(tokens)) < 1e-3


def test_network_beats_word_frequencies(spark):
    rng = random.Random(5)
    ring = [f"n{k}" for k in range(20)]
    texts = [" ".join(ring[(s + k) % 20] for k in range(30)) for s in (rng.randrange(20) for _ in range(200))]
    out = lm.pseudo_likelihood(spark, spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS)).collect()
    assert np.mean([r.mean_log_probability for r in out]) > -1.0 > -np.log(20)
    assert lm.pseudo_likelihood(spark, spark.createDataFrame([], DOCS)).count() == 0
