import random
import zlib

import numpy as np
import pytest

from voxelflow.llm import quality, toxicity
from voxelflow.llm.common import held_out

DOCS = "doc_id long, text string, score string, shard int"
LABELS = "doc_id long, quality int, toxic int, y string"


def crc_fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def corpus(n=300, seed=1):
    """Toxic texts hold one of two words; bad ones are shouted. Extra columns have names that the operators use inside."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(rng.randint(20, 80))]
        toxic, good = i % 5 == 1, i % 4 != 2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilename", "scumword"])
        text = " ".join(words)
        docs.append((i, text if good else text.upper() + "!!" * 20, "clash", 3))
        if i % 3:
            labels.append((i, int(good), int(toxic), "clash"))
    return docs, labels


ODD = [(None, "no id", None, None), (9001, None, None, None), (9002, "", None, None), (9003, "word " * 60_000, None, None), (9004, "twice", None, None), (9004, "twice", None, None)]


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_every_row_whatever_its_values(spark, operator):
    docs, labels = corpus(120)
    frame = spark.createDataFrame(docs + ODD, DOCS)
    rows = operator(spark, frame, spark.createDataFrame([*labels, (None, 1, 1, ""), (5, None, None, ""), (777, 0, 1, "")], LABELS)).collect()
    assert len(rows) == len(docs) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out == (crc_fold(r.doc_id) == 0) for r in rows)
    twice = [r.score for r in rows if r.doc_id == 9004]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_empty_tables(spark, operator):
    docs, labels = corpus(30)
    none_d, none_l = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert operator(spark, none_d, spark.createDataFrame(labels, LABELS)).count() == 0
    assert operator(spark, spark.createDataFrame(docs, DOCS), none_l).count() == len(docs)


def accuracy(rows, truth):
    held = [r for r in rows if r.held_out]
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_toxicity_held_out_accuracy(spark):
    docs, labels = corpus(600)
    rows = toxicity.toxicity_scores(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert accuracy(rows, {i: int(i % 5 == 1) for i in range(600)}) > 0.95


def test_quality_held_out_accuracy(spark):
    docs, labels = corpus(600)
    rows = quality.quality_scores(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert accuracy(rows, {i: int(i % 4 != 2) for i in range(600)}) > 0.97


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus(200)
    flipped = [(i, 1 - q, 1 - t, y) if crc_fold(i) == 0 else (i, q, t, y) for i, q, t, y in labels]
    frame = spark.createDataFrame(docs, DOCS)
    for operator in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = (sorted((r.doc_id, r.score) for r in operator(spark, frame, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
        assert a == b


def test_fold_is_crc32_of_the_id_as_text(spark):
    ids = spark.range(50)
    assert all(r.h == (crc_fold(r.id) == 0) for r in ids.select("id", held_out(ids.id).alias("h")).collect())


def test_passages_cover_the_whole_text():
    text = "a" * 1300
    x, counts = quality.encode([text, None, ""])
    assert counts.tolist() == [3, 1, 1] and len(x) == 5
    assert not np.array_equal(quality.encode([text[:-200] + "B!" * 100])[0], x[:3])


def test_attention_learns_from_one_passage():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2, 4) * 30]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    p = quality.train(bags, y)
    score = quality.predict(p, np.concatenate(bags), np.array([len(b) for b in bags]))
    assert np.mean((score > 0.5) == (y > 0.5)) > 0.9


def test_risk_is_prior_corrected():
    rng = np.random.default_rng(0)
    telling, other = 7, np.arange(100, 400)
    make = lambda toxic: np.unique(np.append(rng.choice(other, 20), [telling] if toxic else [])).astype(np.int32)
    positive = [make(True) for _ in range(100)]
    unlabelled = [make(i % 5 == 0) for i in range(1000)]
    w, b = toxicity.train(positive, unlabelled, 0.2)
    score = lambda d: (1 / (1 + np.exp(-(b + w[:, d].sum(axis=1))))).mean()
    assert min(score(make(True)) for _ in range(50)) > 0.5 > max(score(make(False)) for _ in range(50))


def test_attention_gradient_is_right(monkeypatch):
    """The first step of Adam goes by the sign of each entry's gradient; it must be that of finite differences of the mean log loss."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 4, 2, 3, 5, 2)]
    y = np.array([0.0, 1, 1, 0, 1, 0])
    monkeypatch.setattr(quality, "EPOCHS", 0)
    before = quality.train(bags, y)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    after = quality.train(bags, y)
    x, counts = np.concatenate(bags), np.array([len(b) for b in bags])

    def loss(p):
        s = quality.predict(p, x.astype(np.float32), counts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    checked = 0
    for name in ("W", "V", "U", "w", "c", "b", "d"):
        flat = before[name].ravel()
        for at in rng.choice(flat.size, min(8, flat.size), replace=False):
            slopes = []
            for step in (1e-5, -1e-5):
                p = {k: v.copy() for k, v in before.items()}
                p[name].ravel()[at] += step
                slopes.append(loss(p))
            slope = (slopes[0] - slopes[1]) / 2e-5 + (1e-4 * flat[at] if name not in "bd" else 0)
            moved = (after[name] - before[name]).ravel()[at]
            if abs(slope) > 1e-5:
                checked += 1
                assert moved * slope < 0, (name, at)
    assert checked > 20


def test_training_reads_whole_documents_up_to_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, y, seed: seen.append([len(b) for b in bags]) or {})
    ids = [i for i in range(40) if crc_fold(i)]
    docs = spark.createDataFrame([(i, "word " * 30_000, "", 0) for i in ids] + [(ids[0], "twice", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0, "") for i in ids], LABELS)
    quality.fit(docs, labels)
    quality.fit(docs, labels, max_bytes=400_000)
    quality.fit(docs, labels, max_labelled=5)
    assert len(seen[0]) == len(ids) and sorted(seen[0])[1] == -(-150_000 // quality.PASSAGE_BYTES)
    assert len(seen[1]) == 3 and len(seen[2]) == 5


def test_copies_are_told_by_similarity_not_by_chance():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 400, 60)).astype(np.int32) for _ in range(40)]  # one small vocabulary for all
    copies = [b[:-2] for b in base]
    kept = toxicity.without_copies(base + copies + [np.zeros(0, np.int32)])
    assert len(kept) == 40 and all(any(np.array_equal(k, b) for b in base) for k in kept)


def test_threshold_of_the_best_f_measure_without_negatives():
    positive, unlabelled = np.array([2.0, 3, 4, 5]), np.concatenate([np.full(90, -3.0), [2.0, 3, 4, 5, 2, 3, 4, 5, 2, 3]])
    assert -3 < toxicity.best_threshold(positive, unlabelled, 0.1) < 2


def test_prefixes_count_by_different_words():
    known = toxicity.Words()
    of, bucket = toxicity.features(["badword badwords", "badword badword", None, ""], known)
    own = [set(bucket[of == k]) for k in range(4)]
    assert own[1] < own[0] and not own[2] and not own[3]
    assert list(toxicity.text_features("badword badwords")) == sorted(own[0])
