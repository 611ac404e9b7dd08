import random
from collections import Counter

import numpy as np
import pytest

from voxelflow.llm import lm

DOCS = "doc_id long, text string"


def scores(spark, texts):
    out = lm.pseudo_likelihood(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(out) == len(texts)
    return [r.log_likelihood for r in sorted(out, key=lambda r: r.doc_id)]


def corpus():
    rng = random.Random(2)
    words = [f"{a}{b}{c}ed" for a in "bcdfgh" for b in "aeiou" for c in "lmnrstv"]
    return [" ".join(rng.choice(words) for _ in range(40)) for _ in range(150)]


def test_words_of_one_class_score_by_their_counts(spark):
    texts = corpus()
    gibberish = " ".join(f"{w[::-1]}qxed" for w in texts[0].split())  # the same endings, words of no other text
    got = scores(spark, [*texts, gibberish])
    assert got[-1] < got[0] - 40


@pytest.mark.parametrize("cached", [0, 30, 100_000])
def test_joined_counts_equal_broadcast_ones(spark, monkeypatch, cached):
    texts = [*corpus(), "once-éed twice twice", "İed"]
    monkeypatch.setattr(lm, "LEAST_STEPS", 3)
    monkeypatch.setattr(lm, "CACHED", cached)
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    args, total, _ = lm.vocabulary(lm.count_words(frame))
    p = lm.fit_network(spark, frame, args, total)
    counts = Counter(w for t in texts for w in t.lower().split())
    ids = lm.TokenIds(args["frequent"])
    of_class = Counter()
    for w, n in counts.items():
        if w not in args["frequent"]:
            of_class[ids.class_of(w)] += n
    assert total == sum(counts.values())
    got = scores(spark, texts)
    for t, score in zip(texts, got, strict=True):
        words = t.lower().split()
        tokens = [0, *(ids.resolve(np.array([ids[w]]))[0][0] for w in words), 0]
        want = 0.0
        for k, w in enumerate(words, 1):
            z = np.tanh(p["left"][tokens[k - 1]] + p["right"][tokens[k + 1]] + p["b"]) @ p["W"] + p["c"]
            want += z[tokens[k]] - np.log(np.exp(z).sum())
            if w not in args["frequent"]:
                want += np.log(counts[w] / of_class[ids.class_of(w)])
        assert abs(score - want) < 0.05


def test_vocabulary_grows_and_two_levels_sum_to_one(spark, monkeypatch):
    assert [lm.sizes(n)[0] for n in (0, 10**8, 10**10)] == [128, 2500, 25000]
    p = lm.initial(300)
    every = (np.arange(300) * 300 + 5) * 300 + 7
    assert abs(np.exp(lm.log_probabilities(p, every)).sum() - 1) < 1e-4
    ring = np.arange(40, 300)
    window = np.sort((ring * 300 + np.roll(ring, 1)) * 300 + np.roll(ring, -1))
    p, seen = lm.train(p, [(window, np.ones(260, np.int64))], 400)
    assert seen == 260 and lm.log_probabilities(p, window).mean() > -1.0
    monkeypatch.setattr(lm, "sizes", lambda n: (300, 40))  # many words of a few texts, averaged over tasks
    monkeypatch.setattr(lm, "SMALL", 0)
    assert all(np.isfinite(scores(spark, corpus())))
