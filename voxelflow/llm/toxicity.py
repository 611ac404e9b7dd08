"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else that was drawn is unlabelled, labelled
rows among them. The classifiers minimise

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

with the logistic loss, where the prior is the share of toxic rows among the training labels; when the
bracket of a batch is negative, the step goes against it, as the estimator prescribes. They are linear in hashed features: the words of a
text, and its words' leading letters, once, twice and more often by different words. All features that a training text has
take part. Each enters with a scale of its own, by how far its count among positives is from what unlabelled rows make expect, in standard
deviations, so that the many rare words of few texts weigh little unless the loss insists.

Each of ``MEMBERS`` classifiers leaves out a part of the sample, on which its threshold is set: the one of the best F measure, which
the prior, the share of positives found and the share of unlabelled rows found give without negative labels. The score is the
logistic function of the members' mean.

Training reads a bounded sample (``MAX_POSITIVE`` toxic and ``MAX_UNLABELLED`` other rows); scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.llm.common import bounded_sample, held_out, labelled, release_memory, table

MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
BUCKETS = 1 << 18
PREFIXES = (4, 5)
LEVELS = 3
EVIDENCE = 20.0  # standard deviations that give the scale 1
MOST_SCALE = 2.0
MEMBERS = 3
STEPS, BATCH_ROWS = 360, 1000
RATE, DECAY = 0.03, 1e-4
THRESHOLD = 0.5
SEED = 11
CACHED_WORDS = 200_000
CHUNK_WORDS = 500_000
COPY_HASHES = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 1540483477], dtype=np.uint64)
COPY_OF = 0.75
EDGES = ".,;:!?\"'()[]{}|%#*&$-_<>/\\"


class Words(dict):
    """Raw word -> number of its row of hashes: of the bare word and of its leading letters, -1 for what it lacks."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[int]] = []
        self.table = np.zeros((0, 1 + len(PREFIXES)), np.int64)

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES)
        row = [-1] * (1 + len(PREFIXES))
        if bare:
            row[0] = zlib.crc32(bare.encode("utf-8", "replace"))
            for k, n in enumerate(PREFIXES, 1):
                if len(bare) >= n:
                    row[k] = zlib.crc32(b"%d^" % n + bare[:n].encode("utf-8", "replace"))
        self[word] = len(self.rows)
        self.rows.append(row)
        return self[word]

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.rows):
            new = np.array(self.rows[len(self.table) :], np.int64)
            self.table = np.concatenate([self.table, new])
        return self.table[numbers]

    def forget(self) -> None:
        self.__init__()
        self.clear()


def features(texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket), in order and each once, of whole texts."""
    of, numbers = [], []
    for at, text in enumerate(texts):
        own = [known[w] for w in set((text or "").lower().split())]
        numbers += own
        of.append(np.full(len(own), at, np.int64))
    of, rows = np.concatenate(of) if of else np.zeros(0, np.int64), known.hashes(np.array(numbers, np.int64))
    if len(known) > CACHED_WORDS:
        known.forget()
    bare = rows[:, 0] >= 0
    of, rows = of[bare], rows[bare]
    _, first = np.unique(of << 32 | rows[:, 0], return_index=True)  # words that differ at their edges only are one
    of, rows = of[first], rows[first]
    found = [of * BUCKETS + rows[:, 0] % BUCKETS]
    for k in range(1, rows.shape[1]):
        has = rows[:, k] >= 0
        key, times = np.unique(of[has] << 32 | rows[has, k], return_counts=True)
        for level in range(LEVELS):
            often = key[times > level]
            found.append((often >> 32) * BUCKETS + ((often & 0xFFFFFFFF) * 31 + (level + 1) * 0x9E3779B1) % BUCKETS)
    both = np.unique(np.concatenate(found))
    return both // BUCKETS, both % BUCKETS


def text_features(text: str | None) -> np.ndarray:
    """The buckets of one whole text, each once."""
    return features([text], Words())[1].astype(np.int32)


class Bags:
    """Documents as concatenated feature numbers, each feature with its scale."""

    def __init__(self, docs: list[np.ndarray], scale: np.ndarray):
        self.docs = len(docs)
        self.index = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.of = np.repeat(np.arange(self.docs, dtype=np.int32), [len(d) for d in docs])
        self.x = scale[self.index]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=self.x * weights[self.index], minlength=self.docs)

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=self.x * slope[self.of], minlength=BUCKETS)


def without_copies(docs: list[np.ndarray]) -> list[np.ndarray]:
    """One of each family of near copies (Jaccard similarity of their features of ``COPY_OF`` or more to a kept one), so that a text copied
    often doesn't make its own rare words look telling. Documents without features go too."""
    met: dict[tuple, list[int]] = {}
    kept: list[np.ndarray] = []
    for d in docs:
        if not len(d):
            continue
        low = [int(((d.astype(np.uint64) * m + np.uint64(12345)) % np.uint64(4294967291)).min()) for m in COPY_HASHES]
        keys = [(i, low[i], low[i + 1]) for i in range(0, len(low), 2)]
        near = {k for key in keys for k in met.get(key, ()) if min(len(kept[k]), len(d)) >= COPY_OF * max(len(kept[k]), len(d))}
        if any((both := len(np.intersect1d(kept[k], d, assume_unique=True))) >= COPY_OF * (len(kept[k]) + len(d) - both) for k in near):
            continue
        for key in keys:
            met.setdefault(key, []).append(len(kept))
        kept.append(d)
    return kept


def scales(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Each feature's scale: how far its count among positives is from the expected one. None is 0 unless it is as expected."""
    count = lambda docs: np.bincount(np.concatenate(docs), minlength=BUCKETS)
    expected = len(positive) * (count(unlabelled) + 0.5) / (len(unlabelled) + 1)
    evidence = np.abs(count(positive) - expected) / np.sqrt(expected + 0.5)
    return np.minimum(evidence / EVIDENCE, MOST_SCALE).astype(np.float32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_member(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights of the buckets, scales included, and the bias."""
    rng, scale = np.random.default_rng(seed), scales(positive, unlabelled)
    batches = min(len(positive), max(1, len(unlabelled) // BATCH_ROWS))
    parts = [
        (Bags([positive[i] for i in p], scale), Bags([unlabelled[i] for i in u], scale))
        for p, u in zip(
            np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True
        )
        if len(p) and len(u)
    ]
    w, first, second, step = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0
    w[-1] = np.log(prior / (1 - prior))
    while step < STEPS:
        for k in rng.permutation(len(parts)):
            p, u = parts[k]
            sp, su = _logistic(p.sums(w) + w[-1]), _logistic(u.sums(w) + w[-1])
            bracket = np.mean(-np.log(1 - su + 1e-9)) - prior * np.mean(-np.log(1 - sp + 1e-9))
            if bracket >= 0:
                gp, gu = np.full(p.docs, -prior / p.docs), su / u.docs  # prior * (sp - 1) - prior * sp
            else:
                gp, gu = prior * sp / p.docs, -su / u.docs
            grad = np.append(p.gradient(gp) + u.gradient(gu) + DECAY * w[:-1], gp.sum() + gu.sum())
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * scale, float(w[-1])


def best_threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit from which rows are called toxic: that of the best F measure, 2 * prior * found / (prior + called); the middle of ties."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    found = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    called = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    f = prior * found / (prior + np.maximum(called, prior * found))
    best = np.flatnonzero(f >= f.max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights (members, buckets) and biases (members). Without positives every score is near 0."""
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    if not positive or not unlabelled:
        return np.zeros((MEMBERS, BUCKETS), np.float32), np.full(MEMBERS, -6.0)
    rng = np.random.default_rng(seed)
    parts = [rng.permutation(len(docs)) % MEMBERS for docs in (positive, unlabelled)]
    weights, biases = np.zeros((MEMBERS, BUCKETS), np.float32), np.zeros(MEMBERS)
    for m in range(MEMBERS):
        inside = [[d for d, part in zip(docs, of, strict=True) if part != m] for docs, of in zip((positive, unlabelled), parts, strict=True)]
        outside = [[d for d, part in zip(docs, of, strict=True) if part == m] for docs, of in zip((positive, unlabelled), parts, strict=True)]
        few = any(len(x) < 10 for x in (*inside, *outside))
        if few:  # too few to leave some out
            inside = outside = [positive, unlabelled]
        w, bias = train_member(*inside, prior, seed + m)
        if not few:
            ones = np.ones(BUCKETS, np.float32)
            bias = -best_threshold(*[Bags(docs, ones).sums(w) for docs in outside], prior)
        weights[m], biases[m] = w, bias
    return weights, biases


def scorer(spark: SparkSession, weights: np.ndarray, biases: np.ndarray):
    """A column function text -> score in [0, 1]; null and empty texts get the score of no words."""
    shared = spark.sparkContext.broadcast((weights.mean(axis=0), float(biases.mean())))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        known = Words()
        for texts in batches:
            done, start, size = [np.zeros(0)], 0, 0
            texts = list(texts)
            for at, text in enumerate(texts, 1):  # a bounded number of words at a time
                size += len(text or "") // 6
                if size >= CHUNK_WORDS or at == len(texts):
                    of, bucket = features(texts[start:at], known)
                    done.append(_logistic(np.bincount(of, weights=weights[bucket], minlength=at - start) + bias))
                    start, size = at, 0
            yield pd.Series(np.concatenate(done))

    return score


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray]:
    """Train on rows outside the held-out fold; ids without a document and null texts are no examples, repeated ids are one."""
    known = labelled(labels, "toxic")
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    # The estimator wants the unlabelled rows drawn from all documents, toxic ones among them.
    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ids = some.select("doc_id").distinct()
    toxic = known.where("y = 1").select("doc_id").join(ids, "doc_id", "left_semi")
    # Bounded by max_positive + max_unlabelled ids, so the chosen ids may be broadcast.
    chosen = bounded_sample(toxic, max_positive, seed).withColumn("y", F.lit(1)).unionAll(
        bounded_sample(ids, max_unlabelled, seed).withColumn("y", F.lit(0))
    )
    picked = some.join(F.broadcast(chosen), "doc_id")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "y": rows["y"], "bag": [text_features(t).tobytes() for t in rows["text"]]})

    one = picked.mapInPandas(bags, "doc_id long, y int, bag binary").groupBy("doc_id", "y").agg(F.min("bag").alias("bag"))
    drawn = one.collect()  # a row an id
    drawn.sort(key=lambda r: r["doc_id"])
    positive, unlabelled = ([np.frombuffer(r["bag"], np.int32) for r in drawn if r["y"] == y] for y in (1, 0))
    return train(positive, unlabelled, float(min(max(prior, 0.002), 0.9)), seed)


def score_column(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Column:
    """Train, and give the score as a column over ``text``."""
    fitted = fit(docs, labels)
    release_memory(spark)
    return scorer(spark, *fitted)("text")


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, ties and repeated rows included.

    Null ids are scored and count as held out by the crc of the empty text; null and empty texts get the
    score of a text without words; texts of any length are read whole. Without documents the result is empty, without labels all
    scores are near 0. Further columns of either table are not read.
    """
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(spark, docs, labels).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
