"""Document quality by gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE_BYTES`` bytes, together its whole text. Each passage is
encoded as shares of byte classes, of transitions between them and of repeated words; a small network maps
it to h = tanh(W x), gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and
the label of the document trains everything through the logit of sum(a h). Training reads a
bounded sample of labelled documents, each with all its passages: at most ``MAX_LABELLED`` rows, in the order of a hash of
their ids, until they have ``MAX_TRAINING_BYTES`` of text. Scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelflow.llm.common import bounded_sample, held_out, labelled, release_memory, table

PASSAGE_BYTES = 512
MAX_LABELLED = 6000
MAX_TRAINING_BYTES = 64 << 20
CLASSES = 8
FEATURES = CLASSES + CLASSES * CLASSES + 4
HIDDEN, GATE = 24, 16
EPOCHS = 40
THRESHOLD = 0.3
SEED = 5
ENCODE_BYTES = 8 << 20


def _byte_classes() -> np.ndarray:
    """0 padding, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 sentence mark, 6 other sign, 7 beyond ASCII."""
    of = np.full(256, 6, np.uint8)
    of[0] = 0
    of[ord("a") : ord("z") + 1] = 1
    of[ord("A") : ord("Z") + 1] = 2
    of[ord("0") : ord("9") + 1] = 3
    of[[9, 10, 11, 12, 13, 32]] = 4
    of[[ord(c) for c in ".,;:'\"-?"]] = 5
    of[128:] = 7
    return of


CLASS_OF = _byte_classes()


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of whole texts, and how many passages each text has (at least one)."""
    raw = [(t or "").encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    counts = np.array([max(1, -(-len(b) // PASSAGE_BYTES)) for b in raw], dtype=np.int64)
    found = []
    start = 0
    while start < len(raw):  # a bounded number of bytes at a time
        end, size = start, 0
        while end < len(raw) and (end == start or size + len(raw[end]) <= ENCODE_BYTES):
            size += len(raw[end])
            end += 1
        found.append(_encode(raw[start:end], counts[start:end]))
        start = end
    return (np.concatenate(found) if found else np.zeros((0, FEATURES), np.float32)), counts


def _encode(raw: list[bytes], counts: np.ndarray) -> np.ndarray:
    padded = b"".join(b.ljust(int(n) * PASSAGE_BYTES, b"\0") for b, n in zip(raw, counts, strict=True))
    kind = CLASS_OF[np.frombuffer(padded, np.uint8)].reshape(-1, PASSAGE_BYTES)
    passages = len(kind)
    pair = kind[:, :-1] * np.uint8(CLASSES) + kind[:, 1:]
    out = np.zeros((passages, FEATURES), np.float32)
    for first in range(0, passages, 1024):
        block = pair[first : first + 1024].astype(np.int32)
        block += (np.arange(len(block), dtype=np.int32) * CLASSES * CLASSES)[:, None]
        seen = np.bincount(block.ravel(), minlength=len(block) * CLASSES * CLASSES).reshape(len(block), CLASSES, CLASSES)
        seen[:, 0, :] = 0  # what follows padding
        real = np.maximum(1, seen[:, :, 1:].sum(axis=(1, 2)))
        out[first : first + 1024, :CLASSES] = np.sqrt(seen.sum(axis=2) / real[:, None])
        out[first : first + 1024, CLASSES : CLASSES + CLASSES * CLASSES] = np.sqrt(seen.reshape(len(block), -1) / real[:, None])
        out[first : first + 1024, -1] = np.log1p(real) / 6
    at = 0
    for b, n in zip(raw, counts, strict=True):
        words = b.split()
        lines = b.split(b"\n")
        own = out[at : at + n]
        own[:, -2] = 1 - len(set(words)) / max(1, len(words))
        own[:, -3] = 1 - len(set(lines)) / max(1, len(lines))
        for i in range(int(n)):
            near = b[i * PASSAGE_BYTES : (i + 1) * PASSAGE_BYTES].split()
            own[i, -4] = 1 - len(set(near)) / max(1, len(near))
        at += n
    return out


SHAPES = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}


def _attend(p: dict, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict:
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": np.clip(z @ p["c"] + p["d"][0], -30, 30)}


def _bags(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), np.repeat(np.arange(len(counts)), counts)


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> dict:
    """Adam on the mean log loss of the documents. Without examples of both labels the score is constant."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in SHAPES.items()}
    p["mean"], p["scale"] = np.zeros(FEATURES), np.ones(FEATURES)
    if len(bags) == 0 or y.min() == y.max():
        p["c"][:] = 0
        p["d"][0] = 0.0 if len(bags) == 0 else (4.0 if y[0] else -4.0)
        return p
    every = np.concatenate(bags)
    p["mean"], p["scale"] = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 0.02
    del every
    bags = [((b - p["mean"]) / p["scale"]).astype(np.float32) for b in bags]
    p["d"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second, step = {k: 0.0 for k in SHAPES}, {k: 0.0 for k in SHAPES}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for batch in np.array_split(order, max(1, len(bags) // 64)):
            counts = np.array([len(bags[i]) for i in batch])
            starts, of = _bags(counts)
            x = np.concatenate([bags[i] for i in batch])
            r = _attend(p, x, starts, of)
            dl = (1 / (1 + np.exp(-r["logit"])) - y[batch]) / len(batch)
            dz = dl[:, None] * p["c"]
            da = (dz[of] * r["h"]).sum(axis=1)
            de = r["a"] * (da - np.add.reduceat(r["a"] * da, starts)[of])
            dt = de[:, None] * p["w"] * r["g"] * (1 - r["t"] ** 2)
            dg = de[:, None] * p["w"] * r["t"] * r["g"] * (1 - r["g"])
            dh = (r["a"][:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - r["h"] ** 2)
            grad = {
                "W": x.T @ dh, "b": dh.sum(axis=0), "V": r["h"].T @ dt, "U": r["h"].T @ dg,
                "w": ((r["t"] * r["g"]) * de[:, None]).sum(axis=0), "c": r["z"].T @ dl, "d": np.array([dl.sum()]),
            }
            step += 1
            for k in SHAPES:
                grad[k] = grad[k] + (1e-4 * p[k] if k not in "bd" else 0)
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def predict(p: dict, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.zeros(0)
    r = _attend(p, (x - p["mean"]) / p["scale"], *_bags(counts))
    return 1 / (1 + np.exp(-r["logit"]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_TRAINING_BYTES, seed: int = SEED) -> dict:
    """Train on labelled rows outside the held-out fold that have a document; null texts are no examples, repeated ids are one."""
    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = some.groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("bytes"))
    sampled = bounded_sample(labelled(labels, "quality").join(sizes, "doc_id"), max_labelled, seed)
    # Bounded by max_labelled ids, so one task may sum up their sizes, and the chosen ids may be broadcast.
    before = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sampled.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("before") < max_bytes).select("doc_id", "y")
    picked = some.join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, counts = encode(list(rows["text"]))
            bags = np.split(x, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pd.DataFrame({"doc_id": rows["doc_id"], "y": rows["y"], "bag": [b.astype(np.float16).tobytes() for b in bags]})

    one = picked.mapInPandas(features, "doc_id long, y int, bag binary").groupBy("doc_id", "y").agg(F.min("bag").alias("bag"))
    drawn = one.collect()  # a row an id
    drawn.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in drawn]
    return train(bags, np.array([r["y"] for r in drawn], dtype=float), seed)


def score_column(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Column:
    """Train, and give the score in [0, 1] as a column over ``text``; null and empty texts are one empty passage."""
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    release_memory(spark)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = shared.value
        for texts in batches:
            done = []
            for at in range(0, len(texts), 512):
                done.append(predict(p, *encode(list(texts.iloc[at : at + 512]))))
            yield pd.Series(np.concatenate(done) if done else np.zeros(0))

    return score("text")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, ties and repeated rows included.

    Null ids are scored; null and empty texts get the score of one empty passage; texts of any length are read whole. Without
    documents the result is empty, without labels all scores are equal. Further columns of either table are not read.
    """
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(spark, docs, labels).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
