"""Document scores by masked pseudo-likelihood.

A small network sees the tokens on both sides of a masked position and predicts the token there; a document's score is the sum of
the log-probabilities of all its words. Tokens are lower-cased words: the corpus's commonest ones, and classes of all
others by their ending; a boundary stands at both ends of a text. A word of a class scores log P(class) + log P(word | class), the
latter from the word's own count over the corpus, so no two words of different counts score alike.

All of this grows with the corpus. There are about sqrt(words) / ``SHARE`` tokens; above ``LEAST_TOKENS`` the softmax has two levels
(a group of tokens, then the token), so a position costs the square root of their number. The network learns from every window of every
document: each task goes over the windows (left, middle, right) of its own documents, and the tasks' networks are averaged after each of
``ROUNDS`` disjoint parts of the corpus. A corpus of up to ``SMALL`` words is gone over repeatedly by one task. Counts of words stay a
distributed table; those of the ``CACHED`` commonest are broadcast, those of all others are joined to the words of each document.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.llm.common import Scratch, table

LEAST_TOKENS, LEAST_RARE = 128, 40
SHARE = 4
ENDING = 2
HIDDEN = 32
SEED = 3
CACHED = 100_000
COUNTED_WORDS = 300_000
CHUNK_TOKENS = 2_000_000
BATCH, LEAST_STEPS = 16_384, 400
SMALL = 2_000_000
ROUNDS = 3
TASKS = 64
DIGITS = 12  # of a word's digest: 48 bits, beside its class


def sizes(words: int) -> tuple[int, int]:
    """How many tokens, and how many of them classes, a corpus of so many words gets."""
    tokens = max(LEAST_TOKENS, math.isqrt(words) // SHARE)
    return tokens, max(LEAST_RARE, tokens // 4)


class TokenIds(dict):
    """Word -> code. Codes below ``tokens`` are tokens; those from there on are words of a class with a known count; negative ones are other
    words, -1 - (class << 48 | digest); training, which needs the class alone, leaves the digest at 0."""

    digests = True

    def __init__(self, frequent: list[str], known: dict[str, int] | None = None, rare: int = LEAST_RARE, tokens: int = LEAST_TOKENS, totals: np.ndarray | None = None):
        self.rare, self.first_rare, self.tokens = rare, tokens - rare, tokens
        self.base = {w: 1 + i for i, w in enumerate(frequent)}
        self.log_totals = np.log(np.maximum(np.zeros(rare) if totals is None else totals, 1.0))
        known = known or {}
        of_known = np.array([self.class_of(w) for w in known], np.int64)
        self.base.update((w, tokens + i) for i, w in enumerate(known))
        self.token_of = np.concatenate([np.arange(tokens), self.first_rare + of_known])
        self.own = np.concatenate([np.zeros(tokens), np.log(np.array(list(known.values()), float)) - self.log_totals[of_known]])
        super().__init__(self.base)

    def class_of(self, word: str) -> int:
        return zlib.crc32(word[-ENDING:].encode("utf-8", "replace")) % self.rare

    def __missing__(self, word: str) -> int:
        digest = int(hashlib.md5(word.encode("utf-8", "replace")).hexdigest()[:DIGITS], 16) if self.digests else 0
        code = -1 - (self.class_of(word) << 48 | digest)
        if len(self) > len(self.base) + COUNTED_WORDS:
            self.clear()
            self.update(self.base)
        self[word] = code
        return code

    def resolve(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's token, and log P(word | class) less the logarithm of counts that are not known here."""
        at = np.maximum(codes, 0)
        tokens, own = self.token_of[at], self.own[at]
        unknown = np.flatnonzero(codes < 0)
        group = (-1 - codes[unknown]) >> 48
        tokens[unknown], own[unknown] = self.first_rare + group, -self.log_totals[group]
        return tokens, own


def word_key(word: Column, rare: int) -> Column:
    """class << 48 | digest of a word, as in TokenIds."""
    digest = F.conv(F.substring(F.md5(word.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    return F.shiftleft(word_class(word, rare), 48).bitwiseOR(digest)


def word_class(word: Column, rare: int) -> Column:
    return F.crc32(F.substring(word, -ENDING, ENDING).cast("binary")) % rare


def token_ids(text: str | None, ids: TokenIds) -> np.ndarray:
    return np.array([ids[w] for w in (text or "").lower().split()], dtype=np.int64)


def chunks(texts: list, ids: TokenIds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all words of some texts, each text between boundaries, and how many words each text has."""
    codes, lengths = [0], []
    for text in texts:
        words = (text or "").lower().split()
        codes.extend(map(ids.__getitem__, words))
        codes.append(0)
        lengths.append(len(words))
        if len(codes) >= CHUNK_TOKENS:
            yield np.array(codes, np.int64), np.array(lengths)
            codes, lengths = [0], []
    if lengths:
        yield np.array(codes, np.int64), np.array(lengths)


def windows(codes: np.ndarray, ids: TokenIds) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (middle, left, right) of all positions, and what the words' own counts add there."""
    tokens, own = ids.resolve(codes)
    at = np.flatnonzero(codes)
    return (tokens[at] * ids.tokens + tokens[at - 1]) * ids.tokens + tokens[at + 1], own[at]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update((text.as_py() or "").lower().split())
                if len(counts) > COUNTED_WORDS:
                    yield emit()
                    counts.clear()
        yield emit()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame) -> tuple[dict, int, int]:
    """Arguments of TokenIds, the number of words, and the least count of which all words are in them."""
    counts = sorted(((r["n"], r["types"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("types")).collect()), reverse=True)
    total = sum(n * types for n, types in counts)
    tokens, rare = sizes(total)
    frequent = tokens - 1 - rare
    least, held = (counts[0][0] + 1 if counts else 1), 0
    for n, types in counts:
        held += types
        if held > frequent + CACHED:
            break
        least = n
    common = words.where(F.col("n") >= least).toArrow()
    common = sorted(zip(common["word"].to_pylist(), common["n"].to_pylist(), strict=True), key=lambda w: (-w[1], w[0]))
    top, known = common[:frequent], dict(common[frequent:])
    totals = np.zeros(rare)
    for r in words.groupBy(word_class(F.col("word"), rare).alias("class")).agg(F.sum("n").alias("n")).collect():
        totals[r["class"]] = r["n"]
    args = {"frequent": [w for w, _ in top], "known": known, "rare": rare, "tokens": tokens}
    ids = TokenIds([], None, rare, tokens)
    for w, n in top:
        totals[ids.class_of(w)] -= n
    return args | {"totals": totals}, total, least


def group_size(tokens: int) -> int:
    return tokens if tokens <= LEAST_TOKENS else math.isqrt(tokens - 1) + 1


def initial(tokens: int, seed: int = SEED) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda scale, n: rng.normal(0, scale, (n, HIDDEN)).astype(np.float32)
    groups = -(-tokens // group_size(tokens))
    return {
        "left": draw(0.5, tokens), "right": draw(0.5, tokens), "b": np.zeros(HIDDEN, np.float32),
        "W": draw(0.1, tokens).T, "c": np.zeros(tokens, np.float32), "V": draw(0.1, groups).T, "d": np.zeros(groups, np.float32),
    }


def _log_chosen(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of each column's softmax at its target. Overwrites ``z``. (Reductions down columns are the fast ones.)"""
    z -= z.max(axis=0)
    chosen = z[target, np.arange(len(target))]
    return chosen - np.log(np.exp(z, out=z).sum(axis=0))


def _scores(p: dict, h: np.ndarray, weights: str, bias: str, a: int, b: int) -> np.ndarray:
    return p[weights][:, a:b].T @ h.T + p[bias][a:b, None]


def _parts(middle: np.ndarray, tokens: int) -> Iterator[tuple[slice, int, int]]:
    """Stretches of sorted tokens of one group: where they are, and the group's tokens."""
    size = group_size(tokens)
    starts = np.searchsorted(middle, np.arange(0, tokens + size, size))
    for g, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if a < b:
            yield slice(a, b), g * size, min((g + 1) * size, tokens)


def split(window: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return window // tokens % tokens, window // tokens**2, window % tokens


def log_probabilities(p: dict, window: np.ndarray) -> np.ndarray:
    """log P(middle | left, right) of windows in ascending order."""
    tokens, out = len(p["c"]), np.zeros(len(window), np.float32)
    for at in range(0, len(window), BATCH):
        left, middle, right = split(window[at : at + BATCH], tokens)
        h = np.tanh(p["left"][left] + p["right"][right] + p["b"])
        own = out[at : at + BATCH]
        if len(p["d"]) > 1:
            own += _log_chosen(_scores(p, h, "V", "d", 0, len(p["d"])), middle // group_size(tokens))
        for where, a, b in _parts(middle, tokens):
            own[where] += _log_chosen(_scores(p, h[where], "W", "c", a, b), middle[where] - a)
    return out


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[first], np.add.reduceat(values[order], first, axis=0)


class Adam:
    """Adam on the mean log loss of batches of windows; embeddings move only where a batch has them."""

    def __init__(self, p: dict):
        self.p, self.at = {k: v.copy(order="K") for k, v in p.items()}, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def _move(self, k: str, grad: np.ndarray, rate: float, rows=...) -> None:
        first = self.first[k][rows] = 0.9 * self.first[k][rows] + 0.1 * grad
        second = self.second[k][rows] = 0.999 * self.second[k][rows] + 0.001 * grad**2
        self.p[k][rows] -= rate * (first / (1 - 0.9**self.at)) / (np.sqrt(second / (1 - 0.999**self.at)) + 1e-7)

    def step(self, window: np.ndarray, n: np.ndarray, rate: float) -> None:
        """One step on windows in ascending order, each counted ``n`` times."""
        p, tokens = self.p, len(self.p["c"])
        self.at += 1
        left, middle, right = split(window, tokens)
        weight = (n / n.sum()).astype(np.float32)
        h = np.tanh(p["left"][left] + p["right"][right] + p["b"])
        dh, moves = np.zeros_like(h), {}

        def loss(where, target, name, bias, a, b):
            z = _scores(p, h[where], name, bias, a, b)
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z *= weight[where] / z.sum(axis=0)
            z[target, np.arange(len(target))] -= weight[where]
            moves.setdefault(name, np.zeros_like(p[name]))[:, a:b] = (z @ h[where]).T
            moves.setdefault(bias, np.zeros_like(p[bias]))[a:b] = z.sum(axis=1)
            dh[where] += z.T @ p[name][:, a:b].T

        if len(p["d"]) > 1:
            loss(slice(None), middle // group_size(tokens), "V", "d", 0, len(p["d"]))
        for where, a, b in _parts(middle, tokens):
            loss(where, middle[where] - a, "W", "c", a, b)
        dh *= 1 - h * h
        for k, grad in moves.items():
            self._move(k, grad, rate)
        self._move("b", dh.sum(axis=0), rate)
        for k, rows in (("left", left), ("right", right)):
            touched, grad = _row_sums(rows, dh)
            self._move(k, grad, rate, touched)


def train(p: dict, counted: Iterator[tuple[np.ndarray, np.ndarray]], least_steps: int, seed: int = SEED) -> tuple[dict, int]:
    """The network after all counted windows, gone over again until there are ``least_steps``; and how many words it saw."""
    rng, adam, seen, held = np.random.default_rng(seed), Adam(p), 0, []

    def over(window: np.ndarray, n: np.ndarray) -> None:
        order = rng.permutation(len(window))
        for at in range(0, len(window), BATCH):
            own = np.sort(order[at : at + BATCH])
            adam.step(window[own], n[own], 0.03 / math.sqrt(1 + adam.at / 100))

    for window, n in counted:
        seen += int(n.sum())
        over(window, n)
        if least_steps:
            held.append((window, n))
    while held and adam.at < least_steps:
        for window, n in held:
            over(window, n)
    return adam.p, seen


def fit_network(spark: SparkSession, docs: DataFrame, args: dict, words: int) -> dict:
    """Trains over all windows; tasks' networks are averaged by the words that they saw."""
    p = initial(args["tokens"])
    if not words:
        return p
    small = words <= SMALL
    rounds, tasks = (1, 1) if small else (ROUNDS, min(TASKS, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast(args)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            ids = TokenIds(**shared.value)
            ids.digests = False
            texts = (t.as_py() for batch in batches for t in batch.column("text"))
            counted = (np.unique(windows(codes, ids)[0], return_counts=True) for codes, _ in chunks(texts, ids))
            own, seen = train(start.value, (c for c in counted if len(c[0])), LEAST_STEPS if small else 0)
            if seen:
                parts = [[k for k in own], [np.ascontiguousarray(v).tobytes() for v in own.values()], [seen] * len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(parts[0]), pa.array(parts[1], pa.binary()), pa.array(parts[2], pa.int64())], names=["name", "value", "seen"])

        part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).coalesce(tasks)
        got = part.mapInArrow(run, "name string, value binary, seen long").collect()
        seen = sum(r["seen"] for r in got if r["name"] == "b")
        if seen:
            fresh = {k: np.zeros(v.shape) for k, v in p.items()}
            for r in got:
                fresh[r["name"]] += np.frombuffer(r["value"], np.float32).reshape(fresh[r["name"]].shape) * (r["seen"] / seen)
            p = {k: v.astype(np.float32) for k, v in fresh.items()}
    return p


def fit(docs: DataFrame) -> tuple[list[str], dict]:
    """The commonest words and the trained network."""
    args, total, _ = vocabulary(count_words(docs))
    return args["frequent"], fit_network(docs.sparkSession, docs, args, total)


def pseudo_likelihood(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_probability), one row per input row, repeated rows and null ids included.

    Null and empty texts have no tokens, a sum of 0 and no mean. Further columns are not read.
    """
    scratch = Scratch(spark, "lm")
    words = scratch.table(count_words(docs), "words")
    scratch.release_memory()
    args, total, least = vocabulary(words)
    shared = spark.sparkContext.broadcast((args, fit_network(spark, docs, args, total)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        args, p = shared.value
        ids = TokenIds(**args)
        for rows in batches:
            n, sums, others = [], [], []
            for codes, lengths in chunks(list(rows["text"]), ids):
                window, own = windows(codes, ids)
                seen, back = np.unique(window, return_inverse=True)
                logs = np.concatenate([[0.0], np.cumsum(log_probabilities(p, seen)[back] + own, dtype=np.float64)])
                ends = np.cumsum(lengths)
                n.append(lengths)
                sums.append(logs[ends] - logs[ends - lengths])
                codes = codes[codes != 0]
                unknown = np.flatnonzero(codes < 0)
                others += np.split(-1 - codes[unknown], np.searchsorted(unknown, ends[:-1]))
            n, sums = (np.concatenate(x) if x else np.zeros(0) for x in (n, sums))
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_tokens": n.astype(np.int64), "partial": sums, "others": pd.Series(others, dtype=object)})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = narrow.mapInPandas(run, "doc_id long, n_tokens long, partial double, others array<long>")
    total_log = F.col("partial")
    if least > 1:  # words counted less often are not in the broadcast; log 1 adds nothing
        scored = scratch.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        counts = words.where((F.col("n") > 1) & (F.col("n") < least)).select(word_key(F.col("word"), args["rare"]).alias("key"), F.log("n").alias("log_n"))
        added = scored.select("row", F.explode("others").alias("key")).join(counts, "key").groupBy("row").agg(F.sum("log_n").alias("added"))
        scored = scored.drop("others").join(added, "row", "left")
        total_log = F.col("partial") + F.coalesce("added", F.lit(0.0))
    return scored.select("doc_id", "n_tokens", total_log.alias("log_likelihood")).withColumn(
        "mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    )


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark, table(spark, sf_dir, "documents"))
