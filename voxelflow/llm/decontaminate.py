"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single blanks. An item of m characters may differ by
e = floor(m * ERROR_RATE) edits from a stretch of a document. Cut into e + 1 pieces, at least one piece of it must
then occur unchanged, so an automaton over all pieces finds every place worth looking at, and Myers'
bit-parallel algorithm gives the exact edit distance there. It first tries the stretches of 2, 4, 8, ... pieces around the
piece found: were the item within its budget, some piece would have all of these within theirs (pieces less
one), by the same argument over halves; chance hits fail at the first of them.

Items of fewer than ``BOUNDED_CHARS`` characters have the same budget, but the stretch must begin and end at the edge of a word, as short
items would else be found inside of longer words; beside letters of scripts written without blanks every place is an edge. Items of
signs only, of which nothing is left, are sought unchanged but for blanks and case in the text as it is; the sign at an edge must not go on.

Documents are read once per block of items, whole and without a shuffle. A block's size is bounded by
``BLOCK_CHARS``, so it may be broadcast whatever the number of items. Where there are several blocks, one at a time is at the
driver and its result is written before the next.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.llm.common import Scratch, table

ERROR_RATE = 0.10
MIN_ITEM_CHARS = 1  # nothing is left of shorter items; their signs are compared
BOUNDED_CHARS = 24  # shorter items must be whole words
BLOCK_CHARS = 2_000_000
NOT_WORD = re.compile(r"[\W_]+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")  # Thai, Lao, Burmese, Khmer, kana, Han


def normal(text: str | None) -> str:
    return NOT_WORD.sub(" ", (text or "").lower()).strip()


def signs(text: str | None) -> str:
    """A text as items of signs only are sought in it."""
    return " ".join((text or "").lower().split())


def find_signs(text: str, item: str) -> int:
    """Where an item of signs only begins, the same sign not going on before or after it; -1 if nowhere."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if text[max(at - 1, 0) : at] != item[0] and text[end : end + 1] != item[-1]:
            return at
        at = text.find(item, at + 1)
    return -1


def is_edge(text: str, at: int) -> bool:
    """Whether a word begins or ends before character ``at``."""
    if at <= 0 or at >= len(text) or text[at - 1] == " " or text[at] == " ":
        return True
    return bool(UNSPACED.match(text[at - 1]) or UNSPACED.match(text[at]))


def bounded_match(pattern: str, text: str, start: int, most: int) -> tuple[int, int, int] | None:
    """Least distance, begin and end of a stretch of whole words that begins within ``most`` of ``start``; on ties the one that ends, then begins, first."""
    m, best = len(pattern), None
    for begin in range(max(0, start - most), start + most + 1):
        if begin >= len(text) or text[begin] == " " or not is_edge(text, begin):
            continue
        window = text[begin : begin + m + most]
        row = list(range(m + 1))  # distances of the pattern's prefixes to the stretch so far
        for size in range(1, len(window) + 1):
            before, row = row, [size]
            for i, c in enumerate(pattern, 1):
                row.append(min(before[i] + 1, row[-1] + 1, before[i - 1] + (c != window[size - 1])))
            if row[m] <= most and (best is None or (row[m], begin + size) < (best[0], best[2])) and window[size - 1] != " " and is_edge(text, begin + size):
                best = (row[m], begin, begin + size)
    return best


def best_match(pattern_bits: dict[str, int], m: int, window: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any stretch of ``window`` and the first end where it is met, if at most ``most``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = most + 1, -1
    for at, c in enumerate(window):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return (best, end) if best <= most else None


def bit_masks(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for at, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | (1 << at)
    return bits


def ancestors(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece, the ranges of pieces above it in a binary tree, from the smallest to the whole."""
    above: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    stack = [(0, pieces)]
    while stack:
        a, b = stack.pop()
        for k in range(a, b):
            above[k].insert(0, (a, b))
        if b - a > 1:
            stack += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return [own[1:] or own for own in above]


class Items:
    """An automaton over the pieces of a block of items (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, least: int = MIN_ITEM_CHARS):
        self.items = []
        self.signs: list[tuple[int, str]] = []
        of_piece: dict[str, list[tuple]] = {}
        for item_id, text in items:
            own = normal(text)
            if len(own) < least:
                if not own and (raw := signs(text)):
                    self.signs.append((item_id, raw))
                continue
            budget = math.floor(len(own) * rate)
            cuts = [len(own) * k // (budget + 1) for k in range(budget + 2)]
            masks: dict[tuple[int, int], tuple] = {}  # start in the item, length, errors, bits of each stretch
            for k, above in enumerate(ancestors(budget + 1)):
                for a, b in above:
                    if (a, b) not in masks:
                        stretch = own[cuts[a] : cuts[b]]
                        masks[a, b] = (cuts[a], len(stretch), b - a - 1, bit_masks(stretch))
                piece = own[cuts[k] : cuts[k + 1]]
                of_piece.setdefault(piece, []).append((len(self.items), cuts[k], [masks[r] for r in above]))
            self.items.append((item_id, own if len(own) < BOUNDED_CHARS else None, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in of_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if of_piece:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start bound, end) of each item's best place in the normalised text; the one that ends first on ties.

        Places of items of signs only are those in the text as it is, blanks joined.
        """
        if not text:
            return []
        shown = signs(text) if self.signs else ""
        places = [(item_id, 0, at, at + len(item)) for item_id, item in self.signs if (at := find_signs(shown, item)) >= 0]
        return self._find_words(normal(text)) + places if self.items else places

    def _find_words(self, own: str) -> list[tuple[int, int, int, int]]:
        found: dict[int, tuple[int, int, int]] = {}
        looked: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(own):
            for k, offset, stretches in places:
                start = last - size + 1 - offset
                if k in found and found[k][0] == 0 or (k, start) in looked:
                    continue
                for begin, length, errors, bits in stretches:
                    low = max(0, start + begin - errors)
                    hit = best_match(bits, length, own[low : start + begin + length + errors], errors)
                    if hit is None:
                        break
                else:
                    # The last stretch is the whole item, in a window that reaches its budget to both sides.
                    looked.add((k, start))
                    _, pattern, budget = self.items[k]
                    if pattern is not None:
                        place = bounded_match(pattern, own, start, budget)
                    else:
                        place = (hit[0], low, low + hit[1])
                    if place and (k not in found or (place[0], place[2], place[1]) < (found[k][0], found[k][2], found[k][1])):
                        found[k] = place
        return [(self.items[k][0], *where) for k, where in sorted(found.items())]


_matchers: dict[str, Items] = {}


def _matcher(block: _Block) -> Items:
    if block.id not in _matchers:
        _matchers.clear()
        _matchers[block.id] = Items(block.value)
    return _matchers[block.id]


class _Block:
    """A broadcast block of items with an identity, so that a worker builds its automaton once."""

    def __init__(self, spark: SparkSession, items: list):
        self.shared, self.id = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @property
    def value(self) -> list:
        return self.shared.value


class Blocks:
    """The items in blocks of about ``block_chars`` characters, each collected and broadcast when its turn comes. Null texts take no part.

    Items with a null id cannot be named in a result and take part only with ``null_ids``, all as item -1.
    """

    def __init__(self, spark: SparkSession, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, null_ids: bool = False):
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
        items = items.withColumn("item_id", F.coalesce("item_id", F.lit(-1))) if null_ids else items.where("item_id is not null")
        chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.spark, self.n = spark, max(1, -(-chars // block_chars))
        self.dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)))

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[_Block]:
        for k in range(self.n):
            yield _Block(self.spark, sorted((r["item_id"], r["text"]) for r in self.dealt.where(F.col("block") == k).collect()))


def blocks(spark: SparkSession, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, null_ids: bool = False) -> Blocks:
    return Blocks(spark, benchmark, block_chars, null_ids)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each document's best place of each item that occurs in it.

    ``end`` is where the match ends in the normalised text, of equal distances the first; ``start`` is a bound from which it can be found. Null
    and empty texts have no rows; repeated rows repeat theirs; texts of any length are searched whole. Without documents or
    items the result is empty. Further columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())

    def over(block: _Block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = _matcher(block)
            for rows in batches:
                found = [(d, *hit) for d, t in zip(rows["doc_id"].astype(object), rows["text"], strict=True) for hit in own.find(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64"})

        return run

    every, out, scratch = blocks(spark, benchmark, block_chars), None, Scratch(spark, "decontamination")
    for k, block in enumerate(every):
        part = narrow.mapInPandas(over(block), "doc_id long, item_id long, distance int, start long, end long")
        if len(every) > 1:
            part = scratch.table(part, f"block-{k}")
            block.shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item occurs; null and empty texts stay, and without items all do."""
    every, scratch = blocks(spark, benchmark, block_chars, null_ids=True), Scratch(spark, "decontamination")
    for k, block in enumerate(every):

        def make(block: _Block):
            @F.pandas_udf("boolean")
            def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                own = _matcher(block)
                for texts in batches:
                    yield pd.Series([not own.find(t) for t in texts], dtype=bool)

            return free

        docs = docs.where(make(block)("text"))
        if len(every) > 1:
            docs = scratch.table(docs, f"block-{k}")
            block.shared.destroy()
            if k:
                scratch.drop(f"block-{k - 1}")
    return docs


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
