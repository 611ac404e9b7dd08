"""Byte-level BPE with a published rank file: DuckDB recursive queries per partition.

Each partition works in chunks of bounded text. The chunk's distinct words (matches of the split
pattern) become token-position rows; a recursive query joins neighbouring rows with the merge
table, contracts each word's leftmost pair of minimum rank and repeats until no pair is left; ordered
aggregation gives a word's ids, and another one over the token table decodes them. Documents are put together
from their words. Nothing is shuffled.

Texts are cut at single blanks before the pattern runs, so that it runs once per distinct part: the
pattern never matches across a blank that stands between two non-blanks, other than to begin there.
Texts where a blank touches other white space, or white space stands at an end, go through the pattern whole. Cutting texts, numbering their
parts and putting their results together are vectorised; Python sees each distinct part of a chunk once.

A word of more than ``PIECE_BYTES`` bytes is cut into pieces of that size, which are contracted as words. Whether two neighbouring results
may stand side by side is read off a window of the tokens around their seam: a sequence is the encoding of its bytes
if and only if every two neighbouring tokens are the encoding of theirs (the contractions of the whole, restricted to two
tokens, are those of the two alone, up to the first one that would cross). A window that gives back its outermost tokens therefore
replaces what it spans; pieces around any other seam are contracted again as one, all of a word's non-overlapping pairs of
minimum rank in a turn. So long words take time in proportion to their length.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from voxelflow.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 8_000_000
WORDS_PER_QUERY = 20_000
ROWS_PER_QUERY = 1_000_000
KNOWN_WORDS = 300_000
PIECE_BYTES = 96
SEAM_TOKENS = 8
DUCKDB_MEMORY = "200MB"

# step: the words that the last turn changed. best: rank, position and next position of the pair to contract.
ENCODE = """
with recursive step(word, pos, tok, turn) as (
    select word, pos, tok, 0::int from pieces
    union all
    select s.word, s.pos, case when s.pos = ((b.best >> 22) & 4194303) then (b.best >> 44)::int else s.tok end, s.turn + 1
    from step s join (
        select p.word, min((m.rank::bigint << 44) | (p.pos::bigint << 22) | p.next_pos) as best
        from (
            select word, pos, tok, lead(tok) over w as next_tok, lead(pos) over w as next_pos
            from step window w as (partition by word order by pos)
        ) p join merges m on m.pair = p.tok::bigint * 65536 + p.next_tok
        group by p.word
    ) b on b.word = s.word
    where s.pos <> (b.best & 4194303)
)
select s.word, string_agg(t.name, ' ' order by s.pos) as ids, count(*)::int as n, unhex(string_agg(t.bytes, '' order by s.pos)) as decoded
from step s
join (select word, max(turn) as turn from step group by word) done using (word, turn)
join tokens t on t.id = s.tok
group by s.word
"""

# The same for long pieces: a turn contracts, from the left, all pairs of the minimum rank that do not overlap, unless a pair
# with the new token could come before them (merges.alone); then the leftmost one only.
ENCODE_LONG = """
with recursive step(word, pos, tok, turn) as (
    select word, pos, tok, 0::int from pieces
    union all
    select word, pos, tok, turn from (
        with p as (
            select word, pos, tok, turn, lead(tok) over w as next_tok, lead(pos) over w as next_pos, row_number() over w as place
            from step window w as (partition by word order by pos)
        ), m as (
            select p.*, merges.rank, merges.alone from p left join merges on merges.pair = p.tok::bigint * 65536 + p.next_tok
        ), best as (
            select *, min(rank) over (partition by word) as low from m
        ), hit as (
            select word, place, pos, next_pos, rank, alone, place - row_number() over (partition by word order by place) as island,
                row_number() over (partition by word order by place) as nth
            from best where rank = low
        ), chosen as (
            select word, pos, next_pos, rank from (
                select *, row_number() over (partition by word, island order by place) as own from hit
            ) where case when alone then nth = 1 else own % 2 = 1 end
        )
        select b.word, b.pos, coalesce(c.rank, b.tok) as tok, b.turn + 1 as turn
        from best b
        left join chosen c on c.word = b.word and c.pos = b.pos
        left join chosen gone on gone.word = b.word and gone.next_pos = b.pos
        where b.low is not null and gone.pos is null
    )
)
select s.word, string_agg(t.name, ' ' order by s.pos) as ids, count(*)::int as n, unhex(string_agg(t.bytes, '' order by s.pos)) as decoded
from step s
join (select word, max(turn) as turn from step group by word) done using (word, turn)
join tokens t on t.id = s.tok
group by s.word
"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    """One process's encoder: the merge and token tables in DuckDB, and the words met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ranks must stay below 65536")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.token = {rank: token for token, rank in ranks.items()}
        pairs, merged, soonest = [], [], {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    merged.append(rank)
                    for part in (left, right):
                        soonest[part] = min(rank, soonest.get(part, rank))
        alone = [soonest.get(rank, rank + 1) <= rank for rank in merged]
        self.merges = pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(merged, pa.int32()), "alone": pa.array(alone)})
        self.tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "name": [str(r) for r in ranks.values()], "bytes": [t.hex() for t in ranks]})
        self.db = None
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.long: dict[str, tuple[str, int, bytes]] = {}

    def open(self) -> None:
        """Make the tables, if they are not there."""
        if self.db is None:
            self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": tempfile.gettempdir()})
            for name in ("merges", "tokens"):
                self.db.register("incoming", getattr(self, name))
                self.db.execute(f"create table {name} as select * from incoming")
                self.db.unregister("incoming")

    def close(self, keep_words: bool = True) -> None:
        """Give the tables' memory back; the parts met lately stay, within KNOWN_WORDS a generation, if they are to be kept."""
        if not keep_words:
            self.known, self.older = {}, {}
        if self.db is not None:
            self.db.close()
            self.db = None
        self.long = {}
        gc.collect()
        release_memory()

    def _contract(self, raw: list[bytes], query: str = ENCODE) -> list[tuple[str, int, bytes]]:
        """Ids joined by blanks, how many, and decoded bytes of some non-empty pieces, in batches of bounded size."""
        self.open()
        # A piece of n bytes makes about n * n / 2 rows.
        rows, found, start = 0, [], 0
        for at, piece in enumerate(raw):
            if at > start and (at - start >= WORDS_PER_QUERY or rows + len(piece) ** 2 // 2 > ROWS_PER_QUERY):
                found += self._query(raw[start:at], query)
                rows, start = 0, at
            rows += len(piece) ** 2 // 2
        return found + (self._query(raw[start:], query) if start < len(raw) else [])

    def _query(self, raw: list[bytes], query: str) -> list[tuple[str, int, bytes]]:
        size = np.array([len(b) for b in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        rows = {
            "word": np.repeat(np.arange(len(raw), dtype=np.int32), size),
            "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32),
            "tok": self.byte[flat],
        }
        self.db.register("pieces", pa.table(rows))
        found: list = [None] * len(raw)
        for word, *result in self.db.execute(query).fetchall():
            found[word] = tuple(result)
        self.db.unregister("pieces")
        return found

    def _each_once(self, raw: list[bytes], query: str = ENCODE) -> dict[bytes, list[int]]:
        distinct = sorted(set(raw), key=len)
        return {b: list(map(int, ids.split())) for b, (ids, _, _) in zip(distinct, self._contract(distinct, query), strict=True)}

    def _contract_long(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of any length: of their pieces, put together at the seams."""
        cut = [[w[at : at + PIECE_BYTES] for at in range(0, len(w), PIECE_BYTES)] for w in words]
        met = self._each_once([p for pieces in cut for p in pieces])
        parts = [[met[p] for p in pieces] for pieces in cut]
        done: list = [None] * len(words)
        while todo := [k for k, ids in enumerate(done) if ids is None]:
            windows: dict[int, list[tuple[list[int], list[int]]]] = {}
            for k in todo:
                reach = [max(1, min(SEAM_TOKENS, len(ids) // 2)) for ids in parts[k]]
                windows[k] = [(a[-i:], b[:j]) for a, b, i, j in zip(parts[k], parts[k][1:], reach, reach[1:], strict=False)]
            bytes_of = lambda ids: b"".join([self.token[i] for i in ids])
            met = self._each_once([bytes_of(a + b) for own in windows.values() for a, b in own])
            apart: dict[int, list[list[int]]] = {}  # groups of parts that must be contracted as one
            for k in todo:
                seams = [(a, b, met[bytes_of(a + b)]) for a, b in windows[k]]
                groups = [[0]]
                for at, (a, b, now) in enumerate(seams, 1):
                    if now[0] == a[0] and now[-1] == b[-1]:
                        groups.append([at])
                    else:
                        groups[-1].append(at)
                if len(groups) < len(parts[k]):
                    apart[k] = groups
                    continue
                ids, skip = [], 0
                for own, (a, b, now) in zip(parts[k], seams, strict=False):
                    ids += own[skip : len(own) - len(a)] + now if len(own) - len(a) >= skip else now[skip - len(own) + len(a) :]
                    skip = len(b)
                done[k] = ids + parts[k][-1][skip:]
            whole = {(k, g[0]): b"".join([bytes_of(parts[k][at]) for at in g]) for k, groups in apart.items() for g in groups if len(g) > 1}
            met = self._each_once(list(whole.values()), ENCODE_LONG)
            for k, groups in apart.items():
                parts[k] = [met[whole[k, g[0]]] if len(g) > 1 else parts[k][g[0]] for g in groups]
        return done

    def learn(self, parts: list[str]) -> list[tuple[str, int, bytes]]:
        """(ids joined by blanks, how many, decoded bytes) of each part of a text, a part being one or more matches of the pattern."""
        if len(self.known) > KNOWN_WORDS:  # two generations: parts that are met again move to the younger one
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new, words = {}, set()
        for p in parts:
            if p not in known:
                if (met := older.get(p)) is not None:
                    known[p] = met
                else:
                    found = self.pattern.findall(p)
                    words.update(found)
                    if len(found) > 1:
                        new[p] = found
        todo, long = [], []
        for w in words:
            if w not in known:
                if (met := older.get(w)) is not None:
                    known[w] = met
                    continue
                raw = w.encode("utf-8", "replace")
                rank = self.ranks.get(raw)
                if rank is not None:
                    known[w] = (str(rank), 1, raw)
                else:
                    (todo if len(raw) <= PIECE_BYTES else long).append((w, raw))
        # Long words take as many turns as they have merges, so they don't hold up the others.
        todo.sort(key=lambda x: len(x[1]))
        for (w, _), result in zip(todo, self._contract([raw for _, raw in todo]), strict=True):
            known[w] = result
        self.long = {}
        for (w, _), ids in zip(long, self._contract_long([raw for _, raw in long]), strict=True):
            self.long[w] = (" ".join(map(str, ids)), len(ids), self._decode(ids))
        for p, found in new.items():
            own = [known.get(w) or self.long[w] for w in found]
            whole = (" ".join([x[0] for x in own]), sum([x[1] for x in own]), b"".join([x[2] for x in own]))
            (known if len(p) <= PIECE_BYTES else self.long)[p] = whole
        return [known.get(p) or self.long[p] for p in parts]

    def _decode(self, ids: list[int]) -> bytes:
        """Ordered aggregation over the token table."""
        self.open()
        self.db.register("ids", pa.table({"pos": np.arange(len(ids), dtype=np.int64), "id": np.array(ids, np.int32)}))
        decoded = self.db.execute("select string_agg(t.bytes, '' order by i.pos) from ids i join tokens t on t.id = i.id").fetchall()[0][0]
        self.db.unregister("ids")
        return bytes.fromhex(decoded)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[str], int, list[bytes]]]:
        """For each text its ids as strings of ids, how many ids, and the decoded pieces."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, numbered = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        distinct, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(texts)), np.diff(ends))
        edged = np.array([not w or w[0].isspace() or w[-1].isspace() for w in distinct], bool)
        whole = np.zeros(len(texts), bool)  # texts that the pattern must see whole
        whole[of[edged[number]]] = True
        first = np.zeros(len(number), bool)
        first[ends[:-1]] = True  # the other parts begin with their blank
        cut = ~whole[of]
        code = (number * 2 + first)[cut]
        met = np.zeros(2 * len(distinct), bool)
        met[code] = True
        parts = [distinct[c >> 1] if c & 1 else " " + distinct[c >> 1] for c in np.flatnonzero(met).tolist()]
        done = dict(zip(np.flatnonzero(~whole).tolist(), self._together(parts, (np.cumsum(met) - 1)[code], np.bincount(of[cut], minlength=len(texts))[~whole]), strict=True))
        places: dict[str, int] = {}
        matches = [[places.setdefault(w, len(places)) for w in self.pattern.findall(texts[at])] for at in np.flatnonzero(whole).tolist()]
        sizes = np.array([len(m) for m in matches], np.int64)
        done.update(zip(np.flatnonzero(whole).tolist(), self._together(list(places), np.array([x for m in matches for x in m], np.int64), sizes), strict=True))
        for at in range(len(texts)):
            ids, n, raw = done[at]
            yield [ids] if n else [], n, [raw]

    def _together(self, parts: list[str], places: np.ndarray, sizes: np.ndarray) -> list[tuple[str, int, bytes]]:
        """The results of texts of ``sizes`` parts each, which are those at ``places``."""
        got = self.learn(parts)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counted = np.concatenate([[0], np.cumsum(np.array([x[1] for x in got], np.int64)[places])])
        n = counted[ends[1:]] - counted[ends[:-1]]
        at = pa.array(places)

        def joined(column: int, kind: pa.DataType, between: str | bytes) -> list:
            rows = pa.array([x[column] for x in got], kind).take(at)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.scalar(between, kind)).to_pylist()

        return list(zip(joined(0, pa.large_string(), " "), n.tolist(), joined(2, pa.large_binary(), b""), strict=True))


def release_memory() -> None:
    """Hand freed memory back to the system where the C library can, so that a reused worker does not hold it in later stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        column, docs = batch.column("text"), batch.column("doc_id")
        for i in range(batch.num_rows):
            text = column[i].as_py() or ""
            ids.append(docs[i].as_py())
            texts.append(text)
            size += len(text)
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def encode_documents(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    emit: str = "ids",
    chunk_chars: int = CHUNK_CHARS,
    keep_words: bool = True,
) -> DataFrame:
    """Encode every whole text; one row per input row, repeated rows and null ids included.

    ``emit="ids"`` gives (doc_id, n_tokens, ids, decoded); ``emit="digests"`` gives their SHA-256 in place of the
    last two. A null text counts as empty: no ids. Texts and words of any length are encoded whole. An empty table gives
    an empty result. Further columns are not read. ``vocabulary`` is the path
    of a rank file that the driver reads; executors get its bytes (below a megabyte) by broadcast. ``keep_words`` lets Python workers
    remember words from task to task, which is faster; without it they hold none when later steps run beside them.
    """
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), pattern))
    as_ids = emit == "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        try:
            for doc_ids, texts in _chunks(batches, chunk_chars):
                counts, first, second = [], [], []
                for ids, n, decoded in own.encode(texts):
                    joined, raw = " ".join(ids), b"".join(decoded)
                    counts.append(n)
                    if as_ids:
                        first.append([int(x) for x in joined.split()])
                        second.append(raw.decode("utf-8", "replace"))
                    else:
                        first.append(hashlib.sha256(joined.encode()).hexdigest())
                        second.append(hashlib.sha256(raw).hexdigest())
                kind = pa.list_(pa.int32()) if as_ids else pa.string()
                names = ["doc_id", "n_tokens", *(("ids", "decoded") if as_ids else ("ids_sha256", "decoded_sha256"))]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            own.close(keep_words)

    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded string" if as_ids else "ids_sha256 string, decoded_sha256 string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"), emit="digests")
