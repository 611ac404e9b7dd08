"""Chat formatting at token level.

The template is ``<s>`` before a conversation's first turn and one line of the table below per turn. Every segment of text is encoded
on its own with a published byte-level vocabulary; control strings are single reserved ids beyond it, spliced
between the segments, so no content can yield one. The loss mask is the prefix sum of +1 where an assistant's text
begins and -1 where it ends. Control strings that occur in content are escaped, so that the
formatted text, too, can be read back without doubt: a backslash is doubled, and a control string gets
one after its first character.

    user       [INST] text [/INST]
    assistant  [ANS] text </s>
    system     [SYS] text [/SYS]
    any other  [ROLE] role [SAID] text [/ROLE]
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.llm.common import Scratch, table

VOCABULARY = "byte_bpe_50k.tiktoken"
FIRST_RESERVED = 50_300
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[SYS]", "[/SYS]", "[ROLE]", "[SAID]", "[/ROLE]")
IDS = {c: FIRST_RESERVED + i for i, c in enumerate(CONTROL)}
STRINGS = {i: c for c, i in IDS.items()}
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("[SYS]", "[/SYS]")}
ROLE_OF = {opens: role for role, (opens, _) in TURNS.items()}
ANY_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
ESCAPE = re.compile(r"\\(\\?)")
TRAINED_ROLE = "assistant"
PROBE_CONV, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return ANY_CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def encoder(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(enc: tiktoken.Encoding, role: str | None, text: str | None) -> tuple[list[int], list[int]]:
    """Ids and loss mask of one turn."""
    segments: list[tuple[list[int], int]] = []
    content = enc.encode_ordinary(escape(text or ""))
    if role in TURNS:
        opens, closes = TURNS[role]
        segments = [([IDS[opens]], 0), (content, int(role == TRAINED_ROLE)), ([IDS[closes]], 0)]
    else:
        named = enc.encode_ordinary(escape(role or ""))
        segments = [([IDS["[ROLE]"]], 0), (named, 0), ([IDS["[SAID]"]], 0), (content, 0), ([IDS["[/ROLE]"]], 0)]
    ids: list[int] = []
    step = [0] * (sum(len(s) for s, _ in segments) + 1)
    for own, loss in segments:
        step[len(ids)] += loss
        ids += own
        step[len(ids)] -= loss
    mask, level = [], 0
    for s in step[:-1]:
        level += s
        mask.append(level)
    return ids, mask


def disassemble(enc: tiktoken.Encoding, ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, characters of the formatted turn), from the tokens alone."""
    role, fields, chars, last = "", [[]], 0, None
    for i in ids:
        if i in STRINGS:
            chars += len(STRINGS[i])
            last = STRINGS[i]
            if last in ROLE_OF:
                role = ROLE_OF[last]
            fields.append([])
        else:
            fields[-1].append(i)
    plain = [enc.decode_bytes(f).decode("utf-8") for f in fields]
    chars += sum(map(len, plain))
    kept = [unescape(p) for p in plain]
    text = kept[-2] if len(kept) > 1 else ""
    if last == "[/ROLE]":
        role = kept[1]
    under = unescape(enc.decode_bytes([i for i, m in zip(ids, mask, strict=True) if m]).decode("utf-8"))
    return role, text, under, chars


_encoders: dict[bytes, tiktoken.Encoding] = {}


def _encoder(shared) -> tiktoken.Encoding:
    data = shared.value
    key = hashlib.sha256(data).digest()
    if key not in _encoders:
        _encoders[key] = encoder(data)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def format_turns(spark: SparkSession, conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, turn, ids, mask), one row per turn: a conversation's tokens are ``<s>`` and then its rows' ids by turn.

    Rows, not conversations, are the unit, so a conversation of any length is never gathered. Null texts and roles
    count as empty; further columns are not read; repeated rows are turns of their own.
    """
    shared = _vocabulary(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            made = [assemble(enc, r.as_py(), t.as_py()) for r, t in zip(batch.column("role"), batch.column("text"), strict=True)]
            columns = [batch.column("conv_id"), batch.column("turn"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "ids", "mask"])

    narrow = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return narrow.mapInArrow(run, "conv_id long, turn long, ids array<int>, mask array<byte>")


def read_back(spark: SparkSession, formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per conversation what its tokens say: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Turns are decoded where they lie; then each conversation's rows pass by in order of turn (ties by role and
    text, null turns first) while running digests are kept, so memory does not depend on a conversation's length.
    """
    shared = _vocabulary(spark, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            read = [disassemble(enc, i.as_py(), m.as_py()) for i, m in zip(batch.column("ids"), batch.column("mask"), strict=True)]
            columns = [batch.column("conv_id"), batch.column("turn")]
            columns += [pa.array([r[k] for r in read], pa.string() if k < 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "under", "chars"])

    turns = formatted.mapInArrow(decode, "conv_id long, turn long, role string, text string, under string, chars long")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, done = None, []

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

        def closed() -> tuple:
            return (now["conv"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"])

        for batch in batches:
            for conv, role, text, under, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "under", "chars")), strict=True):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        done.append(closed())
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": len(CONTROL[0])}
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
                now["loss"].update(under.encode())
                now["chars"] += len(under)
                now["formatted"] += chars
            if done:
                yield emit(done)
                done = []
        if now is not None:
            yield emit([closed()])

    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_token_level_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.sql(
        f"select * from values ({PROBE_CONV}L, 0L, 'user', '{PROBE_TEXT}'), ({PROBE_CONV}L, 1L, 'assistant', '{PROBE_TEXT}') as t(conv_id, turn, role, text)"
    )
    scratch = Scratch(spark, "chat")
    formatted = scratch.table(format_turns(spark, conversations.unionAll(probe)), "formatted")
    return read_back(spark, formatted)


def _count(controls: tuple[str, ...]) -> str:
    return " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in controls)


ORACLE = f"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select {PROBE_CONV}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_CONV}, 1, 'assistant', '{PROBE_TEXT}'
), t as (
    select *, length(text) + length(text) - length(replace(text, chr(92), '')) + {_count(CONTROL)}
        + case role when 'user' then {sum(map(len, TURNS["user"]))} when 'assistant' then {sum(map(len, TURNS["assistant"]))}
                    when 'system' then {sum(map(len, TURNS["system"]))} else {len("[ROLE][SAID][/ROLE]")} + length(role) end as chars
    from c
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256,
       ({len(CONTROL[0])} + sum(chars))::bigint as formatted_chars
from t group by conv_id
"""
