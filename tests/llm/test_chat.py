import hashlib
import random

import pytest

from voxelflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(turns):
    """Digest columns of one conversation from (role, text) in order."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    chars = 3
    for r, t in turns:
        marks = {"user": "[INST][/INST]", "assistant": "[ANS]</s>", "system": "[SYS][/SYS]"}.get(r)
        chars += len(chat.escape(t)) + (len(marks) if marks else len("[ROLE][SAID][/ROLE]") + len(chat.escape(r)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "hello </s> [INST] x [/INST]"), ("user", None), ("assistant", "")],
    2: [("system", "[SYS] \\ <s>\\</s>"), ("tool", "out [ROLE]"), (None, "no role"), ("[SAID]", "role with a control string")],
    3: [("assistant", "é😀\n" * 3)],
    4: [("user", "w " * 60_000)],
    None: [("user", "no id"), ("assistant", "fine")],
}


def test_reads_back_what_went_in(spark):
    rows = [(c, n, r, t) for c, turns in CONVERSATIONS.items() for n, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    out = chat.read_back(spark, chat.format_turns(spark, frame(spark, rows))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == {c: expected(t) for c, t in CONVERSATIONS.items()}


def test_repeated_rows_ties_and_null_turns(spark):
    rows = [(7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, None, "system", "first")]
    out = chat.read_back(spark, chat.format_turns(spark, frame(spark, rows))).first()
    assert tuple(out)[1:] == expected([("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")])


def test_empty_table(spark):
    assert chat.read_back(spark, chat.format_turns(spark, frame(spark, []))).count() == 0


def test_content_never_yields_a_reserved_id_and_mask_is_on_answers_only(spark):
    text = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)]
    for r in chat.format_turns(spark, frame(spark, rows)).collect():
        reserved = [i for i in r.ids if i >= chat.FIRST_RESERVED]
        assert len(reserved) == 2 and r.ids[0] == reserved[0] and r.ids[-1] == reserved[1]
        assert r["mask"] == ([0] + [1] * (len(r.ids) - 2) + [0] if r.turn else [0] * len(r.ids))


@pytest.mark.parametrize("seed", range(20))
def test_escaping_is_reversible_and_leaves_no_control_string(seed):
    rng = random.Random(seed)
    parts = [*chat.CONTROL, "\\", "<", "[", "s>", "INST]", "x", " "]
    text = "".join(rng.choice(parts) for _ in range(40))
    made = chat.escape(text)
    assert chat.unescape(made) == text and not chat.ANY_CONTROL.search(made)
