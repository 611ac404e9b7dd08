import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from voxelflow.llm import bpe

TEXTS = [
    "", " ", "\n", "  lead", "trail  ", "a  b", "x\n\n y ", "tab\t x", "it's 'll 's", "naïve café 日本語 テキスト", "<|endoftext|> hi", "a\0b c",
    " nbsp  em", "é" * 300, "z" * 700, "🙂🙂 emoji", "q\x1c r", "Word " * 5000, "1234567 12,345.67", "don't can't we've I'm",
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_are_the_librarys(spark, library):
    rng = random.Random(2)
    noise = ["".join(rng.choice(" \n\tabcéß'!1😀") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS + noise)] + [(None, None, "x", 1), (3, "again", None, 2), (3, "again", None, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = sorted(tuple(r) for r in bpe.encode_documents(spark, frame, emit="digests", chunk_chars=500).fillna(-1).collect())
    assert out == sorted((-1 if i is None else i, *expected(library, t)) for i, t, *_ in rows)


def test_ids_and_round_trip(spark, library):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in bpe.encode_documents(spark, frame).collect():
        assert r.ids == library.encode_ordinary(TEXTS[r.doc_id]) and r.decoded == TEXTS[r.doc_id] and r.n_tokens == len(r.ids)


def test_another_vocabulary_and_an_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    frame = spark.createDataFrame([(1, "Grüße an alle")], "doc_id long, text string")
    assert bpe.encode_documents(spark, frame, path).first().decoded == "Grüße an alle"
    assert bpe.encode_documents(spark, frame.where("false"), emit="digests").count() == 0


def test_known_words_are_forgotten_in_generations(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        codec = bpe.Codec(bpe.parse_ranks(f.read()), public_tokenizers.PATTERN)
    for n in range(6):
        texts = [f"zorble{n * 40 + k} quux{k}" for k in range(40)]
        for t, (ids, count, raw) in zip(texts, codec.encode(texts), strict=True):
            assert " ".join(ids) == " ".join(map(str, library.encode_ordinary(t))) and b"".join(raw) == t.encode()
    assert len(codec.known) < 400


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        return bpe.Codec(bpe.parse_ranks(f.read()), public_tokenizers.PATTERN)


def ids_of(codec, text):
    (ids, n, raw), = codec.encode([text])
    found = [int(x) for x in " ".join(ids).split()]
    assert n == len(found) and b"".join(raw) == text.encode()
    return found


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "z", "etaoin", "éßa", "漢字仮名"])
def test_long_words_in_linear_time(codec, library, letters):
    rng = random.Random(len(letters))
    for n in (97, 1_000, 130_000):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert ids_of(codec, word) == library.encode_ordinary(word)


def test_seams_of_short_pieces(codec, library, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(bpe, "SEAM_TOKENS", 2)
    for size in (4, 7, 16):
        monkeypatch.setattr(bpe, "PIECE_BYTES", size)
        words = ["".join(rng.choice(rng.choice(["ab", "aaab", "theringsion", "0123456789", "!?"])) for _ in range(rng.randint(3, 90))) for _ in range(150)]
        for word, (ids, _, _) in zip(words, codec.encode(words), strict=True):
            assert " ".join(ids) == " ".join(map(str, library.encode_ordinary(word)))


def test_a_closed_codec_opens_again(codec, library):
    codec.close()
    assert codec.db is None and ids_of(codec, "reopened wuzzle") == library.encode_ordinary("reopened wuzzle")


def test_batches_are_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS_PER_QUERY", 100)
    text = " ".join(f"blimp{n}ery" for n in range(60))
    assert ids_of(codec, text) == library.encode_ordinary(text)
