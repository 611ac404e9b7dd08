import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from voxelflow.llm import bpe, decontaminate, quality, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    for i in range(200):
        words = [word() for _ in range(60)]
        toxic, good = i % 10 == 1, i % 10 != 2
        if toxic:
            words[5] = words[50] = "vilename"
        text = " ".join(words)
        docs.append((i, text if good else text.upper() + " !!" * 30, "en", "src", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(300 + i, docs[10 * i][1], "en", "src", 1) for i in range(5)]  # exact copies
    docs += [(400 + i, docs[10 * i][1] + " tail", "en", "src", 1) for i in range(5)]  # near copies
    docs += [(500 + i, " ".join(word() for _ in range(40)) + " " + items[i][1], "en", "src", 1) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages_do_their_work(spark, folder):
    path, docs = folder
    out = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in out}
    assert len(ids) == len(out)
    assert not ids & {i for i in range(200) if i % 10 in (1, 2)}
    assert not ids & {*range(300, 305), *range(400, 405), *range(500, 503)}
    assert len(ids) > 0.95 * 160
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    text = {d[0]: d[1] for d in docs}
    for r in out[:20]:
        own = library.encode_ordinary(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()


def test_each_stage_keeps_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "encoding"]


def test_stages_take_empty_tables_and_odd_rows(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "", 0), (1, "", None, "", 0), (2, None, "en", "s", 1)], docs.schema)
    for table in (docs.where("false"), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, path).count() <= table.count()


def test_registered_names():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert (quality.THRESHOLD, toxicity.THRESHOLD, decontaminate.ERROR_RATE) == (0.3, 0.5, 0.10)
