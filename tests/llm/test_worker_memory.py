import pandas as pd

import corpus_pipeline
from voxelflow.llm import bpe


def test_the_pipeline_leaves_no_words_in_workers(spark):
    def held(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [sum(len(c.known) + len(c.older) for c in bpe._codecs.values())]})

    docs = spark.createDataFrame([(n, f"word{n} and {n} more of them") for n in range(40)], "doc_id long, text string").repartition(4)
    assert corpus_pipeline.encode(spark, docs, "").agg({"n_tokens": "sum"}).first()[0] > 0
    assert spark.range(0, 8, 1, 8).mapInPandas(held, "n long").agg({"n": "sum"}).first()[0] == 0
