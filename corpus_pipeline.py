"""A corpus-cleaning pipeline of the corpus operators; each stage's result is written and reread before the next.

All stages but the last keep the columns of their input, whatever their names, and whole rows. Rows with null ids are rows like others;
null texts and texts without words are neither toxic nor copies nor contaminated, and get the quality score of an empty passage. Texts of any
length are read whole. Of equal rows the first two stages and decontamination keep all or none, near_duplicates one (all, if they
have no words). An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelflow.llm import bpe, decontaminate, neardup, quality, toxicity
from voxelflow.llm.common import Scratch, release_memory, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic (score below the threshold). A text without words is not."""
    return docs.where(toxicity.score_column(spark, docs, table(spark, sf_dir, "labels")) < toxicity.THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return docs.where(quality.score_column(spark, docs, table(spark, sf_dir, "labels")) >= quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: of the smallest doc_id (null last), then of the smallest hash of its text."""
    return neardup.deduplicate(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its error budget."""
    release_memory(spark)
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left, its null text counted as empty."""
    release_memory(spark)
    return bpe.encode_documents(spark, docs, emit="digests", keep_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table of documents, one after the other; the last one's rows. A stage's input is deleted when it is done."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
