"""The corpus pipeline: language, near copies, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``, unchanged but for what the stage decides.

Defined results, for every stage: an empty table gives an empty one; other columns pass through unread,
whatever their names (the last stage ignores them); very long texts are read whole; nulls in any column are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import decontaminate, language_id, neardup, packing, pii
from basalt.llm.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected.

    Null and empty texts and texts without a letter have no language and go; so do noise and languages that
    nobody labelled; equal rows are judged alike. Without labelled rows all texts with a letter stay.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of five-word shingle sets that are alike to 0.8 or more.

    The smallest ``doc_id`` of a class stays, once where its row repeats; documents without words are alike to
    nothing and rows without an id all stay.
    """
    return neardup.drop_near_duplicates(docs, percent=80)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out benchmark passages; drop documents that are mostly such.

    Null and empty texts hold no passage; ``n_chars`` follows the text; an empty benchmark changes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates for personal data and secrets.

    Null texts stay null; equal entities have equal surrogates in all rows; ``n_chars`` follows the text.
    """
    return pii.replace_entities(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents' token pieces, with their ids, in training sequences.

    A null or empty text is its end id; repeated rows are packed as often as they stand there.
    """
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark_passages),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
