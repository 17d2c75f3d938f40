"""The corpus pipeline: from documents to packed training sequences.

Every stage but the last returns the columns of documents, as they are but for
the text that the secret stage masks and the n_chars that follows it.

Defined results: a null text is empty text to every stage and stays null; a null
doc_id is a document like any other, the last of its group of near copies;
repeated rows are copies of each other, of which one stays; rows that share an
id but not a text are documents of their own; ties in a group go to the least
id, then to the least hash of the text; texts of any length are read whole;
further columns are kept, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontam, packing, quality, secrets, simhash
from cairn.llm.store import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to a mark; n_chars follows the text."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length(F.coalesce("text", F.lit(""))).cast("long"))) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
