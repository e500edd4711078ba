"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing; each stage's table is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm.common import discard, fresh, quoted, scratch, table
from wordmill.llm.jaccard import deduplicate
from wordmill.llm.mixing import mixed_documents
from wordmill.llm.packing import pack_documents
from wordmill.llm.quality import train, with_scores
from wordmill.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more stay; the network learns from `labels` outside the held-out fold."""
    model = train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return with_scores(docs, model, docs.columns, score).where(F.col(score) >= 0.5).select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, also inside nested encodings, is replaced in the text."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix; sources below their weight come again."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their text and place in sequences of permitted lengths."""
    return pack_documents(docs, with_text=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The network and the worklist can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder and read again.

    A stage's table goes when the next one's is written; the last one's input stays until the program ends.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(f"pipeline-{name}")(stage)(spark, docs, sf_dir)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
