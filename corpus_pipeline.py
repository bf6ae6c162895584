"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents go, then those whose language is rejected, then exact copies, then near copies; what is
left is packed into length buckets. All stages but the last return the columns of documents.

A row is kept or dropped as a whole: extra columns, whatever their names, stay as they are. Texts of any
length are read whole. An empty table passes every stage as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, packing, simhash, token_output, toxicity
from tessera.llm.queries import vocabulary_path
from tessera.llm.rows import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones, scores below 0.5.

    NULL and empty texts have no feature and stay, unless most labels are toxic. A NULL id has no label. Equal
    rows share their fate.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language of the stage's own input.

    NULL, empty and letterless texts go. Rows with a NULL id or language are judged like others; one with a
    NULL language teaches nothing. Equal rows share their fate.
    """
    return language_id.drop_unknown(docs, language_id.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    NULL equals the empty text. A NULL id is the smallest; of equal ids the last by file and row stays, so one
    row of every text stays.
    """
    return exact_dedup.keep_newest(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id.

    Texts without words, NULL among them, are near copies of each other. NULL ids come last; of equal ids the
    first by file and row stays.
    """
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left; lengths and the budget are in tokens.

    NULL and empty texts have length 0; one beyond the budget is a batch of its own. Rows with a NULL id and
    equal rows are packed each; in a batch ties of length follow id, file and row.
    """
    count = token_output.token_counts(spark, vocabulary_path("tiktoken"))
    return packing.pack(docs, count(F.col("text")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("language_id", known_language),
    ("exact_dedup", distinct),
    ("simhash", unlike),
    ("packing", packed),
]

# Fitted models and fingerprints are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
