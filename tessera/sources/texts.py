"""Text files as lines or as whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, text)``: one row per file."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def to_lines(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``(file, line_no, line)`` with line numbers from 1."""
    lines = texts.select(file, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    return lines.select(F.col(file).alias("file"), (F.col("n") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return to_lines(read_texts(spark, paths))
