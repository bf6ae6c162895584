"""Tab-separated vector files and column-pruned Parquet reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.distance import parse_vector
from tessera.functions.scalars import vector_text


def read_vector_tsv(
    spark: SparkSession, paths: str | Sequence[str], schema: str = "user_id int, id int",
    vec: str = "embedding",
) -> DataFrame:
    """Rows of ``schema`` plus ``[v1,v2,...]`` text as a float array; gzip is read as is.

    Short lines and lines whose fields do not parse are skipped.
    """
    raw = (
        spark.read.schema(f"{schema}, {vec} string")
        .options(sep="\t", quote="", mode="PERMISSIVE").csv(paths)
    )
    parsed = raw.withColumn(vec, parse_vector(vec).cast("array<float>"))
    return parsed.na.drop("any")


def write_vector_tsv(
    df: DataFrame, path: str, rows_per_file: int = 1_000_000, key: str = "user_id",
    vec: str = "embedding", digits: int = 6,
) -> None:
    """Gzip shards of at most ``rows_per_file`` rows, split by ranges of the key.

    The range split includes a hash of the row, so one large key still becomes many shards.
    """
    text = df.withColumn(vec, vector_text(vec, digits))
    spread = text.repartitionByRange(F.col(key), F.xxhash64(vec))
    (
        spread.write.mode("errorifexists").options(sep="\t", quote="", compression="gzip")
        .option("maxRecordsPerFile", rows_per_file).csv(path)
    )


def read_vector_column(spark: SparkSession, paths: str | Sequence[str], vec: str) -> DataFrame:
    """One column of one or many Parquet files; the scan reads nothing else."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(vec)


def merge_shards(spark: SparkSession, paths: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Concatenate shards that name the same column differently: ``{path: column}`` -> ``emb``."""
    out = None
    for p in paths:
        part = spark.read.parquet(p).select(F.col(columns[p]).alias("emb"))
        out = part if out is None else out.unionByName(part)
    return out
