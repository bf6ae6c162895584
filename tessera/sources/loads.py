"""Batch loads that can be repeated: labels, chunks, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 500_000  # fixed value: ids per chunk


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_labelled(df: DataFrame, table_path: str, label: str) -> bool:
    """Append under a label; a label that already loaded is skipped. True when it wrote.

    The batch is its own partition folder, so a half-written one is replaced on the next try.
    """
    target = f"{table_path}/label={label}"
    if path_exists(df.sparkSession, f"{target}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(target)
    return True


def chunk_status(src: DataFrame, dst: DataFrame, chunk: int = CHUNK, id_col: str = "id") -> DataFrame:
    """``(chunk, src_rows, dst_rows, complete)`` per range of ids."""
    no = F.expr(f"{id_col} div {int(chunk)}").alias("chunk")
    s = src.groupBy(no).agg(F.count("*").alias("src_rows"))
    d = dst.groupBy(no).agg(F.count("*").alias("dst_rows"))
    out = s.join(d, "chunk", "left").na.fill(0, ["dst_rows"])
    return out.withColumn("complete", F.col("src_rows") == F.col("dst_rows"))


def load_missing_chunks(src: DataFrame, dst: DataFrame, chunk: int = CHUNK, id_col: str = "id") -> DataFrame:
    """The finished target: complete chunks kept, the others taken anew from the source."""
    no = F.expr(f"{id_col} div {int(chunk)}")
    todo = chunk_status(src, dst, chunk, id_col).where("not complete").select("chunk")
    redo = src.withColumn("chunk", no).join(todo, "chunk", "left_semi")
    keep = dst.withColumn("chunk", no).join(todo, "chunk", "left_anti")
    return keep.unionByName(redo).drop("chunk")


def write_missing_chunks(src: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "id") -> int:
    """Resume a load into a folder with one partition per chunk; returns the chunks written."""
    spark = src.sparkSession
    numbered = src.withColumn("chunk", F.expr(f"{id_col} div {int(chunk)}"))
    if path_exists(spark, path):
        dst = spark.read.schema(numbered.schema).parquet(path)
        todo = chunk_status(src, dst, chunk, id_col).where("not complete").select("chunk")
        n = todo.count()
        numbered = numbered.join(todo, "chunk", "left_semi")
    else:
        n = numbered.select("chunk").distinct().count()
    if n:
        (
            numbered.repartitionByRange("chunk", id_col).write.mode("overwrite").partitionBy("chunk")
            .option("partitionOverwriteMode", "dynamic").parquet(path)
        )
    return n


def load_gate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(name, expected, actual, skip)``: skip a load whose target already has its rows."""
    both = expected.join(actual, "name", "left").na.fill(0, ["actual"])
    return both.select("name", "expected", "actual", (F.col("expected") == F.col("actual")).alias("skip"))
