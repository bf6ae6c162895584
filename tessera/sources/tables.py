"""Table forms: bucketed, latest row per key, repeated vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def save_bucketed(
    df: DataFrame, table: str, buckets: int, keys: Sequence[str], sort: Sequence[str], path: str
) -> DataFrame:
    """Write a hash-distributed, sorted table and return it.

    Joins and groups on the bucket keys need no shuffle, a filter on them reads one bucket. A
    bucket that a hot key makes much larger than the mean is written by several tasks.
    """
    placed = df.withColumn("_b", F.pmod(F.hash(*keys), F.lit(buckets)))
    sizes = {r["_b"]: r["n"] for r in placed.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # one per bucket
    mean = max(sum(sizes.values()) // buckets, 1)
    ways = [max(-(-sizes.get(b, 0) // (4 * mean)), 1) for b in range(buckets)]
    split = placed.withColumn("_s", F.pmod(F.xxhash64(*sort), F.get(F.array(*map(F.lit, ways)), F.col("_b"))))
    (
        split.repartition("_b", "_s").drop("_b", "_s").write.mode("overwrite")
        .bucketBy(buckets, *keys).sortBy(*sort).option("path", path).saveAsTable(table)
    )
    return df.sparkSession.table(table)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last write wins: the row with the greatest ``order`` per key.

    An aggregate, not a window: map tasks keep one row per key, so a hot key costs little.
    """
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def repeat_vector(df: DataFrame, id_col: str, vec: str, targets: Sequence[str]) -> DataFrame:
    """Copy one vector column into several target columns, the id cast to int."""
    return df.select(F.col(id_col).cast("int").alias("id"), *[F.col(vec).alias(t) for t in targets])
