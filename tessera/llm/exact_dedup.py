"""Exact duplicates by a stateful stream over the arrivals of a corpus.

A first pass writes one narrow arrival per row: id, SHA-256 of the text and the place of the row
(its content locator). A stream over the arrivals keeps one entry per digest in a RocksDB state store
on the executors' disks, without expiry and with checkpoints in the shared folder: the largest id seen,
its locator and the number of arrivals. Where a digest was hit again, the full texts are compared, so
equal digests of different texts are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import named, whole_text
from tessera.llm.rows import FILE, ROW, located, only, without, written
from tessera.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Arrivals of one micro-batch; state is the only thing that grows with the corpus.
BATCH_BYTES = 1 << 30


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def run_stream(spark: SparkSession, arrivals: str, checkpoint: str, schema, batch_bytes: int = BATCH_BYTES) -> None:
    """Take all arrivals below ``arrivals`` that the checkpoint has not seen into its state.

    Run again after new arrivals, it goes on from the kept state. A lost executor's state is
    restored from the checkpoint.
    """
    own = spark.newSession()  # its settings don't touch the caller's
    for k, v in (
        ("spark.sql.streaming.stateStore.providerClass", ROCKSDB),
        ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
        ("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"),  # else 4 MB per store at least
        ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")),
    ):
        own.conf.set(k, v)
    seen = own.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(arrivals)
    state = seen.groupBy("digest").agg(
        F.max(F.struct("doc_id", FILE, ROW)).alias("newest"), F.count(F.lit(1)).alias("n")
    )
    done = (
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, newest, n) as the state store holds them."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", "value.*").toDF("digest", "newest", "n")


def _resolved(
    rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], batch_bytes: int
) -> DataFrame:
    """(doc_id, place, digest, newest, n): for every located row the one of its class that stays."""
    spark = rows.sparkSession
    texts = rows.select(
        named(rows, id_col).alias("doc_id"), whole_text(named(rows, text_col)).alias("text"), FILE, ROW
    ).withColumn("digest", digest(F.col("text")))
    folder = work_path(spark, "arrivals")
    arrivals = texts.select("doc_id", "digest", FILE, ROW)
    arrivals.write.parquet(folder)
    seen = spark.read.schema(arrivals.schema).parquet(folder)
    checkpoint = work_path(spark, "dedup-state")
    run_stream(spark, folder, checkpoint, arrivals.schema, batch_bytes)
    state = read_state(spark, checkpoint)
    hits = written(state.where("n > 1"), "hits")

    # Full bytes on hits. Copies collapse before the shuffle: one row per task and different text.
    again = only(texts, seen.join(hits, "digest", "left_semi"))
    variants = again.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("k"))
    collided = written(variants.where("k > 1").select("digest").join(hits, "digest", "left_semi"), "collided")
    classes = seen.join(hits, "digest", "left")
    if collided.isEmpty():
        return classes
    # Digests with several texts: the classes are told apart by the texts themselves.
    mixed = texts.join(collided, "digest", "left_semi")
    by_text = mixed.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", FILE, ROW)).alias("newest"), F.count(F.lit(1)).alias("n")
    )
    told = mixed.join(by_text, ["digest", "text"]).select("doc_id", "digest", FILE, ROW, "newest", "n")
    return classes.join(collided, "digest", "left_anti").select(told.columns).unionByName(told)


def duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of ``docs``, dropped ones too.

    Texts are equal when all their bytes are; NULL counts as empty. The largest id of a class
    stays, NULL being the smallest; of equal ids the last by file and row, so that exactly one row of
    every class is ``kept``. A text of any length is hashed and compared whole. Other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    found = _resolved(located(docs), id_col, text_col, digest, batch_bytes)
    return found.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("newest")["doc_id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), _stays().alias("kept"), "digest",
    )


def _stays() -> Column:
    newest = F.col("newest")
    return newest.isNull() | ((F.col(FILE) == newest[FILE]) & (F.col(ROW) == newest[ROW]))


def keep_newest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without the rows that ``duplicates`` does not keep, all columns as they are."""
    rows = located(docs)
    losers = written(_resolved(rows, id_col, text_col, sha256, batch_bytes).where(~_stays()).select(FILE, ROW), "copies")
    return without(rows, losers)
