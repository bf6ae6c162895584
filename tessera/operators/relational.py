"""Relational helpers the workloads share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import scale
from tessera.functions.distance import as_col

TASKS_PER_CORE = 4  # of a join whose pairs are many times its rows
BLOCK_ROWS = 256  # of a side of such a join that meet at a time


def split_by_string(text, sep: str) -> Column:
    r"""Split on a literal separator (quoted, so ``.`` or ``|`` are no patterns)."""
    return F.split(as_col(text), r"\Q" + sep + r"\E")


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Duplicate-preserving equi-join: build on the left when it is small, else by partition.

    Pairs may be many times the rows, so the right side is dealt out whatever its files or its keys: a few
    hot keys keep all cores busy. A large left side has a copy in each deal, and its rows of a key meet
    one deal of the right side at a time, block by block: a file then holds the few values of a block again
    and again, which takes a tenth of the bytes of long lists. Blocks keep all given columns, so give those
    that are needed.
    """
    deals = right.sparkSession.sparkContext.defaultParallelism
    tasks = TASKS_PER_CORE * deals
    if scale.is_small(left):
        return right.repartition(tasks).join(F.broadcast(left), F.col(left_key) == F.col(right_key))
    ones = _blocks(left, left_key, "_left", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))), tasks)
    dealt = _blocks(right, right_key, "_right", F.pmod(F.xxhash64(*right.columns), F.lit(deals)).cast("int"), tasks)
    # never broadcast: the planner does not know of the copies
    met = ones.join(dealt.hint("merge"), F.expr("_left_key = _right_key and _left_deal = _right_deal"))
    # a step with transform() is not compiled and gives a row at a time; compiled with the next, it would hold all pairs of two blocks
    opened = met.select("_right_rows", F.inline(F.transform("_left_rows", lambda row: row)))
    return opened.select("*", F.inline("_right_rows")).drop("_right_rows")


def _blocks(df: DataFrame, key: str, name: str, deal: Column, tasks: int) -> DataFrame:
    """Arrays of at most BLOCK_ROWS rows of a key and deal, without the rows whose key is NULL: they meet nothing."""
    k, d = f"{name}_key", f"{name}_deal"
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias(k), deal.alias(d), F.struct("*").alias("_row"))
    i = F.row_number().over(Window.partitionBy(k, d).orderBy(F.lit(0)))
    # a stated number of partitions is not coalesced by the size of their input
    placed = rows.repartition(tasks, k, d).withColumn("_block", F.floor((i - 1) / BLOCK_ROWS))
    return placed.groupBy(k, d, "_block").agg(F.collect_list("_row").alias(f"{name}_rows")).drop("_block")


def not_in(df: DataFrame, col: str, listed: DataFrame, listed_col: str) -> DataFrame:
    """SQL ``NOT IN``: rows whose value is in no listed row; empty when the list holds a NULL.

    One aggregation answers "is there a NULL, is there any row", so the join itself stays a plain
    hash anti join instead of a nested loop.
    """
    facts = listed.agg(
        F.coalesce(F.bool_or(F.col(listed_col).isNull()), F.lit(False)).alias("_has_null"),
        (F.count("*") > 0).alias("_any"),
    )  # one row
    keys = listed.select(F.col(listed_col).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    kept = df.join(keys, F.col(col) == F.col("_k"), "left_anti").join(F.broadcast(facts))
    ok = ~F.col("_has_null") & (~F.col("_any") | F.col(col).isNotNull())
    return kept.where(ok).select(*df.columns)


def key_extremes(df: DataFrame, key: str, value: str, cases: dict[str, Column]) -> DataFrame:
    """Lowest and highest value per key for each condition.

    "Some other row of my key has a different value" is "the extremes are not both mine", so an
    inequality self-join becomes one map-side-combined aggregation.
    """
    aggs = []
    for name, cond in cases.items():
        v = F.when(cond, F.col(value))
        aggs += [F.min(v).alias(f"{name}_lo"), F.max(v).alias(f"{name}_hi")]
    return df.groupBy(key).agg(*aggs)


def cross_dimensions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cartesian product, meant for dimension tables: its size is the product of both."""
    return left.crossJoin(scale.broadcast_if_small(right))


def limited_in_full(full: DataFrame, n: int) -> DataFrame:
    """Rows that a limit without an order returns, and those of them that the full result has."""
    some = full.limit(n).withColumn("_some", F.lit(1))
    both = some.join(full.withColumn("_full", F.lit(1)), full.columns, "left")
    return both.agg(F.count("_some").alias("returned"), F.count("_full").alias("in_full"))


def fixed_bins(df: DataFrame, by: str, order: str, value: str, size: int) -> DataFrame:
    """Mean and extremes over consecutive runs of ``size`` observations per series."""
    numbered = scale.row_numbers(df.select(by, order, value), [by], [order], "_i")
    binned = numbered.withColumn("bin", F.expr(f"(_i - 1) div {int(size)}"))
    return binned.groupBy(by, "bin").agg(
        F.min("_i").alias("first_i"), F.max("_i").alias("last_i"), F.avg(value).alias("mean"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    )


# ---------------------------------------------------------------- bitmaps


def bitmap_table(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, bucket, bm)``: one bitmap of 32,768 positions per key and bucket."""
    placed = df.select(
        key, F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("bit")
    )
    return placed.groupBy(key, "bucket").agg(F.bitmap_construct_agg("bit").alias("bm"))


def bitmap_merge(maps: DataFrame, key: str) -> DataFrame:
    """Union of all bitmaps of the same key and bucket."""
    return maps.groupBy(key, "bucket").agg(F.bitmap_or_agg("bm").alias("bm"))


def bitmap_union_count(maps: DataFrame, by: str | None = None, out: str = "n") -> DataFrame:
    """Distinct values in the union of bitmaps, merged bucket by bucket."""
    keys = [by] if by else []
    merged = maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bm").alias("bm"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bm")).alias(out))
