"""Helpers that keep plans bounded: size-checked collection, salted top-k, checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoints

# At most this many numbers are ever shipped to every executor (64 MB as doubles).
BROADCAST_VALUES = 8_000_000
# Rows fetched when probing whether a side is small.
BROADCAST_ROWS = 50_000


def bounded_rows(df: DataFrame, max_rows: int | None = None) -> list[Row] | None:
    """All rows of ``df`` when there are at most ``max_rows`` (BROADCAST_ROWS) of them, else None.

    Never moves more than ``max_rows + 1`` rows to the driver.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded_vectors(
    df: DataFrame, id_col: str, vec_col: str, max_values: int | None = None
) -> list[Row] | None:
    """(id, vector) rows when their numbers fit the broadcast bound, else None."""
    head = df.where(F.size(vec_col) > 0).select(F.size(vec_col).alias("n")).head()
    dim = int(head["n"]) if head else 1
    max_values = BROADCAST_VALUES if max_values is None else max_values
    rows = bounded_rows(df.select(id_col, vec_col), min(BROADCAST_ROWS, max_values // dim))
    if rows is not None and sum(len(r[vec_col] or ()) for r in rows) > max_values:
        return None  # other rows are longer than the first
    return rows


def of_dimension(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """The rows whose vector has ``dim`` numbers; NULL and other lengths are no candidates."""
    return df.where(F.size(F.col(vec)) == dim) if dim else df.where(F.col(vec).isNotNull())


def local_table(df: DataFrame) -> DataFrame:
    """A result known to be small as a local table, so that later uses run no job for it."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, whose texts and arrays hold at most
    BROADCAST_VALUES numbers or eight times as many bytes (reads no more rows than that)."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    wide = F.lit(0)
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.ArrayType):
            wide = wide + F.coalesce(F.greatest(F.size(c), F.lit(0)) * 8, F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            wide = wide + F.coalesce(F.octet_length(c), F.lit(0))
    got = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("b")).head()
    return got["n"] <= max_rows and (got["b"] or 0) <= 8 * BROADCAST_VALUES


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its rows and bytes are proven small."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def rank_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    ``row_number <= k`` lets Spark drop rows above k in each map task before the shuffle
    (WindowGroupLimit), so a hot group sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rank_per_group_salted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: str,
    buckets: int = 64,
    rank: str = "rank",
) -> DataFrame:
    """``rank_per_group`` in two levels for groups that may hold most of the table.

    The first level ranks inside ``(keys, hash bucket)`` so one hot group spreads over many
    tasks; the second sees at most ``buckets * k`` rows per group. Same result, no cap.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(buckets)))
    first = rank_per_group(salted, [*keys, "_salt"], order, k, "_r").drop("_r", "_salt")
    return rank_per_group(first, keys, order, k, rank)


# Rows of one key that a task may sort in one go.
RANK_ROWS = 1_000_000


def rank_task_results(
    found: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_on: str
) -> DataFrame:
    """``rank_per_group`` of what a scan of ``source`` found, at most ``k`` rows per key and task.

    The planner's size of the source gives the number of tasks, hence the rows of a key that meet in
    one task. Beyond RANK_ROWS of them the ranking takes two salted steps; the result is the same.
    """
    spark = source.sparkSession
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = size // split + spark.sparkContext.defaultParallelism
    if tasks * k <= RANK_ROWS:
        return rank_per_group(found, keys, order, k)
    return rank_per_group_salted(found, keys, order, k, salt_on)


# A table below this many bytes per core is cheap to redistribute.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for heavy row work on a small table, whose file may be a single split.

    The size is the planner's estimate and costs no job. Larger tables have splits enough and are
    returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size > cores * SPREAD_BYTES else df.repartition(cores, key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _range_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows spread by sorted order of ``cols`` with the number of their range in ``_part``.

    Materialized in the shared folder, so every later step sees the same ranges even when
    executors are lost. A hot key covers several ranges.
    """
    return cut_lineage(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))


def _match(left: str, right: str, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _offsets(parts: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """Rows of the same key in lower ranges: ``(by, _part, _before)``."""
    per = parts.groupBy(*by, "_part").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, "_part", F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_before"))


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rn",
    small: int = 100_000,
) -> DataFrame:
    """1-based position of every row inside its key, without one task per key.

    A table proven small is numbered by a plain window. Otherwise rows are range-partitioned by
    (key, order), numbered inside each range and shifted by the counts of the ranges before.
    ``order`` must be a total order inside a key.
    """
    if is_small(df, small):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    parts = _range_parts(df, [*by, *order])
    shift = _offsets(parts, by, F.lit(1))
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    numbered = parts.withColumn("_rn", local)
    joined = numbered.alias("l").join(shift.alias("r"), _match("l", "r", [*by, "_part"]))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._rn") + F.col("r._before")).cast("long").alias(out),
    )


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], small: int = 100_000
) -> DataFrame:
    """Exact percentiles ``(by, p, value)``, linear between neighbours; p in 0..1.

    Tables proven small use the built-in aggregate, which keeps every distinct value of a group
    in one task. Larger ones count equal values first, range-partition the rest and pick the rows
    that cover the wanted ranks.
    """
    ps = [float(p) for p in ps]
    df = df.select(*by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    if is_small(df, small):
        agg = df.groupBy(*by).agg(F.percentile(value, F.lit(ps)).alias("_v"))
        z = F.explode(F.arrays_zip(F.lit(ps).alias("p"), F.col("_v").alias("v"))).alias("z")
        return agg.select(*by, z).select(*by, F.col("z.p").alias("p"), F.col("z.v").alias(value))
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    parts = _range_parts(counted, [*by, value])
    shift = _offsets(parts, by, F.col("_c"))
    w = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = parts.withColumn("_cum", F.sum("_c").over(w))
    totals = broadcast_if_small(parts.groupBy(*by).agg(F.sum("_c").alias("_n")))
    placed = (
        cum.alias("l").join(shift.alias("r"), _match("l", "r", [*by, "_part"]))
        .select(*[F.col(f"l.{c}").alias(c) for c in [*by, value, "_c"]],
                (F.col("l._cum") + F.col("r._before")).alias("_hi"))
        .alias("l").join(totals.alias("t"), _match("l", "t", by))
        .select(*[F.col(f"l.{c}").alias(c) for c in [*by, value]],
                (F.col("l._hi") - F.col("l._c")).alias("_lo"), F.col("l._hi").alias("_hi"),
                F.explode(F.lit(ps)).alias("p"), F.col("t._n").alias("_n"))
    )
    rank = (F.col("_n") - 1) * F.col("p")
    low, high = F.floor(rank), F.ceil(rank)
    covers = lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))
    hit = placed.where(covers(low) | covers(high))
    v_low = F.max(F.when(covers(low), F.col(value)))
    v_high = F.max(F.when(covers(high), F.col(value)))
    frac = F.max(rank - low)
    return hit.groupBy(*by, "p").agg((v_low + (v_high - v_low) * frac).alias(value))
