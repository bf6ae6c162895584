"""Duplicate checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def has_duplicates(df: DataFrame, col: str) -> DataFrame:
    """One row ``(col, dup)``: does the column hold any value twice (NULLs are not compared)?

    Values are counted by partial aggregation, so a hot value is one row per task; long text is
    compared through its 256-bit digest.
    """
    value = F.col(col)
    if df.schema[col].dataType.simpleString() in ("string", "binary"):
        value = F.sha2(value, 256)
    repeated = df.where(F.col(col).isNotNull()).groupBy(value.alias("v")).count().where("count > 1")
    found = repeated.agg((F.count("*") > 0).alias("dup"))
    return found.select(F.lit(col).alias("col"), "dup")


def even_bounds(df: DataFrame, pos: str, ranges: int, apart: float) -> list[float]:
    """Where ranges of about equal rows begin, at least ``apart`` from each other; none for one range.

    Quantiles are approximate by a bounded sketch, so a few far-out positions leave the ranges even.
    """
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(pos).cast("double"), shares, max(10_000, 20 * ranges)).alias("b")).head()["b"]
    out: list[float] = []
    for b in found or []:
        if not out or b >= out[-1] + apart:
            out.append(float(b))
    return out


def duplicates_within(
    df: DataFrame, col: str, pos: str, k: int, rows_per_range: int = 1_000_000
) -> DataFrame:
    """Pairs of equal values in neighbouring occurrences at most k positions apart.

    Positions are cut into ranges of about equal rows, wider than k; each range also receives the rows
    of its last k positions before it, so one hot value spreads over many tasks, no pair is lost, and no
    row goes to more than two ranges.
    """
    rows = df.where(F.col(col).isNotNull() & F.col(pos).isNotNull())
    bounds = even_bounds(rows, pos, rows.count() // rows_per_range + 1, max(k, 1))
    sent = df.sparkSession.sparkContext.broadcast(np.array(bounds))

    def number(p: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sent.value, p.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    home = F.arrow_udf(number, "int")
    p = F.col(pos).cast("double")
    if bounds:
        rows = rows.select(col, F.col(pos).alias("second_pos"), home(p).alias("_own"), home(p + k).alias("_last"))
    else:
        rows = rows.select(col, F.col(pos).alias("second_pos"), F.lit(0).alias("_own"), F.lit(0).alias("_last"))
    rows = rows.select("*", F.explode(F.sequence("_own", "_last")).alias("_r")).drop("_last")
    w = Window.partitionBy(col, "_r").orderBy("second_pos")
    prev = rows.withColumn("first_pos", F.lag("second_pos").over(w))
    near = F.col("second_pos") - F.col("first_pos") <= k
    return prev.where((F.col("_r") == F.col("_own")) & near).select(col, "first_pos", "second_pos")
