"""Per-dimension statistics of a vector column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels

# distinct groups one task holds before it emits what it has
GROUPS_PER_FLUSH = 4096


def dimension(vectors: DataFrame, vec: str = "embedding") -> int:
    """Length of the longest vector; 0 without vectors."""
    head = vectors.agg(F.max(F.size(vec)).alias("n")).head()
    return max(int(head["n"] or 0), 0)


def dim_stats(vectors: DataFrame, by: str | None = None, vec: str = "embedding") -> DataFrame:
    """``(by, pos, n, total, lo, hi)`` per dimension and optional group; shorter vectors are left out.

    Each task folds its batches with numpy and emits one row per group it met; only those
    partial rows are exploded and shuffled, so a hot group costs one row per task.
    """
    key = F.lit(0).alias("key") if by is None else F.col(by).alias("key")
    src = vectors.where(F.size(vec) == dimension(vectors, vec)).select(key, F.col(vec).alias("v"))
    ktype = src.schema["key"].dataType

    def fold(batches):
        acc: dict = {}

        def emit():
            names = list(acc)
            cols = [pa.array(names, type=arrow_type)]
            cols.append(pa.array([acc[n][0] for n in names]))
            cols += [pa.array([acc[n][i].tolist() for n in names], pa.list_(pa.float64()))
                     for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays(cols, ["key", "n", "total", "lo", "hi"])

        arrow_type = None
        for b in batches:
            if not b.num_rows:
                continue
            arrow_type = b.column(0).type
            x = kernels.matrix(b.column(1))
            codes = b.column(0).dictionary_encode()
            names = codes.dictionary.to_pylist()
            for c, rows in kernels.grouped_rows(codes.indices.to_numpy(zero_copy_only=False)):
                part, name = x[rows], names[int(c)]
                n, s, lo, hi = len(part), part.sum(0), part.min(0), part.max(0)
                if name in acc:
                    p = acc[name]
                    n, s = n + p[0], s + p[1]
                    lo, hi = np.minimum(lo, p[2]), np.maximum(hi, p[3])
                acc[name] = (n, s, lo, hi)
            if len(acc) >= GROUPS_PER_FLUSH:
                yield emit()
                acc.clear()
        if acc:
            yield emit()

    arr = "array<double>"
    parts = src.mapInArrow(
        fold, f"key {ktype.simpleString()}, n long, total {arr}, lo {arr}, hi {arr}"
    )
    flat = parts.select(
        "key", "n", F.posexplode(F.arrays_zip("total", "lo", "hi")).alias("pos", "s")
    )
    out = flat.groupBy("key", "pos").agg(
        F.sum("n").alias("n"), F.sum("s.total").alias("total"),
        F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"),
    )
    return out.drop("key") if by is None else out.withColumnRenamed("key", by)


def pack(rows: DataFrame, value: str, by: str | None, out: str) -> DataFrame:
    """Collect ``(by, pos, value)`` rows into one array per group, in position order."""
    items = F.array_sort(F.collect_list(F.struct("pos", value)))
    arr = F.transform(items, lambda s: s[value]).alias(out)
    return rows.groupBy(*([by] if by else [])).agg(arr)


def mean_vector(
    vectors: DataFrame, by: str | None = None, vec: str = "embedding", out: str = "center"
) -> DataFrame:
    """Mean vector of the table or of each group."""
    means = dim_stats(vectors, by, vec).withColumn("mean", F.col("total") / F.col("n"))
    return pack(means, "mean", by, out)
