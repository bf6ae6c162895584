"""Data generators as Spark jobs. Every value is a hash of seed and row id: partitioning, retries
and lost executors never change a row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scale
from tessera.operators.quantize import _lists

def unit(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) from seed and keys, on 2^32 steps: the first half of an md5."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def gauss(seed: int, *keys) -> Column:
    """A standard normal number from seed and keys (Box and Muller)."""
    u, v = unit(seed, *keys), unit(seed + 1, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def resample(
    source: DataFrame, users: int, n: int, seed: int = 42, id_col: str = "id", vec: str = "embedding"
) -> DataFrame:
    """For each user n source vectors with replacement: ``(user_id, id, embedding)``.

    The source is numbered 0..N-1; each draw hashes (user, i) to a number and joins on it.
    """
    numbered = scale.row_numbers(source.select(id_col, vec), [], [id_col], "_i")
    total = source.count()
    if not total:
        raise ValueError("source holds no vectors")
    spark = source.sparkSession
    draws = spark.range(users * n).select(
        F.expr(f"cast(id div {n} as int)").alias("user_id"),
        F.expr(f"cast(id % {n} as int)").alias("id"),
    )
    pick = F.floor(unit(seed, "user_id", "id") * total) + 1
    drawn = draws.withColumn("_i", pick.cast("long"))
    return drawn.join(numbered.select("_i", vec), "_i").select("user_id", "id", F.col(vec).alias("embedding"))


def expand_ids(df: DataFrame, times: int, offset: int, id_col: str = "id") -> DataFrame:
    """The table ``times``-fold, copy b with ids shifted by ``b * offset``; no shuffle."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_b")
    kind = df.schema[id_col].dataType
    shifted = (F.col(id_col) + F.col("_b") * F.lit(offset)).cast(kind).alias(id_col)
    return df.select("*", copies).select(*[shifted if c == id_col else F.col(c) for c in df.columns])


def uniform_vectors(
    rows: DataFrame, low: float = 1.0, high: float = 100.0, categories: int = 9, seed: int = 42,
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """``(id, category 1..categories, embedding)``: the given vectors plus noise uniform in [low, high)."""
    moved = F.transform(vec, lambda x, j: x.cast("double") + low + unit(seed, F.col(id_col), j) * (high - low))
    category = (F.floor(unit(seed + 1, id_col) * categories) + 1).cast("int").alias("category")
    return rows.select(id_col, category, moved.alias(vec))


def normal_unit(rows: DataFrame, sigma: float = 0.1, seed: int = 42, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """``(id, embedding)``: the given vectors plus Gaussian noise, scaled to length one."""
    moved = F.transform(vec, lambda x, j: x.cast("double") + sigma * gauss(seed, F.col(id_col), j))
    drawn = rows.select(id_col, moved.alias(vec))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return drawn.withColumn("_n", norm).select(id_col, F.transform(vec, lambda x: x / F.col("_n")).alias(vec))


def clustered(
    rows: DataFrame, centers: DataFrame, spread: float = 0.8, seed: int = 42, id_col: str = "id",
) -> DataFrame:
    """``(id, cluster, embedding)``: a row for each given id, dealt to the given ``(list_id, center)``
    round robin, plus Gaussian noise."""
    n = centers.count()
    dealt = rows.select(id_col, F.pmod(F.col(id_col), F.lit(n)).cast("int").alias("cluster"))
    numbered = scale.row_numbers(centers, [], ["list_id"], "_i").select(
        (F.col("_i") - 1).cast("int").alias("cluster"), "center")
    moved = F.transform("center", lambda x, j: x + spread * gauss(seed, F.col(id_col), j))
    return dealt.join(scale.broadcast_if_small(numbered), "cluster").select(id_col, "cluster", moved.alias("embedding"))


def _normal(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    return np.stack([np.random.default_rng([seed, int(i)]).standard_normal(dim) for i in ids])


def noisy_queries(queries: DataFrame, sigma: float, seed: int = 42) -> DataFrame:
    """Query vectors ``(qid, qvec)`` plus Gaussian noise."""

    def add(ids: pa.Array, col: pa.Array) -> pa.Array:
        if not len(col):
            return pa.array([], pa.list_(pa.float32()))
        x = np.stack([np.asarray(v, dtype=np.float64) for v in col.to_pylist()])
        return _lists((x + sigma * _normal(ids.to_numpy(), x.shape[1], seed)).astype(np.float32), pa.float32())

    return queries.select("qid", F.arrow_udf(add, "array<float>")("qid", "qvec").alias("qvec"))


def typed_rows(
    rows: DataFrame, id_col: str, schema: T.StructType, seed: int = 42,
    ranges: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """A random row of a schema for each given id; integer ranges can be given per column, decimals
    fill their type."""
    ranges = ranges or {}
    given = rows.select(F.col(id_col).alias("id"))

    def column(i: int, f: T.StructField) -> Column:
        u, t = unit(seed + i, F.col("id")), f.dataType
        lo, hi = ranges.get(f.name, (0, 1_000_000))
        whole = F.floor(lo + u * (hi - lo + 1))
        if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            if isinstance(t, T.ByteType) and f.name not in ranges:
                whole = F.floor(u * 100)
            elif isinstance(t, T.ShortType) and f.name not in ranges:
                whole = F.floor(u * 30_000)
            c = whole
        elif isinstance(t, T.DecimalType):
            # nine digits a draw, as many draws as the type has digits
            draws = [F.floor(unit(seed + i + 1000 * k, F.col("id")) * 1e9).cast("string") for k in range(-(-t.precision // 9))]
            digits = F.substring(F.concat(*[F.lpad(x, 9, "0") for x in draws]), 1, t.precision)
            whole, part = F.substring(digits, 1, t.precision - t.scale), F.substring(digits, t.precision - t.scale + 1, t.scale)
            c = F.concat(F.lit("0"), whole, F.lit("."), part, F.lit("0"))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = lo + u * (hi - lo)
        elif isinstance(t, T.DateType):
            c = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(u * 1461).cast("int"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.timestamp_seconds(F.lit(1_577_836_800) + F.floor(u * 126_230_400))
        elif isinstance(t, T.BooleanType):
            c = u < 0.5
        else:
            c = F.substring(F.md5(F.concat(F.lit(f"{seed + i}:"), F.col("id").cast("string"))), 1, 12)
        return c.cast(t).alias(f.name)

    return given.select("id", *[column(i, f) for i, f in enumerate(schema.fields)])
