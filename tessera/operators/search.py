"""Exact vector search: top-k, range, compound, per tenant and for many queries at once."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera import scale
from tessera.functions.distance import METRICS, parse_vector, query_function
from tessera.functions.vectorstats import dimension
from tessera.operators import kernels


def with_distance(
    vectors: DataFrame, q: Sequence[float], metric: str = "l2", vec: str = "embedding",
    out: str = "dist",
) -> DataFrame:
    """Add the score to a constant query.

    Rows drop out when the vector is NULL, of another dimension, or without a score (the cosine
    of a zero vector).
    """
    same_dim = vectors.where(F.size(vec) == len(q))
    return same_dim.withColumn(out, METRICS[metric].to_query(vec, q)).where(F.col(out).isNotNull())


def knn(
    vectors: DataFrame, q: Sequence[float], k: int, metric: str = "l2", id_col: str = "id",
    vec: str = "embedding", where: Column | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """The k nearest rows to one query, filtered first when ``where`` is given.

    Sort plus limit becomes TakeOrderedAndProject: each task keeps k rows, one small merge.
    """
    m = METRICS[metric]
    v = vectors if where is None else vectors.where(where)
    scored = with_distance(v, q, metric, vec)
    return scored.select(id_col, *keep, "dist").orderBy(m.order("dist"), id_col).limit(k)


def range_search(
    vectors: DataFrame, q: Sequence[float], radius: float, metric: str = "l2",
    id_col: str = "id", vec: str = "embedding", keep: Sequence[str] = (),
) -> DataFrame:
    """All rows closer than the radius (strictly), nearest first."""
    m = METRICS[metric]
    d = with_distance(vectors, q, metric, vec)
    inside = F.col("dist") < radius if m.ascending else F.col("dist") > radius
    return d.where(inside).select(id_col, *keep, "dist").orderBy(m.order("dist"), id_col)


def range_search_outside(
    vectors: DataFrame, q: Sequence[float], radius: float, metric: str = "l2",
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """The complement of :func:`range_search`, over the whole table."""
    m = METRICS[metric]
    d = with_distance(vectors, q, metric, vec)
    outside = F.col("dist") >= radius if m.ascending else F.col("dist") <= radius
    return d.where(outside).select(id_col, "dist").orderBy(m.order("dist"), id_col)


def compound_search(
    vectors: DataFrame, q: Sequence[float], radius: float, k: int, metric: str = "l2",
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """The k nearest rows among those inside the radius."""
    return range_search(vectors, q, radius, metric, id_col, vec).limit(k)


def radius_at_percentile(
    vectors: DataFrame, q: Sequence[float], percents: Sequence[float], vec: str = "embedding"
) -> DataFrame:
    """Radius that takes in each percentage of rows, linear between neighbours."""
    d = with_distance(vectors, q, "l2", vec).select("dist")
    r = scale.percentiles(d, [], "dist", [p / 100 for p in percents])
    return r.select(F.round(F.col("p") * 100, 9).alias("percent"), F.col("dist").alias("radius"))


# ---------------------------------------------------------------- many queries


def arrow_types(*fields: T.StructField) -> list[pa.DataType]:
    """Arrow types of the given columns."""
    return [to_arrow_type(f.dataType) for f in fields]


def knn_batch(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id",
    vec: str = "embedding", qid: str = "qid", qvec: str = "qvec",
) -> DataFrame:
    """Exact top-k per query: ``(qid, id, dist, rank)``.

    A query set proven small goes to every task; each task scans its part of the vectors once
    with matrix products and emits at most k rows per query. A larger query set takes the block
    grid of :func:`knn_grid`, which ships neither side whole.
    """
    m = METRICS[metric]
    rows = scale.bounded_vectors(queries, qid, qvec)
    if rows is None:
        return knn_grid(vectors, queries, k, metric, id_col, vec, qid, qvec)
    rows = [r for r in rows if r[qvec] is not None]
    dim = len(rows[0][qvec]) if rows else 0
    vectors = scale.of_dimension(vectors, vec, dim)
    qids = [r[qid] for r in rows]
    qs = np.array([r[qvec] for r in rows], dtype=np.float64).reshape(len(rows), dim)
    sent = vectors.sparkSession.sparkContext.broadcast((qids, qs))
    qtype = queries.schema[qid].dataType.simpleString()
    itype = vectors.schema[id_col].dataType.simpleString()
    types = arrow_types(queries.schema[qid], vectors.schema[id_col])

    def scan(batches):
        names, qmat = sent.value
        top = kernels.TopK(qmat, k, metric)
        for b in batches:
            if b.num_rows and len(qmat):
                top.add(
                    b.column(0).to_numpy(zero_copy_only=False),
                    kernels.matrix(b.column(1), qmat.shape[1]),
                )
        yield from kernels.all_hits(types, names, top)

    local = vectors.select(id_col, vec).mapInArrow(
        scan, f"qid {qtype}, id {itype}, dist double"
    )
    best = scale.rank_task_results(local, vectors, ["qid"], [m.order("dist"), F.col("id")], k, "id")
    return best.select(F.col("qid").alias(qid), F.col("id").alias(id_col), "dist", "rank")


def knn_batch_metrics(
    vectors: DataFrame, queries: DataFrame, k: int, metrics: Sequence[str], id_col: str = "id",
    vec: str = "embedding", qid: str = "qid", qvec: str = "qvec",
) -> DataFrame:
    """:func:`knn_batch` under several metrics in one scan: ``(metric, qid, id, dist, rank)``.

    Each task keeps k rows per query and metric. A query set beyond the broadcast bound takes one grid per metric.
    """
    rows = scale.bounded_vectors(queries, qid, qvec)
    if rows is None:
        parts = [knn_grid(vectors, queries, k, m, id_col, vec, qid, qvec).select(F.lit(m).alias("metric"), qid, id_col, "dist", "rank") for m in metrics]
        return reduce(DataFrame.unionByName, parts)
    rows = [r for r in rows if r[qvec] is not None]
    dim = len(rows[0][qvec]) if rows else 0
    names = list(metrics)
    sent = vectors.sparkSession.sparkContext.broadcast(
        ([r[qid] for r in rows], np.array([r[qvec] for r in rows], dtype=np.float64).reshape(len(rows), dim)))
    types = arrow_types(queries.schema[qid], vectors.schema[id_col])
    qtype = queries.schema[qid].dataType.simpleString()
    itype = vectors.schema[id_col].dataType.simpleString()

    def scan(batches):
        qids, qmat = sent.value
        tops = [kernels.TopK(qmat, k, m) for m in names]
        for b in batches:
            if b.num_rows and len(qmat):
                ids, x = b.column(0).to_numpy(zero_copy_only=False), kernels.matrix(b.column(1), qmat.shape[1])
                for top in tops:
                    top.add(ids, x)
        for m, top in zip(names, tops):
            sign = 1.0 if METRICS[m].ascending else -1.0
            for hit in kernels.all_hits(types, qids, top):
                key = pa.array(sign * hit.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(hit)), *hit.columns, key], ["metric", "qid", "id", "dist", "key"])

    source = scale.of_dimension(vectors, vec, dim)
    local = source.select(id_col, vec).mapInArrow(scan, f"metric string, qid {qtype}, id {itype}, dist double, key double")
    best = scale.rank_task_results(local, source, ["metric", "qid"], [F.asc("key"), F.col("id")], k, "id")
    return best.select("metric", F.col("qid").alias(qid), F.col("id").alias(id_col), "dist", "rank")


def knn_grid(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id",
    vec: str = "embedding", qid: str = "qid", qvec: str = "qvec",
    block_values: int = scale.BROADCAST_VALUES, exclude_self: bool = False,
) -> DataFrame:
    """Exact top-k for a large query set as a grid of bounded blocks.

    Vectors and queries are hashed into blocks of bounded size; every (vector block, query
    block) pair is one task that returns k rows per query, ranked again over all blocks.
    Blocks are by hash of the id, so no key can make one of them hot.
    """
    m = METRICS[metric]
    dim = dimension(queries, qvec)
    vectors, queries = scale.of_dimension(vectors, vec, dim), scale.of_dimension(queries, qvec, dim)
    per_block = max(block_values // max(dim, 1), 1)
    nv = max(math.ceil(vectors.count() / per_block), 1)
    nq = max(math.ceil(queries.count() / per_block), 1)
    qtype = queries.schema[qid].dataType.simpleString()
    itype = vectors.schema[id_col].dataType.simpleString()
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(
        F.col(id_col).alias("id"), F.col(vec).alias("v"), block(id_col, nv).alias("vb"),
        every(nq).alias("qb"),
    )
    right = queries.select(
        F.col(qid).alias("qid"), F.col(qvec).alias("q"), block(qid, nq).alias("qb"),
        every(nv).alias("vb"),
    )

    types = arrow_types(queries.schema[qid], vectors.schema[id_col])
    schema = pa.schema([("qid", types[0]), ("id", types[1]), ("dist", pa.float64())])

    def cell(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return schema.empty_table()
        plain = lambda t, c: t[c].combine_chunks()
        top = kernels.TopK(kernels.matrix(plain(q, "q"), dim), k + 1 if exclude_self else k, metric)
        for b in v.select(["id", "v"]).to_batches():
            top.add(b.column(0).to_numpy(zero_copy_only=False), kernels.matrix(b.column(1), dim))
        names = plain(q, "qid")
        found = pa.Table.from_batches(list(kernels.all_hits(types, names, top)), schema)
        return found.filter(pc.not_equal(found["id"], found["qid"])) if exclude_self else found

    cells = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(
        cell, f"qid {qtype}, id {itype}, dist double"
    )
    best = scale.rank_per_group_salted(cells, ["qid"], [m.order("dist"), F.col("id")], k, "id")
    return best.select(F.col("qid").alias(qid), F.col("id").alias(id_col), "dist", "rank")


def within(
    vectors: DataFrame, queries: DataFrame, limit: Column | float, metric: str = "l2", id_col: str = "id",
    vec: str = "embedding", qid: str = "qid", qvec: str = "qvec", keep: Sequence[str] = (),
    block_values: int = scale.BROADCAST_VALUES,
) -> DataFrame:
    """All pairs strictly inside a limit, exact: ``(qid, id, dist, keep...)``.

    ``limit`` is a number or a column of ``vectors``. Small query sets go to every task; larger ones
    meet the vectors in a grid of blocks by hash. The result has as many rows as there are pairs.
    """
    m = METRICS[metric]
    inside = (lambda d, cut: d < cut) if m.ascending else (lambda d, cut: d > cut)
    source = vectors.select(
        F.col(id_col).alias("id"), F.col(vec).alias("v"), (limit if isinstance(limit, Column) else F.lit(float(limit))).alias("cut"), *keep
    )
    qtype = queries.schema[qid].dataType.simpleString()
    extra = [source.schema[c] for c in keep]
    schema = T.StructType([
        *T._parse_datatype_string(f"qid {qtype}").fields, T.StructField("id", vectors.schema[id_col].dataType),
        T.StructField("dist", T.DoubleType()), *extra,
    ])
    rows = scale.bounded_vectors(queries, qid, qvec)

    def pairs(ids: pa.Array, x: np.ndarray, cut: np.ndarray, rest: list[pa.Array], names: list, qs: np.ndarray):
        types = arrow_types(*schema.fields)
        for name, q in zip(names, qs):
            d = kernels.exact_scores(x, q, metric)
            hit = np.flatnonzero(inside(d, cut))
            if len(hit):
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(hit), types[0]), ids.take(at), pa.array(d[hit]), *[c.take(at) for c in rest]], schema.names
                )

    number = lambda c: c.to_numpy(zero_copy_only=False)
    if rows is not None:
        rows = [r for r in rows if r[qvec] is not None]
        dim = len(rows[0][qvec]) if rows else 0
        sent = vectors.sparkSession.sparkContext.broadcast(
            ([r[qid] for r in rows], np.array([r[qvec] for r in rows], dtype=np.float64).reshape(len(rows), dim))
        )

        def scan(batches):
            names, qs = sent.value
            for b in batches:
                if b.num_rows and len(qs):
                    yield from pairs(b.column(0), kernels.matrix(b.column(1), qs.shape[1]), number(b.column(2)), b.columns[3:], names, qs)

        found = scale.of_dimension(source, "v", dim).mapInArrow(scan, schema)
    else:
        dim = dimension(queries, qvec)
        source, asked = scale.of_dimension(source, "v", dim), scale.of_dimension(queries, qvec, dim)
        per = max(block_values // max(dim, 1), 1)
        nv, nq = max(math.ceil(source.count() / per), 1), max(math.ceil(asked.count() / per), 1)
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = source.select("*", block("id", nv).alias("_vb"), every(nq).alias("_qb"))
        right = asked.select(F.col(qid).alias("qid"), F.col(qvec).alias("q"), block(qid, nq).alias("_qb"), every(nv).alias("_vb"))

        def cell(v: pa.Table, q: pa.Table) -> pa.Table:
            none = pa.schema(list(zip(schema.names, arrow_types(*schema.fields)))).empty_table()
            if not len(v) or not len(q):
                return none
            plain = lambda t, c: t[c].combine_chunks()
            out = pairs(plain(v, "id"), kernels.matrix(plain(v, "v"), dim), number(plain(v, "cut")), [plain(v, c) for c in keep],
                        q["qid"].to_pylist(), kernels.matrix(plain(q, "q"), dim))
            return pa.Table.from_batches(list(out), none.schema)

        found = left.groupBy("_vb", "_qb").cogroup(right.groupBy("_vb", "_qb")).applyInArrow(cell, schema)
    return found.select(F.col("qid").alias(qid), F.col("id").alias(id_col), "dist", *keep)


# ---------------------------------------------------------------- bound parameters

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}")


_TO_QUERY = "tessera_distance_to_query"


def check_identifier(name: str) -> str:
    """The name itself when it is a plain (dotted) identifier, else ValueError."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def knn_param_query(
    spark: SparkSession, table: str, vector_text: str, k: int, id_col: str = "id",
    vec: str = "embedding", extra: Sequence[str] = (),
) -> DataFrame:
    """L2 top-k as one SQL statement: vector text and limit bound, identifiers checked.

    The distance is a function registered for the parsed vector, evaluated in Arrow batches. Rows whose vector
    is NULL or of another dimension are no candidates; text that is no vector is an error.
    """
    for name in (table, id_col, vec, *extra):
        check_identifier(name)
    if not 0 < int(k):
        raise ValueError("k must be positive")
    cols = "".join(f"IDENTIFIER('{c}'), " for c in (id_col, *extra))
    q = [float(x) for x in vector_text.strip().removeprefix("[").removesuffix("]").split(",")]
    # the statement is analysed at once, so a later query may take the name over
    spark.udf.register(_TO_QUERY, query_function(q, "l2"))
    return spark.sql(
        f"""
        SELECT {cols} {_TO_QUERY}(IDENTIFIER(:vec)) AS dist FROM IDENTIFIER(:table)
        WHERE size(IDENTIFIER(:vec)) = :dim ORDER BY dist, IDENTIFIER(:id) LIMIT :k""",
        args={"table": table, "vec": vec, "id": id_col, "dim": len(q), "k": int(k)},
    )


# ---------------------------------------------------------------- query sets


def sample_queries(
    sources: Sequence[DataFrame], n: int, seed: int = 42, id_col: str = "id",
    vec: str = "embedding",
) -> DataFrame:
    """A seeded sample of n query vectors from the first source that has rows.

    Rows are ordered by a hash of seed and id, so the sample does not depend on partitions. A
    sample within the broadcast bound is drawn once and kept as a local table.
    """
    for v in sources:
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
        picked = v.orderBy(key, id_col).limit(n).select(F.col(id_col).alias("qid"), F.col(vec).alias("qvec"))
        if n > scale.BROADCAST_ROWS:
            if not v.isEmpty():
                return picked
            continue
        drawn = scale.local_table(picked)
        if not drawn.isEmpty():
            return drawn
    raise ValueError("no source holds query vectors")


def tenant_set(total: int, n: int, anchor: int, seed: int = 42) -> list[int]:
    """n tenant numbers out of ``total``, seeded, always with the anchor."""
    if n >= total:
        return list(range(total))
    rng = np.random.default_rng([seed, n, anchor])
    others = [u for u in range(total) if u != anchor]
    return sorted([anchor, *rng.choice(others, size=n - 1, replace=False).tolist()])


def tenant_filter(
    vectors: DataFrame, tenants: Sequence[int] | DataFrame, col: str = "user_id"
) -> DataFrame:
    """Rows of the given tenants: a pushed-down IN list, or a semi join for a DataFrame."""
    if isinstance(tenants, DataFrame):
        return vectors.join(tenants, col, "left_semi")
    return vectors.where(F.col(col).isin([int(t) for t in tenants]))


__all__ = [
    "check_identifier", "compound_search", "knn", "knn_batch", "knn_batch_metrics", "knn_grid", "knn_param_query",
    "parse_vector", "radius_at_percentile", "range_search", "range_search_outside",
    "sample_queries", "tenant_filter", "tenant_set", "with_distance", "within",
]
