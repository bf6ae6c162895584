"""Further forms of search in inverted lists: within a radius, by inner product, over product codes by table
lookups, and restricted to the ids of a join or a subquery.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scale
from tessera.functions.distance import METRICS
from tessera.functions.vectorstats import dimension
from tessera.operators import ivf, kernels, quantize
from tessera.operators.search import arrow_types, within

# Rounding that distances of one pair may differ by when they are added up in another order.
SLACK = 1e-9

# ---------------------------------------------------------------- range search


def with_center(assigned: DataFrame, centers: DataFrame, fn, result: str, out: str, vec: str = "embedding") -> DataFrame:
    """``assigned`` with a column ``out`` = ``fn(vectors, centers of their lists)``, matrices in and out.

    Centers within the broadcast bound go to the tasks; more of them are joined by list.
    """
    kind = T._parse_datatype_string(result)
    wrap = lambda x: quantize._lists(x, pa.float64()) if isinstance(kind, T.ArrayType) else pa.array(x)
    dim = dimension(centers, "center")
    assigned = scale.of_dimension(assigned, vec, dim)
    rows = scale.bounded_vectors(centers, "list_id", "center")
    if rows is None:

        def paired(v: pa.Array, c: pa.Array) -> pa.Array:
            return wrap(fn(kernels.matrix(v, dim), kernels.matrix(c, dim)))

        joined = assigned.join(centers.select("list_id", "center"), "list_id")
        return joined.withColumn(out, F.arrow_udf(paired, result)(F.col(vec), F.col("center"))).select(*assigned.columns, out)
    rows.sort(key=lambda r: r["list_id"])
    sent = assigned.sparkSession.sparkContext.broadcast(
        (np.array([r["list_id"] for r in rows]), np.array([r["center"] for r in rows], dtype=np.float64).reshape(len(rows), dim))
    )

    def looked_up(v: pa.Array, lists: pa.Array) -> pa.Array:
        names, mat = sent.value
        at = np.searchsorted(names, lists.to_numpy(zero_copy_only=False))
        return wrap(fn(kernels.matrix(v, dim), mat[at]))

    return assigned.withColumn(out, F.arrow_udf(looked_up, result)(F.col(vec), F.col("list_id")))


def write_range_index(
    assigned: DataFrame, centers: DataFrame, path: str, id_col: str = "id", vec: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(index, lists): the index with each vector's distance to its center, and the reach of every list.

    The index is clustered by list and, inside a list, by that distance, so files and row groups have
    statistics of both. ``lists``: list_id, center, n, nearest and farthest distance.
    """
    spark = assigned.sparkSession
    away = with_center(assigned, centers, lambda x, c: np.sqrt(((x - c) ** 2).sum(1)), "double", "center_dist", vec)
    away.write.mode("errorifexists").parquet(f"{path}-assigned")
    placed = spark.read.schema(away.schema).parquet(f"{path}-assigned")
    order = ["list_id", "center_dist", id_col]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    index = spark.read.schema(away.schema).parquet(path)
    reach = index.groupBy("list_id").agg(F.count("*").alias("n"), F.min("center_dist").alias("nearest"), F.max("center_dist").alias("farthest"))
    reach.join(centers, "list_id").write.mode("errorifexists").parquet(f"{path}-lists")
    return index, spark.read.parquet(f"{path}-lists")


def lists_in_reach(lists: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(qid, list_id, dist): the lists that can hold a vector closer than ``radius``, with their center's distance.

    By the triangle inequality a vector of a list is at least ``dist - farthest`` and, as the center
    itself may be far inside, ``nearest - dist`` away from the query.
    """
    near = within(lists, queries, F.col("farthest") + radius + SLACK, "l2", "list_id", "center", keep=["nearest"])
    return near.where(F.col("nearest") - F.col("dist") < radius + SLACK).drop("nearest")


def _shell(by_list: dict[int, tuple[float, float]]) -> Column:
    """Rows of the lists whose distance to the center is inside the list's bounds; every term reaches the scan."""
    terms = [
        (F.col("list_id") == lst) & (F.col("center_dist") > lo) & (F.col("center_dist") < hi) for lst, (lo, hi) in sorted(by_list.items())
    ]
    while len(terms) > 1:  # a balanced tree, so that the plan's depth stays logarithmic
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1:]
    return terms[0] if terms else F.lit(False)


# More lists than this are filtered by their numbers alone: each bound is a part of the plan.
SHELL_LISTS = 512


def range_search(
    index: DataFrame, lists: DataFrame, queries: DataFrame, radius: float, k: int | None = None,
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """Every vector strictly closer than ``radius`` per query, or the nearest ``k`` of them: (qid, id, dist, rank).

    ``index`` and ``lists`` come from :func:`write_range_index`. Exact: lists out of reach are not read,
    and of the others only the vectors whose distance to the center differs from the query's by less than
    the radius are compared. Result rows are not bounded unless ``k`` is given.
    """
    probes = lists_in_reach(lists, queries, radius)
    rows = scale.bounded_vectors(queries, "qid", "qvec")
    asked = None if rows is None else scale.bounded_rows(probes)
    qtype, itype = queries.schema["qid"].dataType.simpleString(), index.schema[id_col].dataType.simpleString()
    schema = f"qid {qtype}, id {itype}, dist double"
    types = arrow_types(queries.schema["qid"], index.schema[id_col])
    if asked is None:
        found = _range_cells(index, probes, queries, radius, id_col, vec, schema)
    else:
        qids = [r["qid"] for r in rows]
        place = {q: i for i, q in enumerate(qids)}
        by_list: dict[int, list[tuple[int, float]]] = {}
        for r in asked:
            by_list.setdefault(int(r["list_id"]), []).append((place[r["qid"]], r["dist"]))
        used = {p for of in by_list.values() for p, _ in of}
        qmat = np.zeros((len(rows), len(rows[min(used)]["qvec"]) if used else 0))
        for p in used:  # a query without a vector has no lists
            qmat[p] = rows[p]["qvec"]
        asking = {lst: (np.array([p for p, _ in of]), np.array([d for _, d in of])) for lst, of in by_list.items()}
        sent = index.sparkSession.sparkContext.broadcast((qids, qmat, asking))

        def scan(batches):
            qids, qvecs, by = sent.value
            names = pa.array(qids, types[0])
            for b in batches:
                if not b.num_rows:
                    continue
                ids, away = b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
                x = kernels.matrix(b.column(2))
                for lst, at in kernels.grouped_rows(b.column(0).to_numpy(zero_copy_only=False)):
                    if int(lst) in by:
                        pos, qdist = by[int(lst)]
                        for q, i, d in kernels.pairs_within(x[at], qvecs[pos], radius, (away[at], qdist), SLACK):
                            yield pa.RecordBatch.from_arrays(
                                [names.take(pa.array(pos[q])), pa.array(ids[at[i]], types[1]), pa.array(d)], ["qid", "id", "dist"])

        if len(by_list) <= SHELL_LISTS:
            shells = {
                lst: (min(d for _, d in of) - radius - SLACK, max(d for _, d in of) + radius + SLACK) for lst, of in by_list.items()
            }
            read = index.where(_shell(shells))
        else:
            read = index.where(ivf.in_lists(by_list))
        found = read.select("list_id", id_col, vec, "center_dist").mapInArrow(scan, schema)
    if k is not None:
        best = scale.rank_per_group_salted(found, ["qid"], [F.asc("dist"), F.asc("id")], k, "id")
    elif (lists.agg(F.sum("n").alias("n")).head()["n"] or 0) <= scale.RANK_ROWS:
        # no query can have more rows than that
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")))
    else:
        best = scale.row_numbers(scale.cut_lineage(found), ["qid"], ["dist", "id"], "rank").withColumn("rank", F.col("rank").cast("int"))
    return best.select("qid", F.col("id").alias(id_col), "dist", "rank")


def _range_cells(index, probes, queries, radius, id_col, vec, schema, block: int | None = None):
    def cell(lst: int, ids: np.ndarray, x: pa.Array, names: np.ndarray, qm: np.ndarray) -> list[pd.DataFrame]:
        return [pd.DataFrame({"qid": names[q], "id": ids[i], "dist": d}) for q, i, d in kernels.pairs_within(kernels.matrix(x), qm, radius)]

    return ivf.list_cells(index, probes, queries, cell, schema, id_col, vec, block)


# ---------------------------------------------------------------- product codes by tables


def residuals(assigned: DataFrame, centers: DataFrame, vec: str = "embedding") -> DataFrame:
    """``assigned`` with every vector replaced by its difference from the center of its list."""
    moved = with_center(assigned, centers, lambda x, c: x - c, "array<double>", "_residual", vec)
    return moved.withColumn(vec, F.col("_residual")).drop("_residual")


def encode_residuals(
    assigned: DataFrame, centers: DataFrame, codec: quantize.ProductCodec, id_col: str = "id", vec: str = "embedding"
) -> DataFrame:
    """(list_id, id, codes) of the residuals, to be stored with ``ivf.write_index``."""
    return residuals(assigned, centers, vec).select("list_id", id_col, codec.encode(vec).alias("codes"))


def code_scores(codec: quantize.ProductCodec, codes: np.ndarray, qm: np.ndarray, center: np.ndarray | None, metric: str) -> np.ndarray:
    """(queries, codes) scores by summing table entries; ``center`` is that of the list for residual codes.

    Squared L2: a table holds the distances of the query's residual to every code word. Inner product:
    its entries are products with the query, to which the product with the center is added.
    """
    parts, _, width = codec.centers.shape
    if metric == "inner_product":
        tables = np.einsum("qmw,mkw->qmk", qm.reshape(len(qm), parts, width), codec.centers)
        out = np.zeros((len(qm), len(codes)))
        if center is not None:
            out += (qm @ center)[:, None]
    else:
        moved = (qm if center is None else qm - center).reshape(len(qm), parts, 1, width)
        tables = ((moved - codec.centers[None]) ** 2).sum(3)
        out = np.zeros((len(qm), len(codes)))
    for m in range(parts):
        out += tables[:, m].take(codes[:, m], axis=1)
    return out


QUERY_BLOCK = 64  # queries whose tables a task holds at once
CODE_BLOCK = 16_384


def search_codes(
    index: DataFrame, probes: DataFrame, queries: DataFrame, codec: quantize.ProductCodec, k: int,
    centers: DataFrame | None = None, metric: str = "l2", id_col: str = "id", codes: str = "codes",
) -> DataFrame:
    """Top-k over stored product codes by table lookups: (qid, id, dist, rank); no vector is decoded.

    With ``centers`` the codes are those of residuals, and a table belongs to a query and a list. Small
    query sets go to the tasks with their probes; larger ones join list by list in bounded blocks.
    """
    if metric not in ("l2", "l2_sq", "inner_product"):
        raise ValueError(f"no tables for {metric}")
    m = METRICS[metric]
    sign = 1.0 if m.ascending else -1.0
    spark = index.sparkSession
    rows = scale.bounded_vectors(queries, "qid", "qvec")
    asked = None if rows is None else scale.bounded_rows(probes.select("qid", "list_id"))
    middle = None if centers is None else scale.bounded_vectors(centers, "list_id", "center")
    if centers is not None and middle is None:
        raise ValueError("more centers than may be broadcast")
    model = spark.sparkContext.broadcast(
        (codec, None if middle is None else {int(r["list_id"]): np.array(r["center"], dtype=np.float64) for r in middle})
    )
    qtype, itype = queries.schema["qid"].dataType.simpleString(), index.schema[id_col].dataType.simpleString()
    schema = f"qid {qtype}, id {itype}, dist double"
    types = arrow_types(queries.schema["qid"], index.schema[id_col])

    def scored(lst: int, col: pa.Array, qm: np.ndarray, best: kernels.Best, names: np.ndarray, ids: np.ndarray) -> None:
        by, mids = model.value
        center = None if mids is None else mids[lst]
        packed = by.unpack(col)
        for lo in range(0, len(packed), CODE_BLOCK):
            for s in range(0, len(qm), QUERY_BLOCK):
                got = sign * code_scores(by, packed[lo:lo + CODE_BLOCK], qm[s:s + QUERY_BLOCK], center, metric)
                best.add(names[s:s + QUERY_BLOCK], got, ids[lo:lo + CODE_BLOCK])

    finish = lambda key: sign * (np.sqrt(np.maximum(key, 0)) if metric == "l2" else key)

    def cell(lst: int, ids: np.ndarray, x: pa.Array, names: np.ndarray, qm: np.ndarray) -> list[pd.DataFrame]:
        best = kernels.Best(len(qm), k)
        scored(lst, x, qm, best, np.arange(len(qm)), ids)
        return [pd.DataFrame({"qid": names[p], "id": i, "dist": finish(key)}) for p, i, key in best.rows()]

    if asked is None:
        found = ivf.list_cells(index, probes, queries, cell, schema, id_col, codes)
    else:
        qids = [r["qid"] for r in rows]
        place = {q: i for i, q in enumerate(qids)}
        by_list: dict[int, list[int]] = {}
        for r in asked:
            by_list.setdefault(int(r["list_id"]), []).append(place[r["qid"]])
        sent = spark.sparkContext.broadcast((qids, np.array([r["qvec"] for r in rows], dtype=np.float64), by_list))

        def scan(batches):
            names, qm, by = sent.value
            best = kernels.Best(len(names), k)
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(1).to_numpy(zero_copy_only=False)
                for lst, at in kernels.grouped_rows(b.column(0).to_numpy(zero_copy_only=False)):
                    asking = np.array(by.get(int(lst), []), dtype=np.int64)
                    if len(asking):
                        scored(int(lst), b.column(2).take(pa.array(at)), qm[asking], best, asking, ids[at])
            yield from kernels.all_hits(types, names, best, finish)

        found = index.where(ivf.in_lists(by_list)).select("list_id", id_col, codes).mapInArrow(scan, schema)
    top = scale.rank_task_results(found, index, ["qid"], [m.order("dist"), F.col("id")], k, "id")
    return top.select("qid", F.col("id").alias(id_col), "dist", "rank")


# ---------------------------------------------------------------- inner product


def longest(vectors: DataFrame, vec: str = "embedding") -> float:
    """The largest length of a vector (one row reaches the driver); 0 without vectors."""

    def lengths(col: pa.Array) -> pa.Array:
        return pa.array(np.sqrt((kernels.matrix(col) ** 2).sum(1)))

    dim = dimension(vectors, vec)
    rows = scale.of_dimension(vectors, vec, dim)
    return float(rows.agg(F.max(F.arrow_udf(lengths, "double")(F.col(vec))).alias("m")).head()["m"] or 0.0)


def extended(vectors: DataFrame, most: float, vec: str = "embedding", out: str = "extended") -> DataFrame:
    """With unit vectors in one more dimension: x / most, then what its length lacks to 1.

    The nearest of them to (q, 0) is the one with the largest inner product with q.
    """

    def longer(col: pa.Array) -> pa.Array:
        x = kernels.matrix(col) / (most or 1.0)
        rest = np.sqrt(np.maximum(1.0 - (x * x).sum(1), 0.0))
        return quantize._lists(np.hstack([x, rest[:, None]]), pa.float64())

    rows = scale.of_dimension(vectors, vec, dimension(vectors, vec))
    return rows.withColumn(out, F.arrow_udf(longer, "array<double>")(F.col(vec)))


def train_ip(
    vectors: DataFrame, nlist: int, rounds: int = 8, seed: int = 42, id_col: str = "id", vec: str = "embedding", fraction: float = 1.0
) -> tuple[np.ndarray, float]:
    """(centers, longest): spherical k-means of the extended vectors, unit centers in one more dimension."""
    most = longest(vectors, vec)
    rows = extended(vectors, most, vec).select(id_col, F.col("extended").alias(vec))
    return quantize.lloyd(rows, nlist, 1, rounds, seed, id_col, vec, fraction, unit=True)[0], most


def assign_ip(vectors: DataFrame, centers: np.ndarray | DataFrame, most: float, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """The table with the ``list_id`` of the center nearest to the extended vector."""
    return ivf.assign(extended(vectors, most, vec), centers, id_col, "extended").drop("extended")


def probe_ip(centers: DataFrame, queries: DataFrame, nprobe: int) -> DataFrame:
    """The ``nprobe`` lists per query whose unit centers have the largest inner product with (q, 0)."""
    flat = centers.select("list_id", F.slice("center", 1, F.size("center") - 1).alias("center"))
    return ivf.probe(flat, queries, nprobe, "inner_product")


# ---------------------------------------------------------------- allowed ids

_PIECE = 1 << 15  # bits of one bitmap made by bitmap_construct_agg


def _piece(c: Column) -> tuple[Column, Column]:
    at = F.pmod(c.cast("long"), F.lit(_PIECE))
    return ((c.cast("long") - at) / _PIECE).cast("long"), at


def allowed_pieces(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(piece, bits): the ids as bitmaps of 4 KB, built by partial aggregates before the shuffle."""
    piece, at = _piece(F.col(id_col))
    rows = ids.where(F.col(id_col).isNotNull()).select(piece.alias("piece"), at.alias("at"))
    return rows.groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits"))


def only_allowed(index: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of the index whose id is among ``ids``; vectors and codes of the others leave the scan no further.

    Whole-number ids meet as bitmap pieces, broadcast where they are proven small; other ids by a semi join.
    """
    if not isinstance(index.schema[id_col].dataType, T.IntegralType):
        return index.join(scale.broadcast_if_small(ids.select(id_col).distinct()), id_col, "left_semi")
    pieces = allowed_pieces(ids, id_col)
    piece, at = _piece(F.col(id_col))
    joined = index.withColumn("_at", at).withColumn("_piece", piece).join(
        scale.broadcast_if_small(pieces), F.col("_piece") == F.col("piece")
    )
    byte = F.conv(F.hex(F.substring("bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = joined.withColumn("_byte", byte).where(F.expr("(shiftright(_byte, cast(_at % 8 as int)) & 1) = 1"))
    return kept.select(*index.columns)


def knn_join(
    index: DataFrame, centers: DataFrame, queries: DataFrame, other: DataFrame, on: str, k: int, nprobe: int,
    metric: str = "l2", id_col: str = "id", data: str = "embedding", order: list[str] | None = None,
) -> DataFrame:
    """The k nearest rows of ``index join other``: (qid, id, dist, rank, columns of other).

    Vectors without a partner are dropped before any distance. A vector with several partners gives
    several rows, ranked by ``order`` (the other columns) among equals; the k nearest joined rows are among
    those of the k nearest vectors that have a partner, so only k vectors per query are joined.
    """
    partners = other.select(on).where(F.col(on).isNotNull()).distinct()
    rows = index.join(scale.broadcast_if_small(partners), on, "left_semi")
    m = METRICS[metric]
    hit = ivf.search(rows, ivf.probe(centers, queries, nprobe, metric if metric == "inner_product" else "l2"), queries, k, metric, id_col, data)
    keyed = index.select(id_col, on).join(scale.broadcast_if_small(hit.drop("rank")), id_col)
    joined = keyed.join(other, on)
    ties = order if order is not None else [c for c in other.columns if c != on]
    best = scale.rank_per_group(joined, ["qid"], [m.order("dist"), F.col(id_col), *map(F.col, ties)], k)
    return best.select("qid", id_col, "dist", "rank", *other.columns)


__all__ = [
    "allowed_pieces", "assign_ip", "code_scores", "encode_residuals", "extended", "knn_join", "lists_in_reach", "longest",
    "only_allowed", "probe_ip", "range_search", "residuals", "search_codes", "train_ip", "with_center", "write_range_index",
]
