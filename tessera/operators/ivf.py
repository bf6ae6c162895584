"""Search in inverted lists: train, assign, store, probe, search, re-rank.

An index is a table of vectors or codes with a ``list_id`` plus a small set of centers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scale
from tessera.functions.distance import METRICS, as_col
from tessera.functions.vectorstats import dimension
from tessera.operators import kernels, quantize
from tessera.operators.search import arrow_types, knn_batch, knn_grid

Decode = Callable[[pa.Array], np.ndarray]


def train(vectors: DataFrame, nlist: int, rounds: int = 8, seed: int = 42, id_col: str = "id",
          vec: str = "embedding", fraction: float = 1.0) -> np.ndarray:
    """Centers (nlist, dim) by k-means; ``rounds=0`` keeps seeded random rows."""
    return quantize.lloyd(vectors, nlist, 1, rounds, seed, id_col, vec, fraction)[0]


def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    """Centers as ``(list_id, center)`` rows of a local table."""
    lists = pa.array(np.asarray(centers, dtype=np.float64).tolist(), pa.list_(pa.float64()))
    table = pa.table({"list_id": pa.array(range(len(centers)), pa.int32()), "center": lists})
    return spark.createDataFrame(table)


def assign(vectors: DataFrame, centers: np.ndarray | DataFrame, id_col: str = "id",
           vec: str = "embedding") -> DataFrame:
    """The table with the ``list_id`` of its nearest center.

    Centers within the broadcast bound go to every task and nothing is shuffled; a larger center
    table takes the block grid.
    """
    if isinstance(centers, DataFrame):
        rows = scale.bounded_vectors(centers, "list_id", "center")
        if rows is None:
            near = knn_grid(centers, vectors, 1, "l2", "list_id", "center", id_col, vec)
            return vectors.join(near.select(id_col, "list_id"), id_col)
        rows.sort(key=lambda r: r["list_id"])
        names = np.array([r["list_id"] for r in rows], dtype=np.int32)
        mat = np.array([r["center"] for r in rows], dtype=np.float64)
    else:
        mat = np.asarray(centers, dtype=np.float64)
        names = np.arange(len(mat), dtype=np.int32)
        if mat.size > scale.BROADCAST_VALUES:
            return assign(vectors, centers_frame(vectors.sparkSession, mat), id_col, vec)
    sent = vectors.sparkSession.sparkContext.broadcast((names, mat))

    def nearest(col: pa.Array) -> pa.Array:
        ids, c = sent.value
        return pa.array(ids[quantize.nearest(kernels.matrix(col, c.shape[1]), c)])

    rows = scale.of_dimension(vectors, vec, mat.shape[1])
    return rows.withColumn("list_id", F.arrow_udf(nearest, "int")(F.col(vec)))


def write_index(assigned: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """Store the table clustered by list and return it as read back.

    The assignment runs once, into a first copy; that copy is range-clustered by list and id into
    sorted files. A hot list covers several ranges and files, and the statistics of files and row
    groups skip the lists a search does not probe, for any number of lists.
    """
    spark = assigned.sparkSession
    first = f"{path}-assigned"
    assigned.write.mode("errorifexists").parquet(first)
    placed = spark.read.schema(assigned.schema).parquet(first)
    placed.repartitionByRange("list_id", id_col).sortWithinPartitions("list_id", id_col).write.mode(
        "errorifexists").parquet(path)
    return spark.read.schema(assigned.schema).parquet(path)


def list_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("list_id").agg(F.count("*").alias("n"))


def list_stats(assigned: DataFrame, nlist: int | None = None) -> DataFrame:
    """Distribution of list sizes: one row. ``nlist`` counts lists that got no vector too."""
    s = list_sizes(assigned).agg(
        F.count("*").alias("used"), F.sum("n").alias("total"), F.min("n").alias("smallest"),
        F.max("n").alias("largest"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"),
    )
    empty = (F.lit(nlist) - F.col("used")) if nlist is not None else F.lit(0)
    return s.withColumn("empty", empty.cast("long"))


def probe(centers: DataFrame, queries: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """The nprobe nearest lists per query: ``(qid, list_id, dist, rank)``."""
    return knn_batch(centers, queries, nprobe, metric, "list_id", "center")


def dynamic_probe(probes: DataFrame, ratio: float) -> DataFrame:
    """Drop probed lists whose center is farther than ``ratio`` times the nearest one."""
    nearest = F.min("dist").over(Window.partitionBy("qid"))
    return probes.withColumn("_near", nearest).where(F.col("dist") <= ratio * F.col("_near")).drop("_near")


def candidate_cost(probes: DataFrame, sizes: DataFrame, bytes_per_vector: float) -> DataFrame:
    """Mean candidates per query, their share of a full scan, bytes read per query: one row."""
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    per = probes.join(sizes, "list_id", "left").groupBy("qid").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cand")
    )
    mean = per.agg(F.avg("cand").alias("mean_candidates"))  # one row
    return mean.crossJoin(F.broadcast(total)).select(
        "mean_candidates", (F.col("mean_candidates") / F.col("total")).alias("scan_share"),
        (F.col("mean_candidates") * bytes_per_vector).alias("bytes_per_query"),
    )


def _plain(col: pa.Array) -> np.ndarray:
    return kernels.matrix(col)


def decoder(codec: quantize.Codec) -> Decode:
    """Batch decoder of a packed code column."""
    return lambda col: codec.vectors(codec.unpack(col))


def search(
    index: DataFrame, probes: DataFrame, queries: DataFrame, k: int, metric: str = "l2",
    id_col: str = "id", data: str = "embedding", decode: Decode = _plain,
) -> DataFrame:
    """Top-k per query over the probed lists: ``(qid, id, dist, rank)``.

    ``data`` holds vectors, or codes that ``decode`` turns into vectors batch by batch. A query
    set proven small is broadcast with its probes: the scan prunes to the probed lists and every
    task returns k rows per query. A larger one joins list by list in bounded blocks.
    """
    rows = scale.bounded_vectors(queries, "qid", "qvec")
    asked = None if rows is None else scale.bounded_rows(probes.select("qid", "list_id"))
    if decode is _plain:
        index = scale.of_dimension(index, data, dimension(queries, "qvec") if rows is None else _width(rows))
    m = METRICS[metric]
    if asked is None:
        found = _search_blocks(index, probes, queries, k, metric, id_col, data, decode)
    else:
        found = _search_broadcast(index, rows, asked, queries, k, metric, id_col, data, decode)
    best = scale.rank_task_results(found, index, ["qid"], [m.order("dist"), F.col("id")], k, "id")
    return best.select("qid", F.col("id").alias(id_col), "dist", "rank")


def _width(rows) -> int:
    return max((len(r["qvec"]) for r in rows if r["qvec"] is not None), default=0)


def _search_broadcast(index, rows, asked, queries, k, metric, id_col, data, decode):
    qids = [r["qid"] for r in rows]
    place = {q: i for i, q in enumerate(qids)}
    by_list: dict[int, list[int]] = {}
    for r in asked:
        by_list.setdefault(int(r["list_id"]), []).append(place[r["qid"]])
    qmat = np.array([r["qvec"] for r in rows], dtype=np.float64).reshape(len(rows), _width(rows))
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((qids, qmat, by_list))
    qtype = queries.schema["qid"].dataType.simpleString()
    itype = index.schema[id_col].dataType.simpleString()
    types = arrow_types(queries.schema["qid"], index.schema[id_col])

    def scan(batches):
        names, qm, lists = sent.value
        top = kernels.TopK(qm, k, metric)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(1).to_numpy(zero_copy_only=False)
            x = decode(b.column(2))
            for lst, at in kernels.grouped_rows(b.column(0).to_numpy(zero_copy_only=False)):
                if int(lst) in lists:
                    top.add(ids[at], x[at], np.array(lists[int(lst)]))
        yield from kernels.all_hits(types, names, top)

    probed = index.where(in_lists(by_list))
    return probed.select("list_id", id_col, data).mapInArrow(
        scan, f"qid {qtype}, id {itype}, dist double"
    )


def in_lists(lists: Iterable[int]) -> Column:
    """Rows of the given lists, in groups that Parquet checks value by value in any session.

    A longer IN is only checked by its range unless the session raises a threshold of ten.
    """
    names = sorted(int(x) for x in lists)
    terms = [F.col("list_id").isin(names[i : i + 10]) for i in range(0, len(names), 10)]
    while len(terms) > 1:  # a balanced tree, so that the plan's depth stays logarithmic
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
    return terms[0] if terms else F.lit(False)


Cell = Callable[[int, np.ndarray, pa.Array, np.ndarray, np.ndarray], list[pd.DataFrame]]


def list_cells(
    index: DataFrame, probes: DataFrame, queries: DataFrame, cell: Cell, schema: str, id_col: str, data: str, block: int | None = None
) -> DataFrame:
    """Lists and the queries that probe them, in blocks so that a hot list is many tasks.

    ``cell`` gets (list, ids, vectors or codes, query names, query matrix) of one block of each side and
    gives frames of the schema; their rows are returned.
    """
    # rows per side of one task: bounded numbers, not bounded rows
    block = block or max(scale.BROADCAST_VALUES // max(dimension(queries, "qvec"), 1), 1)
    ways = list_sizes(index).select("list_id", F.ceil(F.col("n") / block).cast("int").alias("nv"))
    asked = probes.groupBy("list_id").agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))
    grid = scale.broadcast_if_small(ways.join(asked, "list_id"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), (F.col(c) - 1).cast("long")))
    left = index.select("list_id", F.col(id_col).alias("id"), F.col(data).alias("x")).join(grid, "list_id")
    left = left.select(F.col("list_id").cast("int").alias("lst"), "id", "x", F.pmod(F.xxhash64("id"), "nv").alias("vb"),
                       upto("nq").alias("qb"))
    right = probes.select("qid", "list_id").join(queries.select("qid", "qvec"), "qid").join(grid, "list_id")
    right = right.select(F.col("list_id").cast("int").alias("lst"), "qid", "qvec", F.pmod(F.xxhash64("qid"), "nq").alias("qb"),
                         upto("nv").alias("vb"))
    fields = T._parse_datatype_string(schema).fields
    none = pa.schema(list(zip([f.name for f in fields], arrow_types(*fields)))).empty_table()

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return none
        plain = lambda t, c: t[c].combine_chunks()
        found = cell(v["lst"][0].as_py(), v["id"].to_numpy(), plain(v, "x"), q["qid"].to_numpy(), kernels.matrix(plain(q, "qvec")))
        rows = [pa.Table.from_pandas(f, none.schema, preserve_index=False) for f in found if len(f)]
        return pa.concat_tables([none, *rows])

    keys = ["lst", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _search_blocks(index, probes, queries, k, metric, id_col, data, decode, block: int | None = None):
    qtype = queries.schema["qid"].dataType.simpleString()
    itype = index.schema[id_col].dataType.simpleString()

    def cell(lst: int, ids: np.ndarray, data: pa.Array, names: np.ndarray, qm: np.ndarray) -> list[pd.DataFrame]:
        top = kernels.TopK(qm, k, metric)
        for r in range(0, len(ids), 16384):
            top.add(ids[r : r + 16384], decode(data.slice(r, 16384)))
        return [pd.DataFrame({"qid": names[p], "id": i, "dist": d}) for p, i, d in top.rows()]

    return list_cells(index, probes, queries, cell, f"qid {qtype}, id {itype}, dist double", id_col, data, block)


def encode_bits(
    assigned: DataFrame, centers: np.ndarray, centered: bool = True, seed: int = 42, id_col: str = "id",
    vec: str = "embedding",
) -> DataFrame:
    """``(list_id, id, code)``: 1-bit codes of assigned vectors, to be stored and searched."""
    return search_bits(assigned, None, None, centers, 0, 0, centered, seed, id_col, vec, encode_only=True)


def search_bits(
    vectors: DataFrame, probes: DataFrame, queries: DataFrame, centers: np.ndarray, k: int,
    query_bits: int = 0, centered: bool = True, seed: int = 42, id_col: str = "id", vec: str = "embedding",
    encode_only: bool = False,
) -> DataFrame:
    """Top-k over 1-bit codes in the probed lists, by estimated distance.

    With ``centered`` each list is coded around its own center, else around zero. Queries and
    probes are the broadcast side; a set beyond the bound runs in batches. ``vectors`` holds vectors,
    or stored codes in ``code`` as :func:`encode_bits` made them with the same centers and seed.
    """
    mid = centers if centered else np.zeros((1, centers.shape[1]))
    if mid.size + mid.shape[1] * 2 * mid.shape[1] > scale.BROADCAST_VALUES:
        raise ValueError("centers and rotation exceed what may be broadcast; code around zero with centered=False or use fewer lists")
    model = vectors.sparkSession.sparkContext.broadcast((mid, quantize.rotation(mid.shape[1], seed)))

    def codec_of(lst: int) -> quantize.BitCodec:
        mids, turn = model.value
        return quantize.BitCodec(mids[lst if centered else 0], turn)

    def encode(lists: pd.Series, v: pd.Series) -> pd.DataFrame:
        x, ln = np.stack(v.to_numpy()).astype(np.float64), lists.to_numpy()
        bits, norm, unit = [None] * len(x), np.empty(len(x)), np.empty(len(x))
        for lst, at in kernels.grouped_rows(ln):
            b, n, u = codec_of(int(lst)).pack(x[at])
            norm[at], unit[at] = n, u
            for i, row in zip(at, b, strict=True):
                bits[i] = row.tobytes()
        return pd.DataFrame({"bits": bits, "norm": norm, "unit": unit})

    if "code" in vectors.columns:  # stored codes
        coded = vectors.select("list_id", id_col, "code")
    else:
        code = F.pandas_udf(encode, quantize.BIT_FIELDS)("list_id", vec)
        coded = scale.of_dimension(vectors, vec, centers.shape[1]).select("list_id", id_col, code.alias("code"))
    if encode_only:
        return coded
    rows = scale.bounded_vectors(queries, "qid", "qvec")
    asked = None if rows is None else scale.bounded_rows(probes.select("qid", "list_id"))
    if asked is None:
        # too large to broadcast: bounded batches of probes by hash, each its own scan; a query's
        # probes may lie in several batches, whose best rows are ranked again
        n, bound = queries.count(), scale.BROADCAST_ROWS
        load = max(n * centers.shape[1] / scale.BROADCAST_VALUES, n / bound, probes.count() / bound)
        batches = math.ceil(2 * load) + 1
        both = scale.cut_lineage(probes.select("qid", "list_id").distinct().join(queries.select("qid", "qvec"), "qid"))
        out = None
        for i in range(batches):
            mine = both.where(F.pmod(F.xxhash64(F.lit(batches), "qid", "list_id"), F.lit(batches)) == i)
            part = search_bits(vectors, mine.select("qid", "list_id"), mine.select("qid", "qvec").distinct(),
                               centers, k, query_bits, centered, seed, id_col, vec)
            out = part if out is None else out.unionByName(part)
        top = scale.rank_per_group_salted(out.drop("rank"), ["qid"], [F.asc("dist"), F.col(id_col)], k, id_col)
        return top.select("qid", id_col, "dist", "rank")
    qids = [r["qid"] for r in rows]
    place = {q: i for i, q in enumerate(qids)}
    by_list: dict[int, list[int]] = {}
    for r in asked:
        by_list.setdefault(int(r["list_id"]), []).append(place[r["qid"]])
    qmat = np.array([r["qvec"] for r in rows], dtype=np.float64)
    sent = vectors.sparkSession.sparkContext.broadcast((qids, qmat, by_list))
    qtype = queries.schema["qid"].dataType.simpleString()
    itype = vectors.schema[id_col].dataType.simpleString()
    types = arrow_types(queries.schema["qid"], vectors.schema[id_col])

    def scan(batches):
        names, qm, lists = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(1).to_numpy(zero_copy_only=False)
            bits, norm, unit = quantize.unpack_codes(b.column(2))
            for lst, at in kernels.grouped_rows(b.column(0).to_numpy(zero_copy_only=False)):
                asking = lists.get(int(lst), [])
                if not asking:
                    continue
                est = codec_of(int(lst)).estimate(bits[at], norm[at], unit[at], qm[asking], query_bits)
                for j, p in enumerate(asking):
                    key, cand = est[:, j], ids[at]
                    if p in best:
                        key, cand = np.concatenate([best[p][0], key]), np.concatenate([best[p][1], cand])
                    keep = np.lexsort((cand, key))[:k]
                    best[p] = (key[keep], cand[keep])
        for p, (key, cand) in best.items():
            yield kernels.hits(types, names[p], cand, key)

    found = coded.where(in_lists(by_list)).mapInArrow(
        scan, f"qid {qtype}, id {itype}, dist double"
    )
    top = scale.rank_task_results(found, coded, ["qid"], [F.asc("dist"), F.col("id")], k, "id")
    return top.select("qid", F.col("id").alias(id_col), "dist", "rank")


def pair_distance(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """Distance between two vector columns of the same row, as one Arrow UDF."""

    def rowwise(x: pa.Array, y: pa.Array) -> pa.Array:
        xm, ym = kernels.matrix(x), kernels.matrix(y)
        if metric in ("l2", "l2_sq"):
            d = ((xm - ym) ** 2).sum(1)
            return pa.array(np.sqrt(d) if metric == "l2" else d)
        ip = (xm * ym).sum(1)
        return pa.array(-ip if metric == "neg_inner_product" else ip)

    return F.arrow_udf(rowwise, "double")(as_col(a), as_col(b))


REFINE_FORMS = ("flat", "sq8", "sq4", "fp16")


def refine(
    candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, form: str = "flat",
    metric: str = "l2", id_col: str = "id", vec: str = "embedding", data: str | None = None,
    decode: Decode | None = None, probes: DataFrame | None = None,
) -> DataFrame:
    """Second stage: re-rank candidates (k x factor per query) on better vectors.

    With ``decode`` the vectors are stored codes in the column ``data``, decoded only for candidates.
    Otherwise ``form`` names a storage that vectors pass through here; an unknown one is flat. Given the
    ``probes`` of the first stage, only their lists of a stored index are read.
    """
    m = METRICS[metric]
    if probes is not None and "list_id" in vectors.columns:
        rows = scale.bounded_rows(probes.select("list_id").distinct())
        if rows is not None:
            vectors = vectors.where(in_lists(r["list_id"] for r in rows))
    vec = data or vec
    stored = vectors.select(id_col, vec)
    pairs = stored.join(scale.broadcast_if_small(candidates.select("qid", id_col)), id_col)
    if decode is not None:
        to_lists = F.arrow_udf(lambda col: quantize._lists(decode(col), pa.float64()), "array<double>")
        pairs = pairs.withColumn(vec, to_lists(F.col(vec)))
    elif form in ("sq8", "sq4"):
        codec = quantize.sq_train(vectors, 8 if form == "sq8" else 4, vec=vec)
        pairs = pairs.withColumn(vec, codec.decode(codec.encode(vec)))
    elif form == "fp16":
        pairs = pairs.withColumn(vec, quantize.half_vectors(quantize.half_codes(vec)))
    scored = pairs.join(scale.broadcast_if_small(queries.select("qid", "qvec")), "qid").select(
        "qid", id_col, pair_distance(vec, "qvec", metric).alias("dist")
    )
    return scale.rank_per_group(scored, ["qid"], [m.order("dist"), F.col(id_col)], k)


def knn_approx(
    index: DataFrame, centers: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "l2",
    codec: quantize.Codec | None = None, where: Column | None = None, radius: float | None = None,
    id_col: str = "id", data: str = "embedding",
) -> DataFrame:
    """Approximate search as users call it: top-k, with optional prefilter and radius.

    With all lists probed and no codec the answer is exact. ``codec`` searches product or scalar
    codes in ``data`` instead of vectors.
    """
    rows = index if where is None else index.where(where)
    # centers are probed by L2 except when the search itself is an inner product
    probes = probe(centers, queries, nprobe, metric if metric == "inner_product" else "l2")
    hit = search(rows, probes, queries, k, metric, id_col, data, decoder(codec) if codec else _plain)
    if radius is None:
        return hit
    return hit.where(F.col("dist") < radius if METRICS[metric].ascending else F.col("dist") > radius)


def suggested_lists(n: int) -> int:
    """Number of lists for n vectors: about four times the square root."""
    return max(1, int(4 * math.sqrt(n)))


__all__ = [
    "assign", "candidate_cost", "centers_frame", "decoder", "dynamic_probe", "encode_bits", "in_lists", "knn_approx",
    "list_cells", "list_sizes", "list_stats", "pair_distance", "probe", "refine", "search", "search_bits",
    "suggested_lists", "train", "write_index",
]
