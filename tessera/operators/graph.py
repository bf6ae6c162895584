"""Neighbour graphs as edge tables ``(src, dst, dist)`` with squared L2 distances.

Work on all nodes at once: every step is a join, a ranking per node or a sorted streaming pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import scale
from tessera.operators import ivf, kernels
from tessera.operators.search import arrow_types, knn_grid
from tessera.session import work_path
from tessera.sources import tables


def knn_graph(vectors: DataFrame, degree: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Exact graph: the ``degree`` nearest other vectors of each vector.

    All pairs are compared, block against block; only ``degree`` rows per vector leave a block.
    For large tables use :func:`knn_graph_cells`.
    """
    asked = vectors.select(F.col(id_col).alias("qid"), F.col(vec).alias("qvec"))
    near = knn_grid(vectors, asked, degree, "l2_sq", id_col, vec, exclude_self=True)
    return near.select(F.col("qid").alias("src"), F.col(id_col).alias("dst"), "dist")


def overlap_assign(
    vectors: DataFrame, centers: DataFrame, copies: int, id_col: str = "id", vec: str = "embedding"
) -> DataFrame:
    """Each vector in its ``copies`` nearest clusters: ``(id, list_id, rank)`` beside the vector."""
    rows = scale.bounded_vectors(centers, "list_id", "center")
    if rows is None:
        near = knn_grid(centers, vectors, copies, "l2", "list_id", "center", id_col, vec)
        return vectors.select(id_col, vec).join(near.select(id_col, "list_id", "rank"), id_col)
    rows.sort(key=lambda r: r["list_id"])
    names = np.array([r["list_id"] for r in rows], dtype=np.int32)
    mat = np.array([r["center"] for r in rows], dtype=np.float64)
    sent = vectors.sparkSession.sparkContext.broadcast((names, mat))
    copies = min(copies, len(names))

    def nearest(col: pa.Array) -> pa.Array:
        ids, c = sent.value
        x = kernels.matrix(col, c.shape[1])
        return pa.array(ids[kernels.nearest_few(x, c, copies)].tolist(), pa.list_(pa.int32()))

    lists = F.arrow_udf(nearest, "array<int>")(F.col(vec))
    out = scale.of_dimension(vectors, vec, mat.shape[1]).select(id_col, vec, F.posexplode(lists).alias("_p", "list_id"))
    return out.select(id_col, vec, "list_id", (F.col("_p") + 1).alias("rank"))


def knn_graph_cells(
    vectors: DataFrame, centers: DataFrame, copies: int, degree: int, id_col: str = "id",
    vec: str = "embedding", block: int | None = None,
) -> DataFrame:
    """Graph from exact neighbours inside overlapping clusters, merged.

    Cost follows cluster sizes instead of all pairs; hot clusters are cut into block pairs.
    """
    cells = overlap_assign(vectors, centers, copies, id_col, vec)
    asked = vectors.select(F.col(id_col).alias("qid"), F.col(vec).alias("qvec"))
    probes = cells.select(F.col(id_col).alias("qid"), "list_id")
    index = cells.select(id_col, vec, "list_id")
    found = ivf._search_blocks(index, probes, asked, degree + 1, "l2_sq", id_col, vec, ivf._plain, block)
    pairs = found.where("qid <> id").groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    best = scale.rank_per_group(pairs, ["qid"], [F.asc("dist"), F.col("id")], degree)
    return best.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def union_edges(*parts: DataFrame) -> DataFrame:
    """Set union of edge tables, self loops left out."""
    out = parts[0].select("src", "dst", "dist")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst", "dist"))
    return out.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def undirected(edges: DataFrame, max_degree: int) -> DataFrame:
    """Edges in both directions, at most ``max_degree`` per node, lowest ids first."""
    both = union_edges(edges, reverse(edges))
    return scale.rank_per_group(both, ["src"], [F.col("dst")], max_degree).drop("rank")


def prune_nearest(edges: DataFrame, max_degree: int) -> DataFrame:
    """The nearest ``max_degree`` edges per node that both ends keep."""
    kept = scale.rank_per_group(edges, ["src"], [F.asc("dist"), F.col("dst")], max_degree).drop("rank")
    return kept.join(reverse(kept).select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", "dist")


def _covered(d: np.ndarray, px: np.ndarray, alpha: float | None) -> np.ndarray:
    """Whether a kept vector at squared distances ``d`` covers candidates that are ``px`` from the node."""
    return d < px if alpha is None else alpha * d <= px


def _prune_stream(candidates: DataFrame, vectors: DataFrame, max_degree: int, alpha: float | None,
                  id_col: str, vec: str) -> DataFrame:
    """Greedy pruning of candidates in order of distance, one sorted pass per partition.

    Candidates marked ``pre`` are kept already and come first. A task holds one batch and the vectors kept
    for the current node, whatever the node's number of candidates. Returns (src, dst, dist, pre).
    """
    types = arrow_types(candidates.schema["src"], candidates.schema["dst"])
    fields = f"src {candidates.schema['src'].dataType.simpleString()}, dst {candidates.schema['dst'].dataType.simpleString()}"
    v = vectors.select(F.col(id_col).alias("dst"), F.col(vec).alias("v"))
    rows = candidates.select("src", "dst", "dist", "pre").join(v, "dst").select("src", "dst", "dist", "v", "pre")
    ordered = rows.repartition("src").sortWithinPartitions("src", F.desc("pre"), "dist", "dst")

    def prune(batches):
        node, kept = None, None
        for b in batches:
            if not b.num_rows:
                continue
            src = b.column(0).to_numpy(zero_copy_only=False)
            dst = b.column(1).to_numpy(zero_copy_only=False)
            px = b.column(2).to_numpy(zero_copy_only=False)
            x = kernels.matrix(b.column(3))
            pre = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            take = []
            cuts = np.flatnonzero(src[1:] != src[:-1]) + 1
            for at in np.split(np.arange(len(src)), cuts):
                if node is None or src[at[0]] != node:
                    node, kept = src[at[0]], np.empty((0, x.shape[1]))
                mine = at[pre[at]]
                take += mine.tolist()
                kept, at = np.vstack([kept, x[mine]]), at[~pre[at]]
                if len(kept) >= max_degree or not len(at):
                    continue
                blocked = np.zeros(len(at), dtype=bool)
                for y in kept:
                    blocked |= _covered(((x[at] - y) ** 2).sum(1), px[at], alpha)
                while len(kept) < max_degree and not blocked.all():
                    i = int(np.argmin(blocked))
                    take.append(at[i])
                    kept = np.vstack([kept, x[at[i]]])
                    blocked |= _covered(((x[at] - x[at[i]]) ** 2).sum(1), px[at], alpha)
                    blocked[: i + 1] = True
            if take:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(src[take], types[0]), pa.array(dst[take], types[1]), pa.array(px[take]), pa.array(pre[take])],
                    ["src", "dst", "dist", "pre"],
                )

    return ordered.mapInArrow(prune, f"{fields}, dist double, pre boolean")


def _uncovered(rest: DataFrame, kept: DataFrame, vectors: DataFrame, alpha: float | None, id_col: str, vec: str) -> DataFrame:
    """The candidates that no vector in ``kept`` of their node covers, each row on its own.

    A hub's candidates lie in many tasks; its kept vectors are one row, which the skew join repeats.
    """
    v = vectors.select(F.col(id_col).alias("dst"), F.col(vec).alias("v"))
    lists = kept.join(v, "dst").groupBy("src").agg(F.flatten(F.collect_list("v")).alias("kept"))  # max_degree vectors

    def free(px: pa.Array, x: pa.Array, near: pa.Array) -> pa.Array:
        m, p = kernels.matrix(x), px.to_numpy(zero_copy_only=False)
        flat = near.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False))])
        out = np.ones(len(m), dtype=bool)
        for i, row in enumerate(m):
            y = flat[offsets[i] : offsets[i + 1]].reshape(-1, m.shape[1])
            out[i] = not _covered(((y - row) ** 2).sum(1), p[i], alpha).any()
        return pa.array(out)

    joined = rest.join(v, "dst").join(lists, "src")
    return joined.where(F.arrow_udf(free, "boolean")("dist", "v", "kept")).select("src", "dst", "dist")


def prune(
    candidates: DataFrame, vectors: DataFrame, max_degree: int, alpha: float | None = None,
    id_col: str = "id", vec: str = "embedding", first: int | None = None,
) -> DataFrame:
    """Keep a candidate unless a kept one, nearer to the node, covers it.

    Covered means closer to the kept one than to the node, or ``alpha * d(x, y) <= d(p, x)`` when
    ``alpha`` is given. Candidates are tried in order of distance until ``max_degree`` are kept.

    Work goes in rounds over blocks of a node's ``first`` nearest candidates that are left. Most nodes
    are done after one. The candidates behind the block of the others are held against what the node
    has kept so far, row by row in many tasks, and only uncovered ones stay; as the nearest of them is kept
    in the next round, there are at most ``max_degree`` rounds and no task ever holds a hub. The
    result is that of one full pass.
    """
    first = first or 8 * max_degree
    order = [F.asc("dist"), F.col("dst")]
    rest = union_edges(candidates)
    kept = out = None
    while True:
        head = scale.cut_lineage(scale.rank_per_group_salted(rest, ["src"], order, first + 1, "dst"))
        block = head.where(F.col("rank") <= first).select("src", "dst", "dist", F.lit(False).alias("pre"))
        if kept is not None:
            block = block.unionByName(kept)
        found = scale.cut_lineage(_prune_stream(block, vectors, max_degree, alpha, id_col, vec))
        more = head.where(F.col("rank") == first + 1).select("src", F.col("dist").alias("from_dist"), F.col("dst").alias("from_dst"))
        full = found.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= max_degree).select("src")
        again = scale.cut_lineage(more.join(full, "src", "left_anti"))
        done = found.join(again, "src", "left_anti").select("src", "dst", "dist")
        out = done if out is None else out.unionByName(done)
        if again.isEmpty():
            return out
        behind = rest.join(again, "src").where(
            (F.col("dist") > F.col("from_dist")) | ((F.col("dist") == F.col("from_dist")) & (F.col("dst") >= F.col("from_dst")))
        ).select("src", "dst", "dist")
        kept = found.join(again.select("src"), "src", "left_semi").withColumn("pre", F.lit(True))
        left = scale.cut_lineage(_uncovered(behind, kept, vectors, alpha, id_col, vec))
        # nodes without any uncovered candidate are done
        over = kept.join(left.select("src").distinct(), "src", "left_anti").select("src", "dst", "dist")
        out = out.unionByName(over)
        if left.isEmpty():
            return out
        kept = kept.join(left.select("src").distinct(), "src", "left_semi")
        rest = left


def store_graph(
    vectors: DataFrame, edges: DataFrame, name: str, path: str, buckets: int | None = None, id_col: str = "id", vec: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(vectors, edges) as tables bucketed by node, for searches whose frontier is too large to broadcast.

    With as many buckets as shuffle partitions (the default), a round deals out the frontier alone:
    neither the vectors nor the edges move.
    """
    spark = vectors.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding"))
    v = tables.save_bucketed(nodes, f"{name}_nodes", buckets, ["id"], ["id"], f"{path}/nodes")
    e = tables.save_bucketed(edges.select("src", "dst", "dist"), f"{name}_edges", buckets, ["src"], ["src", "dst"], f"{path}/edges")
    return v, e


class _Asked:
    """Stored queries and the largest degree: what the rounds of a search need to know.

    The frontier of a round has at most (active nodes x largest degree) rows, so whether it can be
    broadcast follows from a count instead of another pass.
    """

    def __init__(self, vectors, edges, queries, id_col, vec):
        self.v = vectors.select(F.col(id_col).alias("node"), F.col(vec).alias("v"))
        self.queries = scale.cut_lineage(queries.select("qid", "qvec"))
        small = scale.bounded_vectors(self.queries, "qid", "qvec") is not None
        self.q = F.broadcast(self.queries) if small else self.queries
        self.links = edges.select(F.col("src").alias("node"), "dst")
        degrees = edges.groupBy("src").count().agg(F.max("count").alias("m"))
        self.degree = degrees.head()["m"] or 0

    def sized(self, df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= scale.BROADCAST_ROWS else df

    def around(self, active: DataFrame, n: int) -> DataFrame:
        """Distinct neighbours ``(qid, node)`` of n active ``(qid, node)`` rows."""
        hops = self.links.join(self.sized(active, n), "node")
        return hops.select("qid", F.col("dst").alias("node")).distinct()

    def scored(self, pairs: DataFrame, n: int) -> DataFrame:
        """Squared distances of at most n ``(qid, node)`` pairs."""
        return self.v.join(self.sized(pairs, n), "node").join(self.q, "qid").select(
            "qid", "node", ivf.pair_distance("v", "qvec", "l2_sq").alias("dist"))

    def start(self, entry) -> DataFrame:
        """``(qid, node, dist)`` where searches begin: one node for all, or a row ``(qid, node)`` per query."""
        if isinstance(entry, DataFrame):
            pairs = entry.select("qid", "node")
        else:
            pairs = self.queries.select("qid", F.lit(entry).alias("node"))
        return self.scored(pairs, self.queries.count())


def greedy_search(
    vectors: DataFrame, edges: DataFrame, queries: DataFrame, entry,
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """Hill climb for all queries together: ``(qid, node, dist, computed)``.

    Each step moves every query to its nearest neighbour if that is nearer than its place, and
    ends when no query moves; every move shortens a distance, so that is certain. ``computed`` counts
    distances. ``entry`` is a node, or the result of an earlier climb from whose places, distances and
    counts this one goes on. ``edges`` should be a stored table.
    """
    ask = _Asked(vectors, edges, queries, id_col, vec)
    on = isinstance(entry, DataFrame) and {"dist", "computed"} <= set(entry.columns)
    begin = entry.select("qid", "node", "dist", "computed") if on else ask.start(entry).withColumn("computed", F.lit(1).cast("bigint"))
    state = scale.cut_lineage(begin.withColumn("moved", F.lit(True)))
    while True:
        active = state.where("moved").select("qid", "node")
        n = active.count()
        if not n:
            break
        best = ask.scored(ask.around(active, n), n * ask.degree).groupBy("qid").agg(
            F.min_by(F.struct("node", "dist"), F.struct("dist", "node")).alias("b"), F.count("*").alias("c")
        )
        step = state.join(best, "qid", "left")
        better = F.col("moved") & F.coalesce(F.col("b.dist") < F.col("dist"), F.lit(False))
        state = scale.cut_lineage(step.select(
            "qid", F.when(better, F.col("b.node")).otherwise(F.col("node")).alias("node"),
            F.when(better, F.col("b.dist")).otherwise(F.col("dist")).alias("dist"),
            (F.col("computed") + F.coalesce("c", F.lit(0))).alias("computed"), better.alias("moved"),
        ))
    return state.drop("moved")


class _Seen:
    """The ``(qid, node, dist)`` rows that searches have seen: appended to a table bucketed by node, never rewritten.

    Fresh pairs are dealt out by node to be scored; where seen rows lie the same way they do not move.
    """

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.rounds = spark, buckets, 0
        path = work_path(spark, "seen")
        self.name, self.path = "seen_" + path.rsplit("-", 1)[1], path

    def add(self, rows: DataFrame) -> DataFrame:
        """Append the rows of a round; returns them as they were written."""
        out = rows.select("qid", "node", "dist", F.lit(self.rounds).alias("round")).repartition(self.buckets, "node")
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        old = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")  # rows dealt out by node may be joined by (node, qid)
        try:
            writer = out.write.mode("append").partitionBy("round").bucketBy(self.buckets, "node").option("path", self.path)
            writer.saveAsTable(self.name)
        finally:
            self.spark.conf.set(key, old)
        self.rounds += 1
        return self.spark.table(self.name).where(F.col("round") == self.rounds - 1).select("qid", "node", "dist")

    def without(self, pairs: DataFrame) -> DataFrame:
        """The pairs that were not seen."""
        return pairs.join(self.spark.table(self.name).select("node", "qid"), ["node", "qid"], "left_anti").select("qid", "node")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def beam_search(
    vectors: DataFrame, edges: DataFrame, queries: DataFrame, entry, beam: int, budget: int,
    k: int | None = None, id_col: str = "id", vec: str = "embedding", buckets: int | None = None,
) -> DataFrame:
    """Best-first search for all queries together: ``(qid, id, dist, rank, computed)``.

    A round expands every node among a query's ``beam`` nearest seen ones that was not expanded
    yet. A query stops when its beam is expanded or it has seen ``budget`` nodes. One node seen is
    one distance computed. ``entry`` is a node or a row ``(qid, node)`` per query.

    ``edges`` should be a stored table, see :func:`store_graph`. Between rounds only the nearest nodes
    per query, ``beam`` or ``k``, and a count are kept; seen pairs are appended to a table.
    """
    ask = _Asked(vectors, edges, queries, id_col, vec)
    spark = queries.sparkSession
    seen = _Seen(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = max(beam, k or beam)
    order = [F.asc("dist"), F.col("node")]
    # every row of a query carries the number of nodes it has seen
    state = lambda rows: rows.withColumn("done", F.lit(False)).withColumn("computed", F.lit(1).cast("bigint"))
    best = scale.cut_lineage(state(seen.add(ask.start(entry))))
    whole = Window.partitionBy("qid")
    try:
        while True:  # every round expands a node that was not expanded before
            near = scale.rank_per_group(best, ["qid"], order, beam).where(~F.col("done") & (F.col("computed") < budget))
            todo = scale.cut_lineage(near.select("qid", "node"))
            n = todo.count()
            if not n:
                break
            new = seen.add(ask.scored(seen.without(ask.around(todo, n)), n * ask.degree))
            marked = best.join(ask.sized(todo.withColumn("_x", F.lit(True)), n), ["qid", "node"], "left").select(
                "qid", "node", "dist", (F.col("done") | F.coalesce("_x", F.lit(False))).alias("done"), "computed")
            both = marked.unionByName(new.select("qid", "node", "dist", F.lit(False).alias("done"), F.lit(None).cast("bigint").alias("computed")))
            counted = both.withColumn("computed", F.max("computed").over(whole) + F.count_if(F.col("computed").isNull()).over(whole))
            best = scale.cut_lineage(scale.rank_per_group(counted, ["qid"], order, wide).drop("rank"))
    finally:
        seen.drop()
    return scale.rank_per_group(best, ["qid"], order, k or beam).select("qid", F.col("node").alias("id"), "dist", "rank", "computed")


# ---------------------------------------------------------------- layers

LEVEL_BITS = 2  # each level has a fourth of the nodes of the one below


def node_level(node: Column, seed: int = 42, bits: int = LEVEL_BITS) -> Column:
    """Highest level of a node, by a hash of its id: one of ``2**bits`` nodes reaches the next one."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:level:"), node.cast("string"))), 1, 8), 16, 10).cast("double")
    zeros = 31 - F.floor(F.log2(F.greatest(head, F.lit(0.5))))
    return F.floor(zeros / bits).cast("int")


def layered_graph(
    vectors: DataFrame, centers: DataFrame, copies: int, degree: int, max_degree: int, seed: int = 42,
    bits: int = LEVEL_BITS, id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """``(level, src, dst, dist)``: on every level a graph from overlapping clusters of the nodes that reach it.

    Levels shrink geometrically, so all together cost little more than the lowest.
    """
    leveled = vectors.select(id_col, vec).withColumn("_level", node_level(F.col(id_col), seed, bits))
    top = leveled.agg(F.max("_level").alias("m")).head()["m"]
    out = None
    for level in range(top + 1 if top is not None else 0):
        rows = leveled.where(F.col("_level") >= level).drop("_level")
        edges = undirected(knn_graph_cells(rows, centers, copies, degree, id_col, vec), max_degree)
        edges = edges.select(F.lit(level).alias("level"), "src", "dst", "dist")
        out = edges if out is None else out.unionByName(edges)
    if out is None:
        raise ValueError("no vectors")
    return out


def top_node(vectors: DataFrame, seed: int = 42, bits: int = LEVEL_BITS, id_col: str = "id") -> tuple[int, object]:
    """(level, node) where searches of a layered graph begin: the lowest id on the highest level."""
    level = node_level(F.col(id_col), seed, bits)
    head = vectors.groupBy(level.alias("level")).agg(F.min(id_col).alias("node")).orderBy(F.desc("level")).head()
    return head["level"], head["node"]


def layered_search(
    vectors: DataFrame, layers: DataFrame, queries: DataFrame, beam: int, budget: int, k: int | None = None,
    seed: int = 42, bits: int = LEVEL_BITS, id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """Descent for all queries together: ``(qid, id, dist, rank, computed)``.

    A climb on every level from the highest down to the second begins where the one above ended; a
    beam search of the lowest level begins where the last one ended. ``computed`` counts the distances of
    all levels. ``layers`` should be a stored table.
    """
    level, place = top_node(vectors, seed, bits, id_col)
    while level > 0:
        place = greedy_search(vectors, layers.where(F.col("level") == level).drop("level"), queries, place, id_col, vec)
        level -= 1
    lowest = layers.where(F.col("level") == 0).drop("level")
    found = beam_search(vectors, lowest, queries, place, beam, budget, k, id_col, vec)
    if not isinstance(place, DataFrame):
        return found
    # the place where the climb ended was computed there
    climbed = place.select("qid", (F.col("computed") - 1).alias("_climb"))
    return found.join(climbed, "qid").select("qid", "id", "dist", "rank", (F.col("computed") + F.col("_climb")).alias("computed"))


def level_counts(vectors: DataFrame, seed: int = 42, bits: int = LEVEL_BITS, id_col: str = "id") -> DataFrame:
    """``(level, nodes, reached)``: nodes whose highest level it is, and nodes that have an edge list there."""
    per = vectors.groupBy(node_level(F.col(id_col), seed, bits).alias("level")).agg(F.count("*").alias("nodes"))
    every = per.agg(F.max("level").alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("level"))
    rows = every.join(per, "level", "left").select("level", F.coalesce("nodes", F.lit(0)).alias("nodes"))
    # as many rows as levels
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("reached", F.sum("nodes").over(above))


def random_graph(vectors: DataFrame, degree: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Seeded start graph: each node linked to ``degree`` other nodes by number."""
    numbered = scale.row_numbers(vectors.select(id_col), [], [id_col], "_i")
    n = vectors.count()
    draw = F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("_d")
    picks = numbered.select(
        F.col(id_col).alias("src"), "_i", draw
    ).withColumn("_j", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "_d")), 1, 8), 16, 10).cast("long") % n + 1)
    other = numbered.select(F.col("_i").alias("_j"), F.col(id_col).alias("dst"))
    return picks.join(other, "_j").where("src <> dst").select("src", "dst").distinct()


def with_distances(pairs: DataFrame, vectors: DataFrame, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """``(src, dst, dist)`` for node pairs."""
    a = vectors.select(F.col(id_col).alias("src"), F.col(vec).alias("_a"))
    b = vectors.select(F.col(id_col).alias("dst"), F.col(vec).alias("_b"))
    return pairs.select("src", "dst").join(a, "src").join(b, "dst").select(
        "src", "dst", ivf.pair_distance("_a", "_b", "l2_sq").alias("dist"))


def refine_pass(
    vectors: DataFrame, edges: DataFrame, entry, degree: int, beam: int, alpha: float = 1.2,
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """One build pass for all nodes: search candidates, add current neighbours, prune, add reverse
    edges, prune again."""
    asked = vectors.select(F.col(id_col).alias("qid"), F.col(vec).alias("qvec"))
    found = beam_search(vectors, edges, asked, entry, beam, 4 * beam, 2 * beam, id_col=id_col, vec=vec)
    cand = union_edges(found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist"), edges)
    kept = prune(cand, vectors, degree, alpha, id_col, vec)
    return scale.cut_lineage(prune(union_edges(kept, reverse(kept)), vectors, degree, alpha, id_col, vec))


def degree_stats(edges: DataFrame) -> DataFrame:
    """``(degree, nodes)``: how many nodes have each out-degree."""
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(
        F.count("*").alias("nodes"))
