"""Keyword ranking over a stored index: postings in blocks of documents, with the best any of a block can score.

The index is written once; a search reads no text. Blocks whose best possible score for a query stays below
that of k documents already scored are never opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scale
from tessera.operators.hybrid import BM25_B, BM25_EPSILON, BM25_K1, tokens

BLOCK_DOCS = 4_096
# A block ends earlier once it has this many words.
BLOCK_WORDS = 2_000_000
# Blocks per query that are scored first, those that promise most; their k-th score is the bar for the rest.
FIRST_BLOCKS = 2
# Sums of the same numbers in another order differ by less.
SLACK = 1e-6


@dataclass(frozen=True)
class Postings:
    """A stored index: ``blocks`` (token, block, n, best, docs, tfs, lens), ``terms`` (token, df, idf), one row of totals."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    mean_len: float


def _saturated(tf, length, mean_len: float):
    """What one word adds to a document's score, without its weight."""
    norm = BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(float(mean_len)))
    return tf * (BM25_K1 + 1) / (tf + norm)


def _block_postings(words: pa.Array, docs: pa.Array, block: int, mean_len: float) -> pa.RecordBatch:
    """The postings of one block: rows (token, block, n, best, docs, tfs, lens) from its documents' words."""
    lens = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    # rows of equal id and length count as one document
    rows = docs.dictionary_encode()
    pairs, doc_of = np.unique(np.stack([rows.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens]), axis=1, return_inverse=True)
    each = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * pairs.shape[1] + np.repeat(doc_of.ravel(), lens)
    keys, tf = np.unique(each, return_counts=True)
    word, doc = np.divmod(keys, pairs.shape[1])
    length = pairs[1][doc]
    factor = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_len))
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    ends = np.append(starts, len(word))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
    return pa.RecordBatch.from_arrays(
        [
            flat.dictionary.take(pa.array(word[starts])), pa.array(np.full(len(starts), block, np.int64)), pa.array(np.diff(ends)),
            pa.array(np.maximum.reduceat(factor, starts)), listed(rows.dictionary.take(pa.array(pairs[0][doc]))),
            listed(pa.array(tf, pa.int32())), listed(pa.array(length, pa.int32())),
        ],
        ["token", "block", "n", "best", "docs", "tfs", "lens"],
    )


def write_postings(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS
) -> Postings:
    """Build the index at ``path``: ``blocks``, ``terms`` and ``totals``.

    Texts are dealt out once, by ranges of their ids; a task cuts its documents, in order of ids, into blocks of
    up to ``block_docs`` and counts the words of a block, so no word leaves its task alone. The postings of a
    word in one block are one row, so a word that every document has is many rows in many tasks. Every file is
    sorted by word, so a search reads only the pages of its words. A document whose text is NULL is none.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.size(tokens("text"))).alias("mean_len")).head()
    n_docs, mean_len = totals["n"], float(totals["mean_len"] or 1.0)
    dealt = rows.where(F.col("doc").isNotNull()).repartitionByRange("doc").sortWithinPartitions("doc")

    def build(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0  # batches of the block that is being filled, its documents

        def cut():
            both = pa.Table.from_batches(held).combine_chunks()
            return _block_postings(both["words"].combine_chunks(), both["doc"].combine_chunks(), first + made, mean_len)

        last = None
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(1)), 0))
            while b.num_rows:
                names = b.column(0).to_pylist()
                change = np.array([x != y for x, y in zip(names, [last, *names])])  # rows of one id stay together
                number = size + np.cumsum(change)
                words = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)) + sum(len(h.column(1).flatten()) for h in held)
                over = np.flatnonzero(change & ((number > block_docs) | ((words > BLOCK_WORDS) & (number > 1))))
                n = int(over[0]) if len(over) else b.num_rows
                if n:
                    held.append(b.slice(0, n))
                    size, last = int(number[n - 1]), names[n - 1]
                b = b.slice(n)
                if b.num_rows:
                    yield cut()
                    made += 1
                    held, size, last = [], 0, None
        if held:
            yield cut()

    doc = rows.schema["doc"].dataType.simpleString()
    schema = f"token string, block long, n long, best double, docs array<{doc}>, tfs array<int>, lens array<int>"
    stored = dealt.select("doc", tokens("text").alias("words")).mapInArrow(build, schema)
    stored.sortWithinPartitions("token", "block").write.parquet(f"{path}/blocks")
    df = spark.read.parquet(f"{path}/blocks").groupBy("token").agg(F.sum("n").alias("df"))
    raw = df.select("token", "df", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw = scale.cut_lineage(raw)
    mean_idf = raw.agg(F.avg("raw")).head()[0]  # one row
    idf = F.when(F.col("raw") < 0, F.lit(mean_idf) * BM25_EPSILON).otherwise(F.col("raw"))
    raw.select("token", "df", idf.alias("idf")).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/terms")
    spark.createDataFrame([(n_docs, mean_len)], "n_docs long, mean_len double").write.parquet(f"{path}/totals")
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    totals = spark.read.parquet(f"{path}/totals").head()
    return Postings(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), totals["n_docs"], totals["mean_len"])


def weights_of(index: Postings, queries: DataFrame, qid: str = "qid", qtext: str = "qtext") -> DataFrame:
    """``(qid, token, w)``: the weight of every word of a query that the index has."""
    asked = queries.select(F.col(qid).alias("qid"), F.explode(tokens(qtext)).alias("token"))
    asked = asked.groupBy("qid", "token").agg(F.count("*").alias("times"))
    # a small set of words is pushed down to the sorted files
    words = scale.bounded_rows(asked.select("token").distinct(), 1_000)
    terms = index.terms if words is None else index.terms.where(F.col("token").isin([r["token"] for r in words]))
    joined = terms.join(scale.broadcast_if_small(asked), "token")
    return joined.select("qid", "token", (F.col("times") * F.col("idf")).alias("w"))


def block_bounds(index: Postings, weights: DataFrame) -> DataFrame:
    """``(qid, block, bound)``: no document of the block scores more. Reads no postings, only their bests."""
    bests = index.blocks.select("token", "block", "best").join(scale.broadcast_if_small(weights), "token")
    return bests.groupBy("qid", "block").agg(F.sum(F.greatest(F.col("w") * F.col("best"), F.lit(0.0))).alias("bound"))


def _scored(index: Postings, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(qid, doc, score)`` of the documents in the chosen ``(qid, block)`` that share a word with the query."""
    wanted = scale.broadcast_if_small(chosen.select("qid", "block").join(weights, "qid"))
    opened = index.blocks.select("token", "block", "docs", "tfs", "lens").join(wanted, ["token", "block"])
    each = opened.select("qid", "w", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
    part = F.col("w") * _saturated(F.col("p.tfs"), F.col("p.lens"), index.mean_len)
    # equal documents must tie: drop the last digits of the float sum
    return each.groupBy("qid", F.col("p.docs").alias("doc")).agg(F.round(F.sum(part), 9).alias("score"))


def _scored_in_blocks(index: Postings, weights: list[Row], chosen: list[Row], k: int, qid: T.StructField) -> DataFrame:
    """:func:`_scored` for a query set proven small: the best ``k`` per query and block.

    ``chosen``: rows (block, qids). A task turns the postings of one block into a matrix of at most ``BLOCK_DOCS`` documents and multiplies it
    with the query weights, so no posting is repeated per query.
    """
    spark = index.blocks.sparkSession
    qids, terms = sorted({r["qid"] for r in weights}), sorted({r["token"] for r in weights})
    qpos, tpos = {q: i for i, q in enumerate(qids)}, {w: i for i, w in enumerate(terms)}
    w, asks = np.zeros((len(terms), len(qids))), np.zeros((len(terms), len(qids)), np.float32)
    for r in weights:
        w[tpos[r["token"]], qpos[r["qid"]]] = r["w"]
        asks[tpos[r["token"]], qpos[r["qid"]]] = 1
    by = {r["block"]: [qpos[q] for q in r["qids"]] for r in chosen}
    sent = spark.sparkContext.broadcast((qids, w, asks, by, index.mean_len))
    doc = index.blocks.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("qid", qid.dataType), T.StructField("doc", doc), T.StructField("score", T.DoubleType())])
    numbered = spark.createDataFrame([(t, i) for t, i in tpos.items()], "token string, t int") if terms else None
    if numbered is None or not by:
        return spark.createDataFrame([], schema)
    opened = index.blocks.select("token", "block", "docs", "tfs", "lens").join(F.broadcast(numbered), "token")
    blocks = spark.createDataFrame([(b,) for b in by], "block long")
    opened = opened.join(F.broadcast(blocks), "block").drop("token")

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        names, wm, am, of, mean = sent.value
        asking = np.array(of[int(rows["block"].iloc[0])])
        size = rows["docs"].map(len).to_numpy()
        docs, at = np.unique(np.concatenate(rows["docs"].to_list()), return_inverse=True)
        tf, length = (np.concatenate(rows[c].to_list()).astype(float) for c in ("tfs", "lens"))
        norm = BM25_K1 * (1 - BM25_B + BM25_B * length / mean)
        m = np.zeros((len(docs), len(rows)))
        m[at, np.repeat(np.arange(len(rows)), size)] = tf * (BM25_K1 + 1) / (tf + norm)
        t = rows["t"].to_numpy()
        # the sum's last digits depend on its order: equal documents must tie
        found = np.round(m @ wm[np.ix_(t, asking)], 9)
        shares = ((m > 0).astype(np.float32) @ am[np.ix_(t, asking)]) > 0
        out = []
        for j, q in enumerate(asking):
            hit = np.flatnonzero(shares[:, j])
            best = hit[np.lexsort((docs[hit], -found[hit, j]))[:k]]
            out.append(pd.DataFrame({"qid": [names[q]] * len(best), "doc": docs[best], "score": found[best, j]}))
        return pd.concat(out)

    return opened.groupBy("block").applyInPandas(score, schema)


def bm25_search(
    index: Postings, queries: DataFrame, k: int, qid: str = "qid", qtext: str = "qtext", doc_id: str = "doc_id", first: int = FIRST_BLOCKS
) -> DataFrame:
    """BM25 top-k per query: ``(qid, doc, score, rank)``, the same as :func:`hybrid.bm25` over the documents.

    A query first scores its ``first`` most promising blocks; of the others it opens those whose bound
    reaches the k-th score found so far.
    """
    return search_steps(index, queries, k, qid, qtext, doc_id, first)[0]


def search_steps(
    index: Postings, queries: DataFrame, k: int, qid: str = "qid", qtext: str = "qtext", doc_id: str = "doc_id", first: int = FIRST_BLOCKS
) -> tuple[DataFrame, DataFrame]:
    """(result of :func:`bm25_search`, the ``(qid, block, bound, opened)`` it decided on)."""
    weights = scale.cut_lineage(weights_of(index, queries, qid, qtext))
    bounds = scale.cut_lineage(block_bounds(index, weights))
    ahead = scale.rank_per_group(bounds, ["qid"], [F.desc("bound"), F.col("block")], first).drop("rank")
    order = [F.desc("score"), F.col("doc")]
    rows = scale.bounded_rows(weights)
    small = rows is not None and len({r["qid"] for r in rows}) * len({r["token"] for r in rows}) <= scale.BROADCAST_VALUES

    def scored(wanted: DataFrame) -> DataFrame:
        # a pair is one number to every task; beyond the bound each posting meets the queries that ask for it
        if not small or wanted.count() > scale.BROADCAST_VALUES:
            return _scored(index, weights, wanted)
        asking = wanted.groupBy("block").agg(F.collect_list("qid").alias("qids")).collect()
        return _scored_in_blocks(index, rows, asking, k, weights.schema["qid"])

    top = scale.cut_lineage(scale.rank_per_group_salted(scored(ahead), ["qid"], order, k, "doc"))
    bar = top.where(F.col("rank") == k).select("qid", F.col("score").alias("bar"))
    behind = bounds.join(ahead.select("qid", "block"), ["qid", "block"], "left_anti").join(scale.broadcast_if_small(bar), "qid", "left")
    reach = scale.cut_lineage(behind.where(F.col("bar").isNull() | (F.col("bound") + SLACK >= F.col("bar"))).drop("bar"))
    both = top.drop("rank").unionByName(scored(reach))
    best = scale.rank_per_group_salted(both, ["qid"], order, k, "doc")
    chosen = ahead.select("qid", "block").unionByName(reach.select("qid", "block")).withColumn("opened", F.lit(True))
    steps = bounds.join(chosen, ["qid", "block"], "left").withColumn("opened", F.coalesce("opened", F.lit(False)))
    return best.select(F.col("qid").alias(qid), F.col("doc").alias(doc_id), "score", "rank"), steps


__all__ = ["Postings", "block_bounds", "bm25_search", "read_postings", "search_steps", "weights_of", "write_postings"]
