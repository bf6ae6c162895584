"""Keyword ranking, rank fusion, chunking and context retrieval."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scale
from tessera.functions.distance import as_col
from tessera.operators.search import arrow_types, knn_batch

# fixed values: BM25 saturation, length weight and floor for common terms; fusion constant
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
CHUNK_SIZE, CHUNK_OVERLAP = 250, 40


def tokens(text) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(as_col(text)), r"\s+"), lambda w: w != "")


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One ``(doc, token)`` row per word."""
    return docs.select(doc_id, F.explode(tokens(text)).alias("token"))


def rank_hits(
    hits: DataFrame, qid: str, score: str, doc: str, ascending: bool = True, out: str = "rank"
) -> DataFrame:
    """1-based rank of each hit within its query; hits are bounded top-k lists."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return hits.withColumn(out, F.row_number().over(Window.partitionBy(qid).orderBy(order, doc)))


def bm25(
    docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text",
    qid: str = "qid", qtext: str = "qtext",
) -> DataFrame:
    """BM25 Okapi top-k per query: ``(qid, doc, score, rank)``.

    Terms in more than half of the documents get ``epsilon`` times the mean idf instead of a
    negative weight, and the mean runs over every term of the corpus. Only documents sharing a
    term with the query are scored; the others would score 0.

    Document frequencies are combined in the map tasks, so frequent words do not grow the
    shuffle. A small query set is then scored in one scan, a large one by joins. A document whose
    text is NULL is none: it counts nowhere.
    """
    docs = docs.where(F.col(text).isNotNull())
    texts = scale.spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), "doc")
    # tokenized once: frequencies, the number of documents and the scores all read the stored words
    words = scale.cut_lineage(texts.select("doc", tokens("text").alias("words")))
    # one pass for both: the first distinct word of a document also carries its length
    each = words.select(F.size("words").alias("len"), F.posexplode(F.array_distinct("words")).alias("p", "token"))
    freq = scale.cut_lineage(each.groupBy("token").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("p") == 0, F.col("len")).otherwise(0)).alias("len")))
    stats = freq.agg(F.sum("len").alias("total"))  # one row
    n = words.count()
    idf = freq.crossJoin(F.broadcast(stats)).select(
        "token", (F.col("total") / n).alias("mean_len"),
        (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"),
    )
    mean_idf = idf.agg(F.avg("raw").alias("mean_idf"))  # one row
    asked = queries.select(F.col(qid).alias("qid"), F.explode(tokens(qtext)).alias("token"))
    asked = asked.groupBy("qid", "token").agg(F.count("*").alias("times"))
    weights = (
        idf.join(asked, "token").crossJoin(F.broadcast(mean_idf))
        .withColumn("idf", F.when(F.col("raw") < 0, F.col("mean_idf") * BM25_EPSILON).otherwise(F.col("raw")))
        .select("qid", "token", (F.col("times") * F.col("idf")).alias("w"), "mean_len")
    )
    rows = scale.bounded_rows(weights)
    fits = rows is not None and (
        len({r["qid"] for r in rows}) * len({r["token"] for r in rows}) <= scale.BROADCAST_VALUES
    )
    scored = _scores_by_scan(words, rows, k, queries.schema[qid]) if fits else _scores_by_join(words, weights)
    # equal documents must tie: drop the last digits of the float sum before ranking
    scored = scored.withColumn("score", F.round("score", 9))
    best = scale.rank_per_group_salted(scored, ["qid"], [F.desc("score"), F.col("doc")], k, "doc")
    return best.select(qid, F.col("doc").alias(doc_id), "score", "rank")


def _scores_by_join(words: DataFrame, weights: DataFrame) -> DataFrame:
    """``(qid, doc, score)`` by joining term counts with query weights, for many queries."""
    vocabulary = scale.broadcast_if_small(weights.select("token").distinct())
    tf = (
        words.select("doc", F.size("words").alias("len"), F.explode("words").alias("token"))
        .join(vocabulary, "token", "left_semi")
        .groupBy("doc", "len", "token").agg(F.count("*").alias("tf"))
    )
    length = 1 - BM25_B + BM25_B * F.col("len") / F.col("mean_len")
    part = F.col("w") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * length)
    return tf.join(weights, "token").groupBy("qid", "doc").agg(F.sum(part).alias("score"))


def _scores_by_scan(words: DataFrame, weights: list[Row], k: int, qfield: T.StructField) -> DataFrame:
    """The best k ``(qid, doc, score)`` of every task, for a query set proven small.

    A task turns its documents into a saturated term matrix and multiplies it with the query
    weights, so no posting is ever shuffled.
    """
    qids = sorted({r["qid"] for r in weights})
    terms = sorted({r["token"] for r in weights})
    qpos, tpos = {q: i for i, q in enumerate(qids)}, {w: i for i, w in enumerate(terms)}
    w = np.zeros((len(terms), len(qids)))
    asks = np.zeros((len(terms), len(qids)), dtype=np.float32)
    for r in weights:
        w[tpos[r["token"]], qpos[r["qid"]]] = r["w"]
        asks[tpos[r["token"]], qpos[r["qid"]]] = 1
    mean_len = weights[0]["mean_len"] if weights else 1.0
    sent = words.sparkSession.sparkContext.broadcast((qids, terms, w, asks, mean_len))
    qtype, dtype = arrow_types(qfield, words.schema["doc"])
    step = max(2_000_000 // max(len(terms), len(qids), 1), 1)

    def scan(batches):
        names, vocab, wm, am, mean = sent.value
        vocab, best = pa.array(vocab, pa.string()), {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, b.num_rows if names else 0, step):
                col = b.column(1).slice(s, step)
                size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(size)), size)
                code = pc.fill_null(pc.index_in(col.flatten(), value_set=vocab), -1).to_numpy()
                tf = np.zeros((len(size), len(vocab)))
                np.add.at(tf, (at[code >= 0], code[code >= 0]), 1.0)
                norm = BM25_K1 * (1 - BM25_B + BM25_B * size / mean)
                # the sum's last digits depend on its order: equal documents must tie
                score = np.round((tf * (BM25_K1 + 1) / (tf + norm[:, None])) @ wm, 9)
                shares = ((tf > 0).astype(np.float32) @ am) > 0
                doc = ids[s : s + step]
                for j in range(len(names)):
                    hit = np.flatnonzero(shares[:, j])
                    key, cand = -score[hit, j], doc[hit]
                    if j in best:
                        key, cand = np.concatenate([best[j][0], key]), np.concatenate([best[j][1], cand])
                    top = np.lexsort((cand, key))[:k]
                    best[j] = (key[top], cand[top])
        for j, (key, cand) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[j]] * len(cand), qtype), pa.array(cand, dtype), pa.array(-key)],
                ["qid", "doc", "score"],
            )

    fields = f"qid {qfield.dataType.simpleString()}, doc {words.schema['doc'].dataType.simpleString()}, score double"
    return words.select("doc", "words").mapInArrow(scan, fields)


def vec_rank(
    docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", vec: str = "embedding"
) -> DataFrame:
    """L2 ranking of the same documents by a given embedding column."""
    return knn_batch(docs, queries, k, "l2", doc_id, vec).select("qid", doc_id, "dist", "rank")


def rrf(
    rankings: Sequence[DataFrame], qid: str = "qid", doc_id: str = "doc_id", k: int = RRF_K
) -> DataFrame:
    """Reciprocal rank fusion: ``sum(1 / (k + rank))`` over the rankings."""
    parts = [r.select(qid, doc_id, (F.lit(1.0) / (k + F.col("rank"))).alias("_s")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(qid, doc_id).agg(F.sum("_s").alias("score"))


SEPARATORS = ("\n\n", "\n", " ")


def split_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that fits.

    Every chunk after the first starts ``overlap`` characters (or fewer, at a word start) before
    the end of the previous one. Text without separators is cut at ``size``.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            for sep in SEPARATORS:
                cut = text.rfind(sep, start + overlap + 1, end)
                if cut > 0:
                    end = cut + len(sep)
                    break
        out.append(text[start:end])
        if end >= n:
            break
        back = max(end - overlap, start + 1)
        word = text.find(" ", back, end)
        start = word + 1 if 0 <= word < end - 1 else back
    return out


def chunk_text(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """``(doc, chunk_no, chunk)``: each document cut into overlapping chunks."""

    def cut(col: pa.Array) -> pa.Array:
        return pa.array(
            [None if s is None else split_chunks(s, size, overlap) for s in col.to_pylist()],
            pa.list_(pa.string()),
        )

    chunks = F.arrow_udf(cut, "array<string>")(F.col(text))
    return scale.spread(docs, doc_id).select(doc_id, F.posexplode(chunks).alias("chunk_no", "chunk"))


def retrieve_context(
    chunks: DataFrame, queries: DataFrame, k: int = 3, chunk_id: str = "chunk_id",
    vec: str = "embedding",
) -> DataFrame:
    """The k nearest chunks per question with their text."""
    best = knn_batch(chunks, queries, k, "l2", chunk_id, vec)
    return best.join(chunks.drop(vec), chunk_id)
