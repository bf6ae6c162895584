"""Packing into length buckets whose boundaries waste the least padding.

The lengths of all documents are counted. Dynamic programming over that histogram finds the boundaries
for which padding every document up to its bucket's boundary costs least. Inside a bucket, batches take
as many documents as a token budget allows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import named, words
from tessera.llm.rows import FILE, ROW, located, written

N_BUCKETS = 16
BATCH_TOKENS = 65_536
# Batches that one task numbers together; a bucket has as many slices as its size asks for.
BATCHES_PER_SLICE = 64


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], k: int) -> list[int]:
    """At most ``k`` of the ascending ``lengths`` as bucket boundaries with the least total padding.

    With prefix counts C and sums S, a bucket of lengths i+1 .. j costs L[j] (C[j] - C[i]) - (S[j] - S[i]):
    for each i a line in L[j] with slope -C[i]. Slopes fall and the L[j] rise, so the lowest line is kept
    in a queue and one round takes linear time. Exact, in integers; of equal costs the lower cut wins.
    """
    m = len(lengths)
    if not m:
        return []
    C, S = [0], [0]
    for length, n in zip(lengths, counts):
        C.append(C[-1] + n)
        S.append(S[-1] + n * length)
    cost = [0] + [lengths[j - 1] * C[j] - S[j] for j in range(1, m + 1)]  # one bucket
    cuts = [[0] * (m + 1)]
    for _ in range(min(k, m) - 1):
        queue: deque[tuple[int, int, int]] = deque()  # slope, intercept, i
        new, cut = [0] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            slope, start = -C[i], cost[i] + S[i]
            while len(queue) > 1:
                (s1, b1, _), (s2, b2, _) = queue[-2], queue[-1]
                if (start - b1) * (s1 - s2) < (b2 - b1) * (s1 - slope):
                    queue.pop()
                else:
                    break
            queue.append((slope, start, i))
            x = lengths[j - 1]
            while len(queue) > 1 and queue[1][0] * x + queue[1][1] < queue[0][0] * x + queue[0][1]:
                queue.popleft()
            slope, start, cut[j] = queue[0]
            new[j] = slope * x + start + x * C[j] - S[j]
        cuts.append(cut)
        cost = new
    out, j = [], m
    for cut in reversed(cuts):
        if j:
            out.append(lengths[j - 1])
            j = cut[j]
    return out[::-1]


def pack(
    docs: DataFrame, n_tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch_id, slot), one row per row of ``docs``.

    ``n_tokens`` is the length of a document, by default its number of words (NULL: 0). ``bucket``
    counts from 0 by ascending boundary, and ``padded_length`` is that boundary. A batch of a bucket
    holds floor(batch_tokens / padded_length) documents, the last one of a slice maybe fewer; ``slot``
    counts from 0 in a batch. Documents longer than ``batch_tokens`` are in no bucket: ``bucket`` is -1
    and each is a batch of its own, without padding. Equal rows are packed as often as they occur; an
    empty table gives an empty result.

    The driver gets the histogram, at most batch_tokens + 1 rows. A bucket is cut by a hash of the
    row's place into slices that tasks number one by one, so a bucket of any size is spread.
    """
    rows = located(docs)
    count = F.size(words(named(rows, text_col))) if n_tokens is None else F.coalesce(n_tokens, F.lit(0))
    sized = written(rows.select(named(rows, id_col).alias("doc_id"), FILE, ROW, count.cast("long").alias("n_tokens")), "lengths")
    histogram = (
        sized.where(F.col("n_tokens") <= batch_tokens).groupBy("n_tokens").agg(F.count("*").alias("n"))
        .orderBy("n_tokens").collect()
    )
    lengths, counts = [r["n_tokens"] for r in histogram], [r["n"] for r in histogram]
    bounds = best_boundaries(lengths, counts, n_buckets)
    fits = [batch_tokens // max(b, 1) for b in bounds]
    held = [0] * len(bounds)
    b = 0
    for length, n in zip(lengths, counts):
        b += length > bounds[b]
        held[b] += n
    slices = [-(-n // (f * BATCHES_PER_SLICE)) for n, f in zip(held, fits)]
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("bucket"))
    long = sized.where(F.col("n_tokens") > batch_tokens).select(
        "doc_id", "n_tokens", F.lit(-1).alias("bucket"), F.col("n_tokens").alias("padded_length"),
        F.concat(F.lit("long-"), F.md5(F.concat_ws(":", FILE, ROW))).alias("batch_id"), F.lit(0).alias("slot"),
    )
    if not bounds:
        return long
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda x: x < F.col("n_tokens")))
    placed = sized.where(F.col("n_tokens") <= batch_tokens).withColumn("bucket", bucket)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64(FILE, ROW), pick(slices).cast("long")))
    order = Window.partitionBy("bucket", "slice").orderBy("n_tokens", "doc_id", FILE, ROW)
    nth = placed.withColumn("nth", F.row_number().over(order) - 1)
    short = nth.select(
        "doc_id", "n_tokens", "bucket", pick(bounds).cast("long").alias("padded_length"),
        F.concat_ws("-", "bucket", "slice", F.floor(F.col("nth") / pick(fits))).alias("batch_id"),
        (F.col("nth") % pick(fits)).cast("int").alias("slot"),
    )
    return short.unionByName(long)
