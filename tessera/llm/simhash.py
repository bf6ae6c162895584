"""SimHash near-duplicates by a byte-position index with count filtering.

Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8 bytes in place. The index
holds, for every choice of four of the first seven byte positions, the bytes there: a pair that shares
five of eight bytes shares four of those seven, so it meets in some posting list. Pairs are tallied
(how many bytes they share in place), kept from five on, and verified bit by bit. A pair counts only in
the first list it meets in, so nothing is found twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_words, named
from tessera.llm.components import components
from tessera.llm.rows import FILE, ROW, located, without, written

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BYTES = 8
INDEX_BYTES = 4  # bytes of a posting list's key


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    ws = byte_words(text)
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, ws), np.int64, len(ws))
        end = np.cumsum(size + 1) - 1
        starts, ends = (end - size)[: len(ws) - shingle + 1].tolist(), end[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    seed = HASH_SEED
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(h[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE_WORDS, out: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long in ``out``."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(fps.view(np.int64))

    rest = [named(docs, c) for c in docs.columns if c != text_col]
    return docs.select(*rest, run(named(docs, text_col)).alias(out))


def links(fps: DataFrame, max_bits: int = MAX_BITS, index_bytes: int = INDEX_BYTES, col: str = "fp") -> DataFrame:
    """(a, b): all pairs of distinct fingerprints in ``fps`` that differ in at most ``max_bits``.

    ``max_bits`` differing bits touch at most as many bytes, so a pair shares ``need`` = 8 - max_bits
    bytes in place, and ``index_bytes`` of any 8 - need + index_bytes positions. Longer keys mean more
    index rows and shorter lists; every length gives the same pairs. Lists are joined as sorted
    streams, and a long one is split by the skew join.
    """
    need = BYTES - max_bits
    if not 1 <= index_bytes <= need:
        raise ValueError(f"index_bytes must be 1 to {need}")
    chosen = list(combinations(range(BYTES - need + index_bytes), index_bytes))

    def key(number: int, places: tuple[int, ...]) -> str:
        parts = [f"shiftleft(shiftrightunsigned(fp, {8 * p}) & 255L, {8 * i})" for i, p in enumerate(places)]
        return f"named_struct('l', {number}, 'k', {' | '.join(parts)})"

    # few bytes become many index rows: spread them first
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select(F.col(col).alias("fp")).distinct().repartition(parts)
    index = distinct.select("fp", F.explode(F.expr(
        "array(" + ", ".join(key(n, places) for n, places in enumerate(chosen)) + ")"
    )).alias("key")).select("key.l", "key.k", "fp")
    # per list: its own positions, and all positions up to its last one
    own = [sum(1 << p for p in places) for places in chosen]
    upto = [(1 << (places[-1] + 1)) - 1 for places in chosen]
    literal = lambda xs: "array(" + ", ".join(map(str, xs)) + ")"
    shared = " + ".join(f"if((x.fp ^ y.fp) & {255 << 8 * p if p < 7 else -(1 << 56)}L = 0, {1 << p}, 0)" for p in range(BYTES))
    # the planner can't see how many rows the index makes of a fingerprint, so it must not broadcast it
    pairs = index.alias("x").hint("merge").join(
        index.alias("y"),
        F.expr(
            f"x.l = y.l and x.k = y.k and x.fp < y.fp and bit_count({shared}) >= {need}"
            f" and bit_count(x.fp ^ y.fp) <= {max_bits}"
            f" and ({shared}) & get({literal(upto)}, x.l) = get({literal(own)}, x.l)"
        ),
    )
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _grouped(rows: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, place, fp, component_id, keep) of located rows: ``keep`` is true in one of each component."""
    fps = written(
        fingerprints(rows.select(named(rows, id_col).alias("doc_id"), FILE, ROW, named(rows, text_col).alias("text")),
                     "text", shingle),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", FILE, ROW))
    nodes = fps.groupBy("fp").agg(first.alias("first"))
    found = components(links(nodes, max_bits))
    placed = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    placed = written(placed, "classes")
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    classes = placed.join(best, "root").select("fp", "best")
    mine = F.struct(FILE, ROW) == F.struct(F.col("best")[FILE], F.col("best")[ROW])
    return fps.join(classes, "fp").select(
        "doc_id", FILE, ROW, "fp", F.col("best")["doc_id"].alias("component_id"), mine.alias("keep")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, keep), one row per row of ``docs``.

    Words break at ASCII white space, A-Z is lower-cased, shorter texts are one shingle, and texts
    without words (NULL, empty, blank) have fingerprint 0 and link like any other. ``component_id`` is
    the smallest id reachable over links of at most ``max_bits`` differing bits (NULL ids come last);
    ``keep`` marks one row of every component, its smallest id, of equal ids the first by file and row.
    Copies share one fingerprint and are never paired. All shingles of a text of any length count, in
    bounded steps. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _grouped(located(docs), id_col, text_col, shingle, max_bits).select("doc_id", hexed, "component_id", "keep")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with one row of every component of ``near_duplicates``, all columns as they are."""
    rows = located(docs)
    marked = written(_grouped(rows, id_col, text_col, shingle, max_bits), "near-duplicates")
    return without(rows, marked.where(~F.col("keep")))
