"""Token ids packed into fixed-width matrices and written as binary columns.

Each task encodes its documents, cuts those longer than a row into pieces, and packs the pieces of a
bounded chunk by best-fit-decreasing: longest first, each into the row whose free space is the smallest
that suffices. A segment tree over the amounts of free space finds that row in logarithmic time. Nothing
is shuffled; memory is bounded by the chunk and one text.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tessera.llm.bpe import character_classes, word_starts
from tessera.llm.common import named, received, sent

ROW_TOKENS = 2_048
MATRIX_ROWS = 64
CHUNK_TOKENS = 1 << 21  # tokens that one packing looks at, at most one text more
CHUNK_DOCS = 1 << 15  # and documents, which may be empty
PART_CHARS = 1 << 14  # of a long text that are encoded at once
# A writer keeps a group of rows in memory; matrices are large, so groups are small.
GROUP_BYTES = 16 << 20
# Fixed value: how the public byte-level vocabulary breaks texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """A vocabulary of ranks; a broadcast one builds its encoder once per process."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = pattern
        self.dtype = "<u2" if max(self.ranks.values()) < 1 << 16 else "<u4"

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_encoding", "_classes")}

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, in which nothing is special; NULL counts as empty.

        The library's pattern needs a stack as deep as the longest run of white space, so a long text is cut
        before words into parts, and words longer than a part are merged without the pattern.
        """
        if "_encoding" not in self.__dict__:
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        text = text or ""
        if len(text) <= PART_CHARS:
            return np.asarray(self._encoding.encode_ordinary(text), self.dtype)
        if "_classes" not in self.__dict__:
            self._classes = character_classes()
        starts = np.append(word_starts(text, self._classes), len(text))
        out, at = [], 0
        while at < len(starts) - 1:
            lo = int(starts[at])
            end = max(at + 1, int(np.searchsorted(starts, lo + PART_CHARS, "right")) - 1)
            # the pattern leaves the last of several white spaces to the word behind them: that stays with its word
            while end - at > 1 and text[starts[end] - 1].isspace() and text[starts[end - 1] - 1].isspace():
                end -= 1
            part = text[lo:int(starts[end])]
            ids = self._encoding.encode_ordinary(part) if len(part) <= PART_CHARS else self._encoding._encode_single_piece(part)
            out.append(np.asarray(ids, self.dtype))
            at = end
        return np.concatenate(out)


class FreeSpace:
    """Segment tree over free space 0 .. width: which amounts some row has, and the rows that have them."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.any = np.zeros(2 * self.leaves, bool).tolist()
        self.rows: list[deque[int]] = [deque() for _ in range(width + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.leaves
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of the tightest row with ``need`` free, the earliest of equals; it is removed."""
        i = need + self.leaves
        while not self.any[i]:  # up until a subtree to the right has rows
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:  # down to its first leaf
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        free = i - self.leaves
        row = self.rows[free].popleft()
        if not self.rows[free]:
            while i and not (i < self.leaves and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = False
                i >>= 1
        return free, row


def best_fit(sizes: Sequence[int], width: int) -> list[int]:
    """Row of every piece, pieces taken longest first (equals in their order)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    space = FreeSpace(width)
    out = [0] * len(sizes)
    n_rows = 0
    for i in order:
        found = space.take(sizes[i])
        if found is None:
            found = (width, n_rows)
            n_rows += 1
        out[i] = found[1]
        space.add(found[0] - sizes[i], found[1])
    return out


def pieces(n_tokens: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole rows, then the rest; one empty piece if empty."""
    return [(at, min(width, n_tokens - at)) for at in range(0, n_tokens, width)] or [(0, 0)]


def position_ids(cu_seqlens: Sequence[int]) -> np.ndarray:
    """Position of every token of a flattened matrix, counted from 0 in each segment."""
    c = np.asarray(cu_seqlens, np.int64)
    return np.arange(c[-1]) - np.repeat(c[:-1], np.diff(c))


def _matrices(docs: list[tuple[object, np.ndarray]], width: int, rows: int, dtype: str, pad: int) -> Iterator[dict]:
    cut = [(key, ids, s, n) for key, ids in docs for s, n in pieces(len(ids), width)]
    place = best_fit([n for *_, n in cut], width)
    held: list[list[int]] = [[] for _ in range(max(place, default=-1) + 1)]
    for i, r in enumerate(place):
        held[r].append(i)
    for lo in range(0, len(held), rows):
        part = held[lo:lo + rows]
        ids = np.full((len(part), width), pad, dtype)
        cu, resets, segments = [0], [], []
        for r, row in enumerate(part):
            at = 0
            for i in row:
                key, source, s, n = cut[i]
                ids[r, at:at + n] = source[s:s + n]
                segments.append((key, r, at, s, n))
                resets.append(r * width + at)
                at += n
                cu.append(r * width + at)
            if at < width:  # the padding is a segment of its own
                resets.append(r * width + at)
                cu.append((r + 1) * width)
        yield {
            "n_rows": len(part), "n_tokens": sum(s[4] for s in segments), "ids": ids.tobytes(),
            "cu_seqlens": cu, "position_resets": resets, "segments": segments,
        }


def pack(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
    row_tokens: int = ROW_TOKENS, matrix_rows: int = MATRIX_ROWS, chunk_tokens: int = CHUNK_TOKENS, pad_id: int = 0,
    chunk_docs: int = CHUNK_DOCS,
) -> DataFrame:
    """One row per matrix of at most ``matrix_rows`` x ``row_tokens`` ids:

    ``vocabulary_path`` is a file of token ranks, read on the driver and broadcast. Columns: ``matrix_id``;
    ``n_rows``; ``row_tokens``; ``n_tokens`` without padding; ``id_bytes``, 2 where the vocabulary has
    at most 65,536 ids, else 4; ``ids``, the little-endian unsigned matrix; ``cu_seqlens``,
    the ends of all segments in the flattened matrix after a leading 0, the padding of a row being a
    segment; ``position_resets``, where segments begin and positions start again from 0; ``segments`` as
    (doc_id, row, at, start, length): tokens start .. start + length of a document lie in ``row`` from
    ``at``.

    Every token of every document is in exactly one segment. Texts are packed in chunks of
    ``chunk_tokens`` tokens or ``chunk_docs`` documents, whichever is reached first, so a matrix has at most
    ``chunk_docs`` segments and those of long documents. NULL and empty texts are a segment of length 0;
    texts of any length, also a single run of white space or of one letter, are encoded whole; equal rows are packed as often as they occur; other columns are not read. An empty table
    gives no matrix.
    """
    tokenizer = Tokenizer(vocabulary_path)
    dtype = tokenizer.dtype
    shared = sent(docs.sparkSession, tokenizer)
    key = StructField("doc_id", docs.schema[id_col].dataType)
    rest = StructType.fromDDL(
        "matrix_id string, n_rows int, row_tokens int, n_tokens long, id_bytes int, ids binary,"
        " cu_seqlens array<int>, position_resets array<int>"
    )
    segment = StructType([key, *StructType.fromDDL("row int, at int, start long, length int").fields])
    schema = StructType([*rest.fields, StructField("segments", ArrayType(segment))])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = received(shared, Tokenizer).encode
        task = TaskContext.get().partitionId()
        waiting: list[tuple[object, np.ndarray]] = []
        n_waiting, n_chunks = 0, 0

        def flush() -> Iterator[pd.DataFrame]:
            for k, m in enumerate(_matrices(waiting, row_tokens, matrix_rows, dtype, pad_id)):
                segments = [dict(zip(("doc_id", "row", "at", "start", "length"), s)) for s in m["segments"]]
                yield pd.DataFrame([{
                    "matrix_id": f"{task}-{n_chunks}-{k}", **m, "row_tokens": row_tokens,
                    "id_bytes": np.dtype(dtype).itemsize, "segments": segments,
                }])[schema.names]

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = encode(text)
                waiting.append((None if pd.isna(doc) else doc, ids))
                n_waiting += len(ids)
                if n_waiting >= chunk_tokens or len(waiting) >= chunk_docs:
                    yield from flush()
                    waiting, n_waiting, n_chunks = [], 0, n_chunks + 1
        if waiting:
            yield from flush()

    texts = docs.select(named(docs, id_col).alias("doc_id"), named(docs, text_col).alias("text"))
    return texts.mapInPandas(run, schema)


def token_counts(spark: SparkSession, vocabulary_path: str) -> Callable[[Column], Column]:
    """A function of a text column: the number of ids of every text, 0 for NULL."""
    shared = sent(spark, Tokenizer(vocabulary_path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = received(shared, Tokenizer).encode
        for texts in batches:
            yield pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")


def write(docs: DataFrame, path: str, vocabulary_path: str, **options) -> DataFrame:
    """``pack`` written as Parquet at ``path``; returns what was written."""
    out = pack(docs, vocabulary_path, **options)
    out.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def unpack(matrix: dict) -> list[tuple[object, int, np.ndarray]]:
    """(doc_id, start, ids) of every segment of one written matrix."""
    ids = np.frombuffer(matrix["ids"], f"<u{matrix['id_bytes']}").reshape(matrix["n_rows"], matrix["row_tokens"])
    return [(s["doc_id"], s["start"], ids[s["row"], s["at"]:s["at"] + s["length"]]) for s in matrix["segments"]]
