"""Scalar, product and 1-bit vector codes.

Training runs as Spark aggregations and ends in a small codec object (parameters only: its size
depends on dimension and code width, not on the table). Encoding and decoding are Arrow UDFs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scale
from tessera.functions.distance import as_col
from tessera.functions.vectorstats import dim_stats, dimension
from tessera.operators import kernels
from tessera.operators.search import sample_queries


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A (rows, width) matrix as an Arrow list column."""
    n, d = x.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), type=kind))


class Codec:
    """Shared column forms; subclasses give ``codes``, ``vectors``, the number of codes of a vector and
    the bits of a code.

    Codes are stored packed: half a byte for up to 4 bits, one byte for up to 8, else two bytes.
    """

    width: int
    code_bits: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    @property
    def code_bytes(self) -> int:
        """Stored bytes of one vector."""
        return -(-self.width // 2) if self.code_bits <= 4 else self.width * (1 if self.code_bits <= 8 else 2)

    def pack(self, codes: np.ndarray) -> pa.Array:
        """Code matrix as a binary column; of two codes in a byte the first is in the low half."""
        c = np.asarray(codes).astype(np.uint16)
        if self.code_bits <= 4:
            c = np.hstack([c, np.zeros((len(c), self.width % 2), np.uint16)]).astype(np.uint8)
            raw = c[:, 0::2] | c[:, 1::2] << 4
        else:
            raw = np.ascontiguousarray(c.astype(np.uint8 if self.code_bits <= 8 else "<u2")).view(np.uint8)
        ends = np.arange(0, (len(c) + 1) * self.code_bytes, self.code_bytes, dtype=np.int32)
        return pa.Array.from_buffers(
            pa.binary(), len(c), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])

    def unpack(self, col: pa.Array) -> np.ndarray:
        """The code matrix of a binary column."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), self.code_bytes)
        if self.code_bits <= 4:
            out = np.empty((len(raw), 2 * self.code_bytes), np.int64)
            out[:, 0::2], out[:, 1::2] = raw & 15, raw >> 4
            return out[:, : self.width]
        return (raw if self.code_bits <= 8 else raw.view("<u2")).astype(np.int64)

    def encode(self, vec: Column | str) -> Column:
        """Packed codes of a vector column."""
        f = lambda col: self.pack(self.codes(kernels.matrix(col, self.dim)))
        return F.arrow_udf(f, "binary")(as_col(vec))

    def unpacked(self, codes: Column | str) -> Column:
        """``array<smallint>`` of a packed code column."""
        f = lambda col: _lists(self.unpack(col), pa.int16())
        return F.arrow_udf(f, "array<smallint>")(as_col(codes))

    def decode(self, codes: Column | str) -> Column:
        """``array<double>`` approximations of a code column."""
        f = lambda col: _lists(self.vectors(self.unpack(col)), pa.float64())
        return F.arrow_udf(f, "array<double>")(as_col(codes))


# ---------------------------------------------------------------- scalar codes


@dataclass(frozen=True)
class ScalarCodec(Codec):
    """Uniform levels between a minimum and a maximum, per dimension or one pair for all."""

    lo: np.ndarray
    step: np.ndarray
    bits: int

    @property
    def top(self) -> int:
        return (1 << self.bits) - 1

    @property
    def width(self) -> int:
        return len(self.lo)

    @property
    def dim(self) -> int:
        return len(self.lo)

    @property
    def code_bits(self) -> int:
        return self.bits

    def codes(self, x):
        # np.rint rounds halves to even
        return np.clip(np.rint((x - self.lo) / self.step), 0, self.top)

    def vectors(self, codes):
        return self.lo + codes * self.step

    def tables(self, q: Sequence[float]) -> np.ndarray:
        """Squared distance of each query coordinate to each level: (dim, levels)."""
        levels = self.lo[:, None] + np.arange(self.top + 1)[None, :] * self.step[:, None]
        return (np.asarray(q, dtype=np.float64)[:, None] - levels) ** 2


ZERO_STEP = 1e-8  # fixed value: step of a dimension without spread


def sq_params(vectors: DataFrame, bits: int = 8, shared: bool = False, vec: str = "embedding") -> DataFrame:
    """Trained parameters ``(pos, lo, step)``; the same pair in each row when ``shared``."""
    s = dim_stats(vectors, None, vec).select("pos", "lo", "hi")
    if shared:
        one = s.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))  # one row
        s = s.select("pos").crossJoin(F.broadcast(one))
    step = (F.col("hi") - F.col("lo")) / float((1 << bits) - 1)
    return s.select("pos", "lo", F.when(step == 0, F.lit(ZERO_STEP)).otherwise(step).alias("step"))


def sq_train(vectors: DataFrame, bits: int = 8, shared: bool = False, vec: str = "embedding") -> ScalarCodec:
    """Codec from the table's extremes; one row per dimension reaches the driver."""
    rows = sorted(sq_params(vectors, bits, shared, vec).collect(), key=lambda r: r["pos"])
    return ScalarCodec(np.array([r["lo"] for r in rows]), np.array([r["step"] for r in rows]), bits)


def lut_distance(codes: Column | str, codec: Codec, q: Sequence[float]) -> Column:
    """Sum of table entries selected by each code: squared distance without decoding."""
    tables = codec.tables(q)
    rows = np.arange(len(tables))

    def look_up(col: pa.Array) -> pa.Array:
        return pa.array(tables[rows[None, :], codec.unpack(col)].sum(axis=1))

    return F.arrow_udf(look_up, "double")(as_col(codes))


# ---------------------------------------------------------------- k-means in sub-spaces


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center per row; the lowest index wins a tie."""
    return kernels.nearest_few(x, centers)[:, 0]


def training_rows(vectors: DataFrame, fraction: float, seed: int, id_col: str) -> DataFrame:
    """The rows to train on: all, or a share picked by a hash of the id."""
    if fraction >= 1.0:
        return vectors
    h = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000))
    return vectors.where(h < int(fraction * 1_000_000))


def _add_arrays(batches):
    """Sums of the arrays of equal (part, center) in a task; holds one array per center it meets."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        for p, j, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(),
                              kernels.matrix(b.column(4)), strict=True):
            if (p, j) in held:
                held[p, j][0] += n
                held[p, j][1] += x
            else:
                held[p, j] = [n, x.copy()]
    if held:
        keys = np.array(list(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.zeros(len(keys), np.int32)),
             pa.array([float(v[0]) for v in held.values()]), _lists(np.stack([v[1] for v in held.values()]), pa.float64())],
            ["part", "center", "salt", "n", "total"],
        )


def _two_levels(
    vectors: DataFrame, k: int, parts: int, rounds: int, seed: int, id_col: str, vec: str, fraction: float,
    unit: bool = False,
) -> np.ndarray:
    """Centers for any k: coarse cells first, then the centers of each cell.

    Every part is trained on its own slice of the vectors. A cell gets centers in proportion to its
    rows, one at least; its k-means runs like any other, on the rows of the cell.
    """
    d = dimension(vectors, vec)
    width = d // parts
    rows = training_rows(scale.of_dimension(vectors, vec, d), fraction, seed, id_col)
    out = []
    for p in range(parts):
        piece = rows.select(id_col, F.slice(vec, p * width + 1, width).alias(vec))
        coarse = lloyd(piece, max(int(np.sqrt(k)), 1), 1, rounds, seed, id_col, vec, 1.0, None, unit)[0]
        sent = vectors.sparkSession.sparkContext.broadcast(coarse)

        placed = scale.cut_lineage(piece.withColumn("_cell", _cell_of(sent, vec)))
        sizes = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
        share = _shares(sizes, k)
        cells = [
            lloyd(placed.where(F.col("_cell") == c), share[c], 1, rounds, seed, id_col, vec, 1.0, None, unit)[0]
            for c in sorted(share)
        ]
        out.append(np.concatenate(cells))
    if len({len(c) for c in out}) > 1:
        raise ValueError(f"parts got {sorted(len(c) for c in out)} centers")
    return np.stack(out)


def _cell_of(sent, vec: str) -> Column:
    def number(col: pa.Array) -> pa.Array:
        return pa.array(nearest(kernels.matrix(col, sent.value.shape[1]), sent.value).astype(np.int32))

    return F.arrow_udf(number, "int")(F.col(vec))


def _shares(sizes: dict[int, int], k: int) -> dict[int, int]:
    """Exactly min(k, rows) centers over cells: in proportion to their rows, no more than rows.

    A cell gets one at least while there are enough for all, the largest cells first otherwise; what
    rounding leaves over or short is settled at the cells whose share is farthest from its due.
    """
    total = sum(sizes.values())
    k = min(k, total)
    by_rows = sorted(sizes, key=lambda c: (-sizes[c], c))
    if k <= len(by_rows):
        return {c: 1 for c in by_rows[:k]}
    due = {c: k * n / total for c, n in sizes.items()}
    share = {c: max(1, min(sizes[c], int(due[c]))) for c in by_rows}
    over = sum(share.values()) - k
    while over > 0:
        c = max((c for c in by_rows if share[c] > 1), key=lambda c: share[c] - due[c])
        share[c] -= 1
        over -= 1
    while over < 0:
        c = max((c for c in by_rows if share[c] < sizes[c]), key=lambda c: due[c] - share[c])
        share[c] += 1
        over += 1
    return share


def lloyd(
    vectors: DataFrame, k: int, parts: int = 1, rounds: int = 8, seed: int = 42,
    id_col: str = "id", vec: str = "embedding", fraction: float = 1.0,
    start: np.ndarray | None = None, unit: bool = False,
) -> np.ndarray:
    """k-means in each of ``parts`` equal sub-spaces at once: centers (parts, k, dim/parts).

    Every round is one scan: tasks assign their rows and emit one array of sums per part and
    center that got rows; arrays of a center are added in two steps, the first salted by task, so
    no task adds all tasks' arrays. Empty clusters restart from spare seeded rows. The centers
    return to the driver, k * d numbers; beyond the broadcast bound training takes two levels:
    about sqrt(k) coarse cells, then the centers of each cell from its own rows. ``unit`` scales centers
    to length 1 after every round (spherical k-means of unit vectors).
    """
    d = dimension(vectors, vec)
    if d % parts:
        raise ValueError(f"{parts} parts do not divide {d} dimensions")
    if k * d > scale.BROADCAST_VALUES:
        return _two_levels(vectors, k, parts, rounds, seed, id_col, vec, fraction, unit)
    vectors = scale.of_dimension(vectors, vec, d)
    train = training_rows(vectors, fraction, seed, id_col).select(id_col, vec)
    seeds = sample_queries([train], 2 * k, seed, id_col, vec).collect()  # 2k rows
    pool = np.array([r["qvec"] for r in seeds], dtype=np.float64)
    split = lambda m: m.reshape(len(m), parts, d // parts).transpose(1, 0, 2)
    k = min(k, len(pool))
    centers = split(pool[:k]).copy() if start is None else np.array(start, dtype=np.float64)
    spare = split(pool[k:]) if len(pool) > k else split(pool)
    sc = vectors.sparkSession.sparkContext
    for r in range(rounds):
        sent = sc.broadcast(centers)

        def fold(batches, sent=sent):
            c = sent.value
            n, s = np.zeros(c.shape[:2]), np.zeros(c.shape)
            for b in batches:
                if not b.num_rows:
                    continue
                x = split(kernels.matrix(b.column(0), d))
                for p in range(parts):
                    a = nearest(x[p], c[p])
                    n[p] += np.bincount(a, minlength=len(n[p]))
                    np.add.at(s[p], a, x[p])
            p, j = np.nonzero(n)
            if len(p):
                salt = np.full(len(p), TaskContext.get().partitionId() % 64, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), pa.array(j), pa.array(salt), pa.array(n[p, j]), _lists(s[p, j], pa.float64())],
                    ["part", "center", "salt", "n", "total"],
                )

        fields = "part long, center long, salt int, n double, total array<double>"
        partial = train.select(vec).mapInArrow(fold, fields)
        salted = partial.repartition("part", "center", "salt").mapInArrow(_add_arrays, fields)
        sums = salted.repartition("part", "center").mapInArrow(_add_arrays, fields)
        got = sums.toArrow()  # k * dim numbers
        new = np.full(centers.shape, np.nan)
        if got.num_rows:
            total = kernels.matrix(got["total"], d // parts)
            new[got["part"].to_numpy(), got["center"].to_numpy()] = total / got["n"].to_numpy()[:, None]
        for p, j in zip(*np.nonzero(np.isnan(new[:, :, 0])), strict=True):
            new[p, j] = spare[p][(r * k + j) % len(spare[p])]
        if unit:
            size = np.sqrt((new * new).sum(2, keepdims=True))
            new = np.divide(new, size, out=new, where=size > 0)
        centers = new
        sent.unpersist()
    return centers


# ---------------------------------------------------------------- product codes


@dataclass(frozen=True)
class ProductCodec(Codec):
    """Nearest center in each sub-space; ``centers`` is (parts, k, dim / parts)."""

    centers: np.ndarray

    @property
    def width(self) -> int:
        return self.centers.shape[0]

    @property
    def dim(self) -> int:
        return self.centers.shape[0] * self.centers.shape[2]

    @property
    def code_bits(self) -> int:
        return max((self.centers.shape[1] - 1).bit_length(), 1)

    def _split(self, x):
        m, _, s = self.centers.shape
        return x.reshape(len(x), m, s)

    def codes(self, x):
        xs = self._split(x)
        return np.stack([nearest(xs[:, m], c) for m, c in enumerate(self.centers)], axis=1)

    def vectors(self, codes):
        picked = self.centers[np.arange(len(self.centers))[None, :], codes]
        return picked.reshape(len(codes), -1)

    def tables(self, q: Sequence[float]) -> np.ndarray:
        """Squared distance of each query part to each center: (parts, k)."""
        qs = self._split(np.asarray(q, dtype=np.float64)[None, :])[0]
        return ((qs[:, None, :] - self.centers) ** 2).sum(axis=2)


def pq_train(
    vectors: DataFrame, parts: int, bits: int, rounds: int = 8, seed: int = 42, id_col: str = "id",
    vec: str = "embedding", fraction: float = 1.0,
) -> ProductCodec | None:
    """Product codec with ``2**bits`` centers per part; None when parts do not divide the dimension."""
    if dimension(vectors, vec) % parts:
        return None
    return ProductCodec(lloyd(vectors, 1 << bits, parts, rounds, seed, id_col, vec, fraction))


def sq_kmeans_train(
    vectors: DataFrame, levels: int = 256, rounds: int = 8, seed: int = 42, id_col: str = "id",
    vec: str = "embedding",
) -> ProductCodec:
    """Non-uniform scalar codec: one-dimensional k-means per dimension."""
    return ProductCodec(lloyd(vectors, levels, dimension(vectors, vec), rounds, seed, id_col, vec))


def adc_search(
    coded: DataFrame, codec, q: Sequence[float], k: int, id_col: str = "id", codes: str = "codes"
) -> DataFrame:
    """Top-k by table lookups over codes (squared distances)."""
    d = lut_distance(codes, codec, q).alias("dist")
    return coded.select(id_col, d).orderBy("dist", id_col).limit(k)


def reconstruction_error(vectors: DataFrame, codec: Codec, vec: str = "embedding") -> DataFrame:
    """Mean squared difference between vectors and their decoded codes: one row ``(mse)``."""

    def mse(col: pa.Array) -> pa.Array:
        x = kernels.matrix(col)
        return pa.array(((x - codec.vectors(codec.codes(x).astype(np.int64))) ** 2).mean(axis=1))

    return vectors.select(F.arrow_udf(mse, "double")(F.col(vec)).alias("e")).agg(F.avg("e").alias("mse"))


def mse_sweep(
    vectors: DataFrame, configs: Sequence[tuple[int, int]], rounds: int = 6, seed: int = 42,
    id_col: str = "id", vec: str = "embedding",
) -> DataFrame:
    """Reconstruction error per (parts, bits): ``(parts, bits, mse)``; undividable ones left out."""
    out = None
    for parts, bits in configs:
        codec = pq_train(vectors, parts, bits, rounds, seed, id_col, vec)
        if codec is None:
            continue
        row = reconstruction_error(vectors, codec, vec).select(
            F.lit(parts).alias("parts"), F.lit(bits).alias("bits"), "mse"
        )
        out = row if out is None else out.union(row)
    return out


@dataclass(frozen=True)
class HalfCodec(Codec):
    """Half-precision numbers as codes of two bytes."""

    dim: int

    @property
    def width(self) -> int:
        return self.dim

    @property
    def code_bits(self) -> int:
        return 16

    def codes(self, x):
        return np.ascontiguousarray(x.astype("<f2")).view("<u2")

    def vectors(self, codes):
        return np.ascontiguousarray(codes.astype("<u2")).view("<f2").astype(np.float64)


def half_codes(vec: Column | str) -> Column:
    """Half-precision storage: little-endian float16 numbers as ``binary``."""

    def pack(col: pa.Array) -> pa.Array:
        x = kernels.matrix(col).astype("<f2")
        return pa.array([r.tobytes() for r in x], pa.binary())

    return F.arrow_udf(pack, "binary")(as_col(vec))


def half_vectors(codes: Column | str) -> Column:
    """``array<float>`` from half-precision storage."""

    def unpack(col: pa.Array) -> pa.Array:
        x = np.stack([np.frombuffer(b, "<f2") for b in col.to_pylist()]) if len(col) else np.empty((0, 1))
        return _lists(x.astype(np.float32), pa.float32())

    return F.arrow_udf(unpack, "array<float>")(as_col(codes))


# ---------------------------------------------------------------- 1-bit codes


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """Seeded sign flips followed by a Walsh-Hadamard transform: ``dim`` orthonormal rows.

    The width is the next power of two; a vector counts as filled up with zeros.
    """
    width = 1 << max(dim - 1, 0).bit_length()
    i, j = np.arange(dim)[:, None], np.arange(width)[None, :]
    waves = np.where(np.bitwise_count(i & j) % 2 == 0, 1.0, -1.0)
    flips = [1.0 if hashlib.md5(f"{seed}:{p}".encode()).hexdigest()[0] < "8" else -1.0 for p in range(dim)]
    return np.array(flips)[:, None] * waves / np.sqrt(width)


@dataclass(frozen=True)
class BitCodec:
    """Sign bits of centred, rotated vectors with norm and correction per vector.

    Each sign pattern stands for the unit vector with entries +-1/sqrt(dim). The inner product
    with a query is estimated as <pattern, query> / <pattern, vector>, which is unbiased.
    """

    center: np.ndarray
    turn: np.ndarray

    @property
    def dim(self) -> int:
        """Bits of a code."""
        return self.turn.shape[1]

    def pack(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed bits, norm, <pattern, unit vector>) per row."""
        r = (x - self.center) @ self.turn
        norm = np.sqrt((r * r).sum(1))
        dot = np.abs(r).sum(1) / np.sqrt(self.dim)
        unit = np.divide(dot, norm, out=np.ones_like(dot), where=norm > 0)
        return np.packbits(r >= 0, axis=1), norm, unit

    def turned(self, q: np.ndarray, query_bits: int = 0) -> np.ndarray:
        """Rotated query, optionally on ``2**query_bits`` uniform levels."""
        r = (np.asarray(q, dtype=np.float64) - self.center) @ self.turn
        if not query_bits:
            return r
        lo, hi = r.min(-1, keepdims=True), r.max(-1, keepdims=True)
        step = np.maximum(hi - lo, 1e-12) / ((1 << query_bits) - 1)
        return lo + np.rint((r - lo) / step) * step

    def estimate(
        self, bits: np.ndarray, norm: np.ndarray, unit: np.ndarray, q: np.ndarray,
        query_bits: int = 0, sign_query: bool = False,
    ) -> np.ndarray:
        """Estimated squared distances (rows, queries).

        ``sign_query`` reduces the query to its signs and skips the correction, the simplest form
        of the estimate; its scale is off, so only its order means something.
        """
        pattern = (2.0 * np.unpackbits(bits, axis=1, count=self.dim) - 1.0) / np.sqrt(self.dim)
        r = self.turned(np.atleast_2d(q), query_bits)
        qn = (self.turned(np.atleast_2d(q)) ** 2).sum(1)
        if sign_query:
            inner = pattern @ (np.where(r >= 0, 1.0, -1.0) / np.sqrt(self.dim)).T
        else:
            inner = (norm / unit)[:, None] * (pattern @ r.T)
        return (norm**2)[:, None] + qn[None, :] - 2.0 * inner


def bit_train(vectors: DataFrame, seed: int = 42, vec: str = "embedding") -> BitCodec:
    """Codec centred on the mean vector (one row per dimension reaches the driver)."""
    rows = sorted(dim_stats(vectors, None, vec).collect(), key=lambda r: r["pos"])
    center = np.array([r["total"] / r["n"] for r in rows])
    return BitCodec(center, rotation(len(center), seed))


BIT_FIELDS = "bits binary, norm double, unit double"


def bit_encode(vectors: DataFrame, codec: BitCodec, vec: str = "embedding") -> DataFrame:
    """The table with ``code`` (bits, norm, unit) in place of the vector column."""
    def encode(v: pd.Series) -> pd.DataFrame:
        bits, norm, unit = codec.pack(np.stack(v.to_numpy()).astype(np.float64))
        return pd.DataFrame({"bits": [b.tobytes() for b in bits], "norm": norm, "unit": unit})

    code = F.pandas_udf(encode, BIT_FIELDS)(F.col(vec))
    return vectors.select(*[c for c in vectors.columns if c != vec], code.alias("code"))


def unpack_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrow struct column of 1-bit codes as numpy arrays."""
    bits = col.field("bits").to_pylist()
    return (
        np.stack([np.frombuffer(b, np.uint8) for b in bits]),
        col.field("norm").to_numpy(zero_copy_only=False), col.field("unit").to_numpy(zero_copy_only=False),
    )


def bit_search(
    coded: DataFrame, codec: BitCodec, q: Sequence[float], k: int, query_bits: int = 0,
    sign_query: bool = False, id_col: str = "id",
) -> DataFrame:
    """Top-k by estimated squared distance."""
    qa = np.asarray(q, dtype=np.float64)

    def score(col: pa.Array) -> pa.Array:
        if not len(col):
            return pa.array([], pa.float64())
        return pa.array(codec.estimate(*unpack_codes(col), qa, query_bits, sign_query)[:, 0])

    d = F.arrow_udf(score, "double")(F.col("code")).alias("dist")
    return coded.select(id_col, d).orderBy("dist", id_col).limit(k)
