"""Numpy helpers that run inside Arrow tasks: exact top-k over one batch of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as a dense (rows, dim) double matrix; ragged input is an error."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.empty((0, dim or 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dim or len(flat) // n
    lengths = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    if col.null_count or len(flat) != n * width or (lengths != width).any():
        raise ValueError(f"vectors must all have {width} numbers")
    if np.isnan(flat).any():
        raise ValueError("vectors must not hold NULL or NaN")
    return flat.reshape(n, width)


def exact_scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Score of every row of ``x`` against one query, as the named metric defines it."""
    if metric in ("l2", "l2_sq"):
        d = ((x - q) ** 2).sum(axis=1)
        return np.sqrt(d) if metric == "l2" else d
    ip = (x * q).sum(axis=1)
    if metric == "inner_product":
        return ip
    if metric == "neg_inner_product":
        return -ip
    if metric == "ip_distance":
        return 1.0 - ip
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = ip / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    return cos if metric == "cosine_similarity" else 1.0 - cos


# queries scored by one matrix product, so that its result stays small
QUERIES_PER_BLOCK = 256

ASCENDING = {"l2", "l2_sq", "neg_inner_product", "ip_distance", "cosine_distance"}


def _as_rough(key, metric: str):
    """An exact key (smaller is closer) on the scale of the rough ones."""
    return key * key if metric == "l2" else key - 1.0 if metric in ("ip_distance", "cosine_distance") else key


# numbers of a distance matrix that one step holds
BLOCK_VALUES = 4_000_000


def nearest_few(x: np.ndarray, centers: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centers per row, nearest first; the lowest index wins a tie.

    Blocks of rows and centers bound the memory for any number of centers.
    """
    out = np.empty((len(x), n), np.int64)
    norms = (centers * centers).sum(1)
    step = max(BLOCK_VALUES // max(min(len(centers), 16_384), 1), 1)
    for lo in range(0, len(x), step):
        rows = x[lo : lo + step]
        dist, at = np.empty((len(rows), 0)), np.empty((len(rows), 0), np.int64)
        for c in range(0, len(centers), 16_384):
            d = norms[None, c : c + 16_384] - 2.0 * (rows @ centers[c : c + 16_384].T)
            if n == 1:
                best = d.argmin(axis=1)[:, None]
            else:
                cut = np.partition(d, min(n, d.shape[1]) - 1, axis=1)[:, min(n, d.shape[1]) - 1]
                best = np.argsort(np.where(d <= cut[:, None], d, np.inf), axis=1, kind="stable")[:, :n]
            dist = np.hstack([dist, np.take_along_axis(d, best, 1)])
            at = np.hstack([at, best + c])
            keep = np.argsort(dist, axis=1, kind="stable")[:, :n]
            dist, at = np.take_along_axis(dist, keep, 1), np.take_along_axis(at, keep, 1)
        out[lo : lo + step] = at
    return out


# rows scored by one matrix product
ROWS_PER_STEP = 4_096
# rows of a step whose k-th nearest is a first bar for the others
FIRST_ROWS = 2_048
# rows under the bar that are scored exactly in one go
HITS_PER_STEP = 32_768


def _rounds(pos: np.ndarray) -> list[np.ndarray]:
    """Places in ``pos`` so that no position comes twice in a round."""
    order = np.argsort(pos, kind="stable")
    same = pos[order]
    starts = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    times = np.arange(len(pos)) - np.repeat(starts, np.diff(np.append(starts, len(pos))))
    return [order[times == t] for t in range(int(times.max()) + 1)]


class _Held:
    """At most k rows (key, id) per query, in arrays; the smallest keys stay, ties go to the lower id."""

    sign = 1.0

    def __init__(self, queries: int, k: int):
        self.k = k
        self.n = np.zeros(queries, np.int64)  # rows held per query
        self.keys = np.empty((queries, 0))
        self.ids: np.ndarray | None = None
        self.worst = np.full(queries, np.inf)  # the bar of a query that holds k rows

    def _widen(self, ids: np.ndarray, times: int) -> None:
        """Make room for as many rows as there can be when all are offered ``times``."""
        more = min(self.k, self.keys.shape[1] + len(ids) * times) - self.keys.shape[1]
        if self.ids is None:
            self.ids = np.empty((len(self.n), 0), ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids.dtype, ids.dtype))
        if more > 0:
            self.keys = np.hstack([self.keys, np.empty((len(self.n), more))])
            self.ids = np.hstack([self.ids, np.empty((len(self.n), more), self.ids.dtype)])

    def _first_bar(self, keys: np.ndarray) -> np.ndarray:
        """Per query the k-th smallest of some of the (queries, rows) keys: no less than that of all."""
        some = keys[:, : max(FIRST_ROWS, self.k)]
        return np.partition(np.where(np.isnan(some), np.inf, some), self.k - 1, axis=1)[:, self.k - 1]

    @staticmethod
    def _steps(q: np.ndarray) -> Iterator[slice]:
        """Steps of whole queries: many equal rows must not be scored at once for all of them."""
        ends = np.flatnonzero(np.append(q[1:] != q[:-1], True)) + 1
        lo = 0
        while lo < len(q):
            hi = int(ends[max(np.searchsorted(ends, lo + HITS_PER_STEP, "right") - 1, np.searchsorted(ends, lo, "right"))])
            yield slice(lo, hi)
            lo = hi

    def _bar(self, key: np.ndarray) -> np.ndarray:
        return key

    def _merge(self, pos: np.ndarray, q: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        """Keep the best k of the held rows and the new ones of the queries ``pos[q]``."""
        p = pos[q]
        asked = p[np.append(True, p[1:] != p[:-1])]
        n = self.n[asked]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # places in the held rows
        held = np.repeat(asked, n)
        p = np.concatenate([held, p])
        key = np.concatenate([self.keys[held, at], key])
        ids = np.concatenate([self.ids[held, at], ids])
        order = np.lexsort((ids, key, p))
        p, key, ids = p[order], key[order], ids[order]
        first = np.append(True, p[1:] != p[:-1])
        starts = np.flatnonzero(first)
        at = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
        best = at < self.k
        self.keys[p[best], at[best]], self.ids[p[best], at[best]] = key[best], ids[best]
        asked = p[first]
        self.n[asked] = np.minimum(np.diff(np.append(starts, len(p))), self.k)
        full = asked[self.n[asked] == self.k]
        if len(full):
            self.worst[full] = self._bar(self.keys[full, self.k - 1])

    def result(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query position, ids, scores) in rank order."""
        for p in np.flatnonzero(self.n).tolist():
            yield p, self.ids[p, : self.n[p]], self.sign * self.keys[p, : self.n[p]]

    def rows(self, step: int = 4_096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same as columns (query positions, ids, scores) of up to ``step`` queries."""
        for s in range(0, len(self.n) if self.ids is not None else 0, step):
            n = self.n[s : s + step]
            if n.any():
                held = np.arange(self.keys.shape[1])[None, :] < n[:, None]
                yield s + np.repeat(np.arange(len(n)), n), self.ids[s : s + step][held], self.sign * self.keys[s : s + step][held]


class TopK(_Held):
    """Running exact top-k per query over batches; ties go to the lower id.

    Matrix products find the rows under each query's bar, for a block of queries at once; only those are
    scored exactly and merged with the rows held. Held are at most k rows per query, in arrays.
    """

    def __init__(self, qs: np.ndarray, k: int, metric: str):
        super().__init__(len(qs), k)
        self.qs, self.metric = qs, metric
        self.sign = 1.0 if metric in ASCENDING else -1.0

    def _bar(self, key: np.ndarray) -> np.ndarray:
        return _as_rough(key, self.metric)

    def add(self, ids: np.ndarray, x: np.ndarray, only: np.ndarray | None = None) -> None:
        """Offer rows to all queries, or to the query positions in ``only``."""
        pos = np.arange(len(self.qs)) if only is None else only
        if len(ids) == 0 or len(pos) == 0 or self.k < 1:
            return
        rounds = [pos[at] for at in _rounds(pos)]  # a position may come again
        self._widen(ids, len(rounds))
        for r in range(0, len(ids), ROWS_PER_STEP):
            self._add_rows(ids[r : r + ROWS_PER_STEP], x[r : r + ROWS_PER_STEP], rounds)

    def _add_rows(self, ids: np.ndarray, x: np.ndarray, rounds: list[np.ndarray]) -> None:
        if self.metric in ("l2", "l2_sq"):
            norms = (x * x).sum(1)
            rows, most = np.hstack([x, norms[:, None]]), float(norms.max())
        elif self.metric.startswith("cosine"):
            with np.errstate(invalid="ignore", divide="ignore"):
                rows, most = x / np.sqrt((x * x).sum(1))[:, None], 1.0
        else:
            rows, most = x, float((x * x).sum(1).max())
        for pos in rounds:
            for s in range(0, len(pos), QUERIES_PER_BLOCK):
                self._add_block(ids, x, rows, most, pos[s : s + QUERIES_PER_BLOCK])

    def _rough(self, rows: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, what they lack per query): (queries, rows) sort keys, smaller is closer, exact up to rounding."""
        none = np.zeros(len(qs))
        if self.metric in ("l2", "l2_sq"):
            return np.hstack([-2.0 * qs, np.ones((len(qs), 1))]) @ rows.T, (qs * qs).sum(1)
        if self.metric.startswith("cosine"):
            with np.errstate(invalid="ignore", divide="ignore"):
                return -(qs / np.sqrt((qs * qs).sum(1))[:, None]) @ rows.T, none
        return -qs @ rows.T, none

    def _add_block(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, most: float, pos: np.ndarray) -> None:
        qs = self.qs[pos]
        rough, lacks = self._rough(rows, qs)
        # matrix products differ from the exact sums only by rounding: widen the bar by that
        size = 2.0 if self.metric.startswith("cosine") else 2.0 * (most + float((qs * qs).sum(1).max()))
        slack = 1e-9 * (1.0 + size)
        bar = self.worst[pos] - lacks
        open_ = np.flatnonzero(np.isinf(bar))
        if len(open_) and len(ids) > self.k:  # a sample's k-th nearest is no nearer than that of all
            bar[open_] = self._first_bar(rough[open_])
        bar = np.minimum(bar + slack, np.finfo(float).max)
        q, r = np.nonzero(rough <= bar[:, None])
        if not len(q):
            return
        del rough
        for at in self._steps(q):
            self._merge(pos, q[at], ids[r[at]], self.sign * self._exact(x[r[at]], qs[q[at]]))

    def _exact(self, x: np.ndarray, qs: np.ndarray) -> np.ndarray:
        """Scores of pairs; the same sums as :func:`exact_scores`."""
        if self.metric.startswith("cosine"):
            ip = (x * qs).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                cos = ip / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((qs * qs).sum(axis=1)))
            return cos if self.metric == "cosine_similarity" else 1.0 - cos
        return exact_scores(x, qs, self.metric)


class Best(_Held):
    """The k smallest (key, id) per query, offered in any order."""

    def add(self, pos: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        """Offer the rows ``ids`` with their (queries, rows) keys to the queries ``pos``."""
        if not key.size or self.k < 1:
            return
        rounds = _rounds(pos)
        self._widen(ids, len(rounds))
        for at in rounds:
            mine, keys = pos[at], key[at]
            bar = self.worst[mine]
            open_ = np.flatnonzero(np.isinf(bar))
            if len(open_) and len(ids) > self.k:
                bar[open_] = self._first_bar(keys[open_])
            q, r = np.nonzero(keys <= bar[:, None])
            for s in self._steps(q):
                self._merge(mine, q[s], ids[r[s]], keys[q[s], r[s]])


def pairs_within(
    x: np.ndarray, qs: np.ndarray, radius: float, places: tuple[np.ndarray, np.ndarray] | None = None, slack: float = 1e-9
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query positions, row positions, L2 distances) of all pairs strictly closer than ``radius``.

    Matrix products leave the pairs that may be close enough; their distances are summed exactly. ``places`` are
    the distances of the rows and of the queries from one point: by the triangle inequality only rows about as
    far from it as the queries of a block are looked at.
    """
    order = np.arange(len(qs)) if places is None else np.argsort(places[1], kind="stable")
    norms = (x * x).sum(1)
    for s in range(0, len(qs), QUERIES_PER_BLOCK):
        some = order[s : s + QUERIES_PER_BLOCK]
        near = np.arange(len(x))
        if places is not None:
            away, of = places[0], places[1][some]
            near = np.flatnonzero((away > of.min() - radius - slack) & (away < of.max() + radius + slack))
        q = qs[some]
        lengths = (q * q).sum(1)
        for r in range(0, len(near), ROWS_PER_STEP):
            rows = near[r : r + ROWS_PER_STEP]
            rough = np.hstack([-2.0 * q, np.ones((len(q), 1))]) @ np.hstack([x[rows], norms[rows, None]]).T
            bar = radius * radius - lengths + slack * (1.0 + 2.0 * (float(norms[rows].max()) + float(lengths.max())))
            at, hit = np.nonzero(rough <= bar[:, None])
            for h in range(0, len(at), HITS_PER_STEP):
                a, i = at[h : h + HITS_PER_STEP], rows[hit[h : h + HITS_PER_STEP]]
                d = exact_scores(x[i], q[a], "l2")
                inside = d < radius
                if inside.any():
                    yield some[a[inside]], i[inside], d[inside]


def grouped_rows(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, row positions) for each distinct value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield values[rows[0]], rows


def hits(schema: list[pa.DataType], qid, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Result rows ``(qid, id, dist)`` of one query, with the given id types."""
    return pa.RecordBatch.from_arrays(
        [pa.array([qid] * len(ids), schema[0]), pa.array(ids, schema[1]), pa.array(scores, pa.float64())],
        ["qid", "id", "dist"],
    )


def all_hits(schema: list[pa.DataType], names: list | pa.Array, top: _Held, finish=lambda key: key) -> Iterator[pa.RecordBatch]:
    """Result rows of all queries of ``top``, many queries in a batch."""
    qids = names if isinstance(names, pa.Array) else pa.array(names, schema[0])
    for p, ids, scores in top.rows():
        yield pa.RecordBatch.from_arrays(
            [qids.take(pa.array(p)), pa.array(ids, schema[1]), pa.array(finish(scores), pa.float64())], ["qid", "id", "dist"])
