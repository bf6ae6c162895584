"""Vector distances as Spark column expressions, all computed in double precision.

Two forms: between two array columns (``aggregate`` over ``zip_with``, built-in but interpreted per
element), and from an array column to a constant query (one Arrow UDF over whole batches). On 400k
vectors of 64 dimensions the second took 0.8 s against 3.5 s. Spelling the sum out as plain column
arithmetic was as fast per row, but every new query vector cost 1.5 s of code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import kernels


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(a, b, term: Callable[[Column, Column], Column]) -> Column:
    pair = F.zip_with(as_col(a), as_col(b), lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance; NULL when the lengths differ."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def inner_product(a, b) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def neg_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def ip_distance(a, b) -> Column:
    return F.lit(1.0) - inner_product(a, b)


def norm(a) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_similarity(a, b) -> Column:
    """Cosine; NULL when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, inner_product(a, b) / scale)


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def normalize(a) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(
        n > 0, F.transform(as_col(a), lambda x: x.cast("double") / n)
    ).otherwise(F.transform(as_col(a), lambda x: x.cast("double")))


def l2_sq_by_norms(a, b, center) -> Column:
    """Squared distance rebuilt from norms about a centre and the unit inner product."""
    sub = lambda x, y: x.cast("double") - y.cast("double")
    ac = F.zip_with(as_col(a), as_col(center), sub)
    bc = F.zip_with(as_col(b), as_col(center), sub)
    na, nb = norm(ac), norm(bc)
    cos = F.when((na > 0) & (nb > 0), inner_product(ac, bc) / (na * nb)).otherwise(F.lit(0.0))
    return na * na + nb * nb - F.lit(2.0) * na * nb * cos


def constant(values: Sequence[float]) -> Column:
    """A query vector as an ``array<double>`` literal."""
    return F.lit([float(v) for v in values])


def parse_vector(text) -> Column:
    """``[1,2]`` or bare ``1,2`` text as ``array<double>``; NULL when empty or not numeric."""
    t = F.trim(as_col(text))
    bracketed = F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    v = F.from_json(bracketed, "array<double>", {"mode": "PERMISSIVE"})
    ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    return F.when(ok, v)


def query_function(q: Sequence[float], metric: str):
    """The score against a constant query as a function of an array column, to call or to register for SQL.

    NULL where the score is not defined. Marked nondeterministic only so that Spark keeps one evaluation
    when the score is both filtered and returned.
    """
    qa = np.array([float(x) for x in q])

    def score(col: pa.Array) -> pa.Array:
        s = kernels.exact_scores(kernels.matrix(col, len(qa)), qa, metric)
        return pa.array(s, mask=np.isnan(s))

    return F.arrow_udf(score, "double").asNondeterministic()


def to_constant(vec, q: Sequence[float], metric: str) -> Column:
    """Score of an array column against a constant query; NULL where it is not defined."""
    return query_function(q, metric)(as_col(vec))


@dataclass(frozen=True)
class Metric:
    """A distance or similarity with its sort direction."""

    name: str
    between: Callable[[Column, Column], Column]
    ascending: bool

    def order(self, col: Column | str) -> Column:
        return as_col(col).asc() if self.ascending else as_col(col).desc()

    def to_query(self, vec: Column | str, q: Sequence[float]) -> Column:
        """Score of an array column against a constant query vector."""
        return to_constant(vec, q, self.name)


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("l2", l2, True),
        Metric("l2_sq", l2_sq, True),
        Metric("inner_product", inner_product, False),
        Metric("neg_inner_product", neg_inner_product, True),
        Metric("ip_distance", ip_distance, True),
        Metric("cosine_similarity", cosine_similarity, False),
        Metric("cosine_distance", cosine_distance, True),
    )
}
