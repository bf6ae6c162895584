"""What each filter of a set does alone, in any order, and on average over all orders.

Filters remove documents; a coalition S of them removes v(S), the documents that fail any filter of S.
The Hart-Mas-Colell potential of that game, P(S) = (v(S) + sum of P(S without i) over i in S) / |S| with
P(empty) = 0, is computed recursively over all coalitions. The Shapley value of a filter is the grand
potential minus the potential without it, and a step of an order is the difference of two coalitions. So
one count of documents by the set of filters they fail answers for all orders; texts are read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, named, whole_text, words
from tessera.llm.rows import written

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_FILTERS = 8  # 8! orders of 8 steps are 322,560 rows per part


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, a, b, c, d, e): which of the five text filters each document fails.

    a: under 100 words; b: under 80 % distinct words; c: over 10 % capitals A-Z; d: holds one of
    ``#$%&*|``; e: the text of a document with a smaller id, anywhere in the table. NULL counts as an
    empty text, which fails a only (and e, as any text); a NULL part is the empty string. A NULL id is
    smaller than none and larger than none. Equal rows are judged each; other columns are not read.

    Texts are equal when their SHA-256 are: only digests are shuffled. The first id of a text is an
    aggregate, and joins with one row per text that occurs twice, so copies spread over tasks.
    """
    text = whole_text(named(docs, text_col))
    long = lambda c: c.cast("long")
    w = F.col("w")
    plain = docs.select(
        named(docs, id_col).alias("doc_id"), F.coalesce(named(docs, part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.sha2(text, 256).alias("digest"),
    ).withColumn("w", words(F.col("text")))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    judged = plain.select(
        "doc_id", "part", F.unhex("digest").alias("digest"),
        (F.size(w) < MIN_WORDS).alias("a"),
        (100 * long(F.size(F.array_distinct(w))) < MIN_DISTINCT_PERCENT * long(F.size(w))).alias("b"),
        (100 * long(capitals) > MAX_CAPITALS_PERCENT * long(F.length("text"))).alias("c"),
        F.col("text").rlike(SYMBOLS).alias("d"),
    )
    judged = written(judged, "failures")
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("e")
    return judged.join(firsts.drop("copies"), "digest", "left").select("doc_id", "part", "a", "b", "c", "d", later)


def potentials(values: np.ndarray) -> np.ndarray:
    """n! P(S) of the game ``values`` (v(S) by coalition; bit i is player i), in exact whole numbers."""
    n = len(values).bit_length() - 1
    scale = factorial(n)
    p = [0] * len(values)
    for s in range(1, len(values)):  # a coalition comes after all its subsets
        members = [i for i in range(n) if s >> i & 1]
        p[s] = (scale * int(values[s]) + sum(p[s ^ 1 << i] for i in members)) // len(members)
    return np.array(p, object)


def coalition_values(fails: np.ndarray, n: int) -> np.ndarray:
    """v(S) for every coalition of ``n`` filters, from the documents that fail exactly each set."""
    kept = np.array(fails, np.int64)
    for i in range(n):  # sums over subsets: documents whose failures lie within a set
        bit = kept.reshape(-1, 2, 1 << i)
        bit[:, 1] += bit[:, 0]
    return kept[-1] - kept[::-1]  # those that fail nothing of S fail only what is outside S


def steps(fails: np.ndarray, lost: Mapping[str, np.ndarray], letters: Sequence[str]) -> pd.DataFrame:
    """All orders and steps of one part; ``fails`` and ``lost`` count documents by the set they fail."""
    n = len(letters)
    v = coalition_values(fails, n)
    others = {name: coalition_values(x, n) for name, x in lost.items()}
    p = potentials(v)
    total, full = int(np.sum(fails)), (1 << n) - 1
    rows = []
    for order in permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for k, i in enumerate(order):
            after = before | 1 << i
            removed = int(v[after] - v[before])
            rows.append((
                name, k + 1, total - int(v[after]), removed, int(v[1 << i]) - removed, int(v[full] - v[full ^ 1 << i]),
                *[int(x[after] - x[before]) for x in others.values()], int(p[full] - p[full ^ 1 << i]),
            ))
            before = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"])


def audit(judged: DataFrame, filters: Mapping[str, str], lost: Mapping[str, str] | None = None, part_col: str = "part") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``filters``: letter -> boolean column, true where a document fails it (NULL: it does not).
    ``lost``: name of a result column -> boolean column of documents worth counting when removed. Columns:
    ``part``, ``filter_order``, ``step`` (from 1), documents ``kept`` after the step, ``removed`` here,
    ``redundant`` (fail this filter, removed earlier), ``unique_fails`` (fail this filter alone), those
    of ``lost`` removed here, and ``shapley``: removed by this filter summed over all orders.

    Documents are counted by part and set of failures in the map tasks; a part then is at most 2^n rows.
    An empty table has no parts and gives no rows.
    """
    lost = dict(lost or {})
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or any(len(x) != 1 for x in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter are needed")
    yes = lambda c: F.coalesce(named(judged, c), F.lit(False))
    bits: Column = F.lit(0)
    for i, c in enumerate(filters.values()):
        bits = bits + yes(c).cast("int") * (1 << i)
    sums = {f"lost{i}": F.sum(yes(c).cast("long")) for i, c in enumerate(lost.values())}
    counts = judged.groupBy(named(judged, part_col).alias("part"), bits.alias("fails")).agg(
        F.count(F.lit(1)).alias("n"), *[s.alias(k) for k, s in sums.items()]
    )
    letters = list(filters)
    names = list(lost)

    def orders(group: pd.DataFrame) -> pd.DataFrame:
        by_set = lambda c: np.bincount(group["fails"], group[c], 1 << n).astype(np.int64)
        out = steps(by_set("n"), {name: by_set(f"lost{i}") for i, name in enumerate(names)}, letters)
        out.insert(0, "part", group["part"].iloc[0])
        return out

    long = ["kept", "removed", "redundant", "unique_fails", *names, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in long)
    return counts.groupBy("part").applyInPandas(orders, schema)


def marked(judged: DataFrame, labels: DataFrame, marks: Mapping[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``judged`` with one boolean column per mark: whether some label row of the document has it.

    Labels of one document are combined before the join, whose other side has one row per document id.
    """
    key = fresh([*judged.columns, *marks], "label_id")
    combined = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in marks.items()]
    )
    joined = judged.join(combined, named(judged, "doc_id") == F.col(key), "left")
    return joined.select(*[named(judged, c) for c in judged.columns], *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in marks])


def interactions(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """The five text filters A to E over all documents, per part: see ``failures`` and ``audit``."""
    marks = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    judged = marked(failures(docs, part_col=part_col), labels, marks)
    return audit(judged, {c.upper(): c for c in "abcde"}, {m: m for m in marks})
