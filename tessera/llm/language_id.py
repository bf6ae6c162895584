"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed character n-grams of length one. Each language is split into a few
clusters (spherical k-means), and a text goes to the language of the most similar centroid. A text that
is far from all centroids, or that has no letters, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import named, remainder

HELD_OUT_MOD, HELD_OUT_REST = 3, 1
BINS = 2048  # hashed n-grams
SIZES = (1, 2, 3)  # bytes of an n-gram
CLUSTERS = 4
SAMPLE_ROWS = 4_000  # texts that the centroids are fitted on, in equal shares for the languages
UNKNOWN = "und"
# A text is rejected below a share of the usual similarity of texts of its length and language: OWN_SHARE
# of what all but a hundredth of the language's own texts reach, but at least the first of these shares
# and at most that of its length (of up to so many n-grams, as a power of two).
REJECT_BELOW = {5: 0.25, 6: 0.3, 7: 0.35, 31: 0.43}
OWN_SHARE, OWN_QUANTILE = 0.8, 0.01
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_NO_LETTERS = re.compile(r"[\W\d_]+")


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the text's letters; None without letters."""
    plain = _NO_LETTERS.sub(" ", text or "").strip().lower()
    if not plain:
        return None
    a = np.frombuffer(f" {plain} ".encode(), np.uint8)
    out = np.zeros(BINS, np.int64)
    shift = np.uint32(32 - BINS.bit_length() + 1)
    for lo in range(0, len(a), 1 << 20):  # bounded memory for very long texts
        piece = a[lo:lo + (1 << 20) + max(SIZES) - 1].astype(np.uint32)
        more = lo + (1 << 20) < len(a)
        for n in SIZES:
            size = min(1 << 20, len(piece) - n + 1) if more else len(piece) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h = (h ^ piece[k:k + size]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            out += np.bincount((h * _MULTIPLIERS[0]) >> shift, minlength=BINS)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of damped counts times idf."""
    x = np.log1p(counts) * idf
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """At most CLUSTERS centroids of BINS numbers per language."""

    langs: list[str]
    owner: np.ndarray  # language of each centroid
    centers: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # (language, log2 of the n-grams): similarity below which a text is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, similarity 0 to 1, and whether the text is rejected."""
        counts = gram_counts(text)
        if counts is None:
            return UNKNOWN, 0.0, True
        if not self.langs:
            return UNKNOWN, 0.0, True
        sims = self.centers @ vector(counts, self.idf)
        best = int(sims.argmax())
        lang = int(self.owner[best])
        near = min(1.0, max(0.0, float(sims[best])))
        return self.langs[lang], near, near < self.least[lang, size_class(counts)]


def size_class(counts: np.ndarray) -> int:
    return min(31, int(counts.sum()).bit_length())


def least_similarity(near: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per size class the similarity that a text needs, from those of a language's own texts."""
    # usual similarity by length; lengths without texts take the next one that has some
    usual = np.array([np.median(near[size == s]) if (size == s).any() else np.nan for s in range(32)])
    usual = pd.Series(usual).ffill().bfill().to_numpy()
    share, lowest, before = np.empty(32), min(REJECT_BELOW.values()), -1
    for last, most in REJECT_BELOW.items():
        mine = (size > before) & (size <= last)
        own = OWN_SHARE * np.quantile(near[mine] / usual[size[mine]], OWN_QUANTILE) if mine.any() else most
        share[before + 1:last + 1] = min(most, max(lowest, own))
        before = last
    return share * usual


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; starts from far-apart rows, no chance involved."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    centers = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        for c in range(len(centers)):
            if (own == c).any():
                s = x[own == c].sum(0)
                centers[c] = s / np.sqrt((s * s).sum())
    return centers


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    key = named(docs, id_col)
    return docs.where(
        (remainder(key, HELD_OUT_MOD) != HELD_OUT_REST) & named(docs, lang_col).isNotNull() & named(docs, text_col).isNotNull()
    ).select(key.alias("key"), named(docs, lang_col).alias("lang"), named(docs, text_col).alias("text"))


def _idf(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bin, over all learnable texts."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BINS + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                c = gram_counts(t)
                if c is not None:
                    df[:BINS] += c > 0
                    n += 1
        df[BINS] = n
        yield pd.DataFrame({"bin": np.arange(BINS + 1), "n": df})

    total = texts.select("text").mapInPandas(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BINS + 1)
    df[total["bin"].to_numpy(int)] = total["n"].to_numpy(float)
    return np.log((1 + df[BINS]) / (1 + df[:BINS])) + 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS) -> Model:
    """Centroids learnt from the texts with a language outside the held-out part.

    Document frequencies cover all of them; the centroids are fitted on at most ``sample_rows`` texts
    (one per language at least), those with the smallest hash of id and text in each language.
    """
    texts = _learnable(docs, id_col, text_col, lang_col)
    idf = _idf(texts)
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.empty(0, int), np.empty((0, BINS), np.float32), idf, np.empty((0, 32)))
    each = max(1, sample_rows // len(sizes))
    # About twice the rows wanted pass the scan, whatever the size of a language; the rank makes it exact.
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, (2 * each + 50) / n))])
    drawn = texts.withColumn("h", F.xxhash64("key", "text"))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    drawn = drawn.withColumn("r", rank).where(F.col("r") <= each).select("lang", "text")

    def centers_of(group: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in (gram_counts(t) for t in sorted(group["text"])) if c is not None]
        none = pd.DataFrame({"lang": [], "center": [], "least": []})
        if not counts:
            return none
        x = np.stack([vector(c, idf) for c in counts])
        centers = cluster(x, clusters)
        near = (x @ centers.T).max(1)
        size = np.array([size_class(c) for c in counts])
        least = least_similarity(near, size)
        return pd.DataFrame({
            "lang": group["lang"].iloc[0], "center": [c.astype("<f4").tobytes() for c in centers],
            "least": [least.tolist()] * len(centers),
        })

    found = drawn.groupBy("lang").applyInPandas(centers_of, "lang string, center binary, least array<double>").toPandas()
    found = found.sort_values(["lang", "center"], ignore_index=True)
    langs = sorted(set(found["lang"]))
    if not langs:
        return Model([], np.empty(0, int), np.empty((0, BINS), np.float32), idf, np.empty((0, 32)))
    least = np.stack([np.asarray(found.loc[found["lang"] == g, "least"].iloc[0], float) for g in langs])
    centers = np.stack([np.frombuffer(c, "<f4") for c in found["center"]])
    return Model(langs, np.array([langs.index(g) for g in found["lang"]]), centers, idf, least)


def predictions(text: Column, model: Model) -> Column:
    """struct(lang, score, rejected) of every whole text."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return run(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row; other columns are not read.

    ``lang_pred`` is ``und`` for NULL, empty and letterless texts (score 0, rejected), else the nearest
    learnt language, also where the text is rejected for its distance. Of equally near centroids the
    first language by name wins. A text of any length is read whole, a NULL id is not held out. Equal rows
    stay as many as they are; an empty table gives an empty result, and a model of an empty table ``und``.
    """
    p = docs.select(named(docs, id_col).alias("doc_id"), predictions(named(docs, text_col), model).alias("p"))
    held = remainder(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_REST
    return p.select("doc_id", held.alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def drop_unknown(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, all columns as they are.

    Predictions are no column, so no name can clash with them. NULL, empty and letterless texts are rejected;
    of equal rows all go or stay; an empty table stays empty.
    """
    return docs.where(~predictions(named(docs, text_col), model)["rejected"])
