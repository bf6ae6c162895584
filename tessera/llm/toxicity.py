"""Toxicity: a linear classifier with a counterfactual penalty on identity terms.

Labelled texts that mention a group are copied with the group's name swapped for another one of the
same kind. The loss adds the squared change of the score between a text and its copy, so a group's
name cannot carry the verdict, while the words around it can.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named, remainder, whole_text
from tessera.llm.rows import written

# Names of groups, by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "african", "latino", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "migrants", "locals", "tourists"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "katholiken"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "catholiques"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "católicos"),
)
HELD_OUT_MOD, HELD_OUT_REST = 5, 0
SAMPLE_ROWS = 20_000  # labelled texts that the classifier is fitted on, half of them toxic if there are as many
N_FEATURES = 2_048
PREFIXES = (4, 5, 6, 7)
REPEATS = (2, 3)  # a prefix with so many different words is a feature of its own
LEAST_G = 16.0  # features below are left out as chance
# letters, and the dots that end sentences
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def word_features(word: str) -> list[str]:
    """The word itself and its first letters, so that inflected forms share features."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def text_features(bases: Counter) -> set[str]:
    """Features of a text from its number of different words with each word feature."""
    more = {f"{f}{k}" for f, n in bases.items() if n > 1 for k in REPEATS if n >= k}
    return more.union(bases)


def features(text: str | None) -> set[str]:
    return text_features(Counter(f for w in set(_LETTERS.findall((text or "").lower())) for f in word_features(w)))


def swapped(text: str | None, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> str | None:
    """The text with the identity terms of its sentences swapped within their kind; None without any.

    The replacement follows from the sentence, so it is the same on every run.
    """
    kind_of = {t: tuple(k) for k in kinds for t in k}
    changed = False

    def sentence(s: str) -> str:
        nonlocal changed

        def put(m: re.Match) -> str:
            nonlocal changed
            word = m.group().lower()
            others = [t for t in kind_of.get(word, ()) if t != word]
            if not others:
                return m.group()
            changed = True
            return others[crc32(f"{word} {s}".encode()) % len(others)]

        return _LETTERS.sub(put, s)

    out = " ".join(sentence(s) for s in _SENTENCE.split(text or ""))
    return out if changed else None


@dataclass(frozen=True)
class Model:
    """Weights of the chosen features; at most ``N_FEATURES`` and the identity terms."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        """Function from a text to its score; remembers a bounded number of words."""
        weights, bias = self.weights, self.bias
        bases = {f.rstrip("0123456789") for f in weights}
        memo: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            found: Counter = Counter()
            for w in set(_LETTERS.findall((text or "").lower())):
                hit = memo.get(w)
                if hit is None:
                    if len(memo) >= 200_000:
                        memo.clear()
                    hit = memo[w] = tuple(f for f in word_features(w) if f in bases)
                if hit:
                    found.update(hit)
            z = bias + sum(weights.get(f, 0.0) for f in sorted(text_features(found)))
            return 1.0 / (1.0 + np.exp(-max(-500.0, min(500.0, z))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label, weight) of at most ``rows`` labelled texts outside the held-out part.

    Of each label the rows with the smallest hash of the id, at most half of ``rows`` (bounded, hence
    broadcast to the scan of the texts, which are not shuffled). Equal hashes are told apart by the id. An id
    with several labels, equal or not, is one, toxic if one of them says so; a NULL id or label is none.
    ``weight`` restores the labels' shares.
    """
    key = named(labels, id_col)
    mine = labels.where(
        (remainder(key, HELD_OUT_MOD) != HELD_OUT_REST) & named(labels, label_col).isin(0, 1) & key.isNotNull()
    ).select(key.alias("key"), named(labels, label_col).alias("label"))
    mine = mine.groupBy("key").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in mine.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for label, n in sorted(sizes.items()):
        take = min(n, rows // 2)
        picked = mine.where(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(take)
        parts.append(picked.withColumn("weight", F.lit(n / take)))
    if not parts:
        return docs.sparkSession.createDataFrame([], "text string, label int, weight double")
    picked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = docs.select(named(docs, id_col).alias("key"), whole_text(named(docs, text_col)).alias("text"))
    return texts.join(F.broadcast(picked), "key").select("text", F.col("label").cast("int"), "weight")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, neg, pos): sampled texts of each label that have the feature."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                seen[label].update(features(text))
        names = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo:lo + 50_000]
            yield pd.DataFrame({"feature": part, "neg": [seen[0][f] for f in part], "pos": [seen[1][f] for f in part]})

    parts = sample.mapInPandas(count, "feature string, neg long, pos long")
    return parts.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def _choose(counts: DataFrame, neg: int, pos: int, n: int) -> list[str]:
    """At most ``n`` features that tell the labels apart best, by the G statistic of their 2 x 2 table."""
    a, b = F.col("pos"), F.col("neg")
    total = float(neg + pos)
    cells = [(a, pos, a + b), (b, neg, a + b), (F.lit(pos) - a, pos, F.lit(total) - a - b),
             (F.lit(neg) - b, neg, F.lit(total) - a - b)]
    g = F.lit(0.0)
    for cell, row, col in cells:
        g = g + 2 * F.when((cell > 0) & (col > 0), cell * F.log(cell * total / (F.lit(float(max(row, 1))) * col))).otherwise(0.0)
    ranked = counts.where(a + b >= 3).select("feature", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(n)
    return [r["feature"] for r in ranked.collect()]


def solve(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
          n: int, l2: float = 1e-5, counterfactual: float = 1.0, steps: int = 400, drop: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic loss, by full gradient steps (Adam).

    loss = mean weighted log loss + l2 |w|^2 + counterfactual * mean over pairs of (z - z')^2

    Weights are not negative: a feature is evidence or none, so clean words, however many, cannot
    outvote an insult in a long text. Each step leaves out a share ``drop`` of the features of every
    text (by a fixed random sequence), so that one insult is enough without the others it comes with.
    """

    def pack(xs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, xs), np.int64, len(xs))
        return np.repeat(np.arange(len(xs)), sizes), np.concatenate([*xs, np.empty(0, np.int64)]).astype(np.int64)

    r, c = pack(rows)
    share = weight / weight.sum()
    pr, pc = pack([p for p, _ in pairs])
    qr, qc = pack([q for _, q in pairs])
    w = np.zeros(n + 1)
    prior = float((share * label).sum())
    w[n] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    chance = np.random.default_rng(7)
    for t in range(1, steps + 1):
        use = chance.random(len(r)) >= drop
        ru, cu = r[use], c[use]
        z = np.bincount(ru, w[cu], len(rows)) + w[n]
        d = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
        g = np.append(np.bincount(cu, d[ru], n) + 2 * l2 * w[:n], d.sum())
        if pairs:
            diff = np.bincount(pr, w[pc], len(pairs)) - np.bincount(qr, w[qc], len(pairs))
            diff *= 2 * counterfactual / len(pairs)
            g[:n] += np.bincount(pc, diff[pr], n) - np.bincount(qc, diff[qr], n)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        np.maximum(w[:n], 0, out=w[:n])
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES, counterfactual: float = 1.0,
        kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """Classifier fitted on ``labelled_sample``; without any label every score is 0.5.

    The driver gets the numbers of chosen features of the sampled texts, at most ``rows`` times
    the number of features.
    """
    sample = written(labelled_sample(docs, labels, rows, id_col, text_col, label_col), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes:
        return Model({}, 0.0)
    chosen = _choose(_feature_counts(sample), sizes.get(0, 0), sizes.get(1, 0), n_features)
    terms = [f for k in kinds for t in k for f in word_features(t)]
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *terms]))}

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = lambda t: sorted(vocabulary[f] for f in features(t) if f in vocabulary)
        for b in batches:
            copies = [swapped(t, kinds) for t in b["text"]]
            yield pd.DataFrame({
                "label": b["label"], "weight": b["weight"], "own": [ids(t) for t in b["text"]],
                "copy": [None if t is None else ids(t) for t in copies],
            })

    coded = sample.mapInPandas(encode, "label int, weight double, own array<int>, copy array<int>").toPandas()
    as_ids = lambda x: np.asarray(x, np.int64)
    own = [as_ids(x) for x in coded["own"]]
    order = sorted(range(len(own)), key=lambda i: (coded["label"][i], own[i].tolist()))  # sums don't depend on tasks
    pairs = [(own[i], as_ids(coded["copy"][i])) for i in order if coded["copy"][i] is not None]
    w, b = solve([own[i] for i in order], coded["label"].to_numpy(float)[order], coded["weight"].to_numpy(float)[order],
                 pairs, len(vocabulary), counterfactual=counterfactual)
    return Model({f: float(w[i]) for f, i in vocabulary.items() if w[i] != 0}, b)


def score(text: Column, model: Model) -> Column:
    """Score of every whole text, 0 to 1; NULL and empty texts get that of no feature."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return run(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; other columns are not read, whatever their names.

    NULL and empty texts get the score of no feature, a text of any length is read whole, a score of exactly
    0.5 counts as toxic, and a NULL id is not held out. Equal rows stay as many as they are; an empty
    table gives an empty result.
    """
    scored = docs.select(named(docs, id_col).alias("doc_id"), score(named(docs, text_col), model).alias("score"))
    held = remainder(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_REST
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns as they are.

    Scores are no column, so no name can clash with them. NULL and empty texts are scored like any other; of
    equal rows all go or stay; an empty table stays empty.
    """
    return docs.where(score(named(docs, text_col), model) < threshold)
