import math
import random
from zlib import crc32

import numpy as np

from tessera.llm import toxicity
from tests.conftest import SF
from tests.llm import odd


def made(spark, n=600, seed=3):
    """Insults make a text toxic; one group's name goes with them in the labelled texts by chance."""
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        w = rng.choices(plain, k=30)
        if toxic:
            w[rng.randrange(30)] = rng.choice(["jerk", "jerks", "moronic", "moronically"])
        if rng.random() < (0.9 if toxic else 0.05):
            w[rng.randrange(30)] = "immigrants"
        docs.append((i, " ".join(w) + "."))
        labels.append((i, toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_swaps_stay_in_their_kind():
    text = "The women met. Old MEN left! Nothing else."
    got = toxicity.swapped(text)
    assert got == toxicity.swapped(text) and got != text
    for a, b in zip(text.lower().split(), got.split()):
        kinds = [k for k in toxicity.IDENTITY_TERMS if a.strip(".!") in k]
        assert b.lower() == a if not kinds else any(b.strip(".!") in k and b != a for k in kinds)
    assert toxicity.swapped("Nothing at all.") is None
    assert toxicity.swapped(None) is None and toxicity.swapped("") is None


def test_penalty_spares_neutral_mentions(spark):
    docs, labels = made(spark)
    neutral = "many immigrants live here and work in the town."
    insult = "what a jerk this is, said the word7 to the word9."
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    fair = toxicity.fit(docs, labels, counterfactual=100.0)
    assert plain.scorer()(neutral) >= 0.5
    assert fair.scorer()(neutral) < 0.5
    assert fair.scorer()(insult) >= 0.5
    assert fair.weights.get("immigrants", 0) < 0.3 * plain.weights["immigrants"]


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.classify(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in found if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    clean = [r for r in found if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_sample_is_bounded_and_leaves_out_the_held_out(spark):
    docs, labels = made(spark)
    from zlib import crc32

    sample = toxicity.labelled_sample(docs, labels, rows=100)
    texts = {r.text for r in sample.collect()}
    assert sample.count() == 100
    ids = {r.doc_id for r in docs.collect() if r.text in texts}
    assert all(crc32(str(i).encode()) % 5 for i in ids)


def test_odd_rows(spark):
    docs, labels = made(spark)
    model = toxicity.fit(docs, labels)
    found = toxicity.classify(odd.table(spark), model).collect()
    assert odd.ordered(r.doc_id for r in found) == odd.ordered(i for i, *_ in odd.rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    left = toxicity.drop_toxic(odd.table(spark), model)
    assert left.schema == odd.table(spark).schema and left.count() == len(odd.rows())
    assert toxicity.classify(odd.empty(spark), model).collect() == []


def test_odd_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (None, 1), (2, None), (6, 0), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd.table(spark), labels)
    assert 0 <= model.scorer()(None) <= 1
    none = toxicity.fit(odd.table(spark), labels.limit(0))
    assert none.scorer()("anything") == 0.5
    assert toxicity.fit(odd.empty(spark), labels).scorer()("") == 0.5


def plain_features(text):
    """Words, their first letters, and first letters that several different words share."""
    words, cur = set(), ""
    for ch in (text or "").lower() + " ":
        if ch.isalpha():
            cur += ch
        else:
            if cur:
                words.add(cur)
            cur = ""
    have = {}
    for w in words:
        for f in [w] + [w[:n] + "-" for n in (4, 5, 6, 7) if len(w) > n]:
            have[f] = have.get(f, 0) + 1
    return set(have) | {f"{f}{k}" for f, n in have.items() for k in (2, 3) if n >= k}


def test_scores_by_brute_force(spark):
    """Every score of the query's documents from the model's weights, word by word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.classify(docs, model).collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(texts[r.doc_id]))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == (r.score >= 0.5)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_solve(rows, label, weight, pairs, n, l2, counterfactual, steps, drop):
    """The same steps on plain lists, one text and one pair after another."""
    total = sum(weight)
    prior = sum(w * y for w, y in zip(weight, label)) / total
    w = [0.0] * n + [math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))]
    m, v = [0.0] * (n + 1), [0.0] * (n + 1)
    chance = np.random.default_rng(7)
    for t in range(1, steps + 1):
        kept = iter(chance.random(sum(map(len, rows))) >= drop)
        g = [2 * l2 * x for x in w[:n]] + [0.0]
        for fs, y, share in zip(rows, label, weight):
            use = [f for f in fs if next(kept)]
            z = sum(w[f] for f in use) + w[n]
            d = share / total * (1 / (1 + math.exp(-z)) - y)
            for f in [*use, n]:
                g[f] += d
        for a, b in pairs:
            diff = 2 * counterfactual / len(pairs) * (sum(w[f] for f in a) - sum(w[f] for f in b))
            for f in a:
                g[f] += diff
            for f in b:
                g[f] -= diff
        for i in range(n + 1):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] -= 0.1 * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-12)
            if i < n:
                w[i] = max(w[i], 0.0)
    return w[:n], w[n]


def test_solve_by_brute_force():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(40)]
    label = np.array([float(0 in r or (5 in r and 2 in r)) for r in rows])
    weight = rng.uniform(0.5, 2, 40)
    pairs = [(rows[i], np.sort(rng.choice(12, 3, replace=False))) for i in range(0, 40, 5)]
    for counterfactual in (0.0, 1.0):
        got = toxicity.solve(rows, label, weight, pairs, 12, 1e-4, counterfactual, 60, 0.3)
        want = plain_solve([r.tolist() for r in rows], label, weight, [(a.tolist(), b.tolist()) for a, b in pairs], 12, 1e-4, counterfactual, 60, 0.3)
        assert np.allclose(got[0], want[0], atol=1e-6) and math.isclose(got[1], want[1], abs_tol=1e-6)


def test_long_texts_ties_and_clashing_names(spark):
    """A text of some megabytes, equal and contradicting labels, columns with the operator's own names."""
    long = "plain words here " * 200_000
    rows = [(i, "you jerk word" if i % 2 else "a kind word", 1.0, 2) for i in range(40)] + [(100, long, 1.0, 2), (101, long + " jerk", 1.0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 0), (4, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert found[100].predicted == 0 and found[101].predicted == 1
    left = toxicity.drop_toxic(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {i for i, r in found.items() if not r.predicted}
