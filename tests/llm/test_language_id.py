import math
from zlib import crc32

import numpy as np

from tessera.llm import language_id
from tests.conftest import SF
from tests.llm import odd


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs)).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_gram_counts_are_those_of_the_letters():
    a = language_id.gram_counts("Ab, 12 c!")
    assert (a == language_id.gram_counts("ab c")).all()
    n = len(" ab c ")
    assert a.sum() == n + (n - 1) + (n - 2)
    long = "wörter und mehr " * 100_000
    whole = language_id.gram_counts(long)
    size = len(f" {long.strip()} ".encode())
    assert whole.sum() == 3 * size - 3
    for none in (None, "", " ", "123 !?"):
        assert language_id.gram_counts(none) is None


def test_clusters_of_one_language():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(8)[k] + 0.05 * rng.random((30, 8)) for k in (0, 3, 5)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers = language_id.cluster(x, 3)
    assert sorted(centers.argmax(1)) == [0, 3, 5]
    assert len(language_id.cluster(x[:1], 4)) == 1


def test_far_texts_are_rejected(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 5, "en") for i in range(40)] + [
        (100 + i, "der hund und die katze liegen auf dem teppich " * 5, "de") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the dog and the cat") [0::2] == ("en", False)
    assert model.predict("жук жук жук щука щука")[2]


def test_unlearnt_languages_and_random_letters_are_rejected(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(docs)
    rng = np.random.default_rng(0)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem "
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
    for n in (30, 100, 300, 1000, 3000):
        assert model.predict(" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(n)))[2]
        assert model.predict("".join(map(chr, rng.integers(0x4E00, 0x9FA5, 3 * n))))[2]
    for text in (polish, finnish):
        assert model.predict(text)[2] and model.predict(text * 5)[2]


def test_odd_rows(spark):
    docs = odd.table(spark)
    model = language_id.fit(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, model).where("doc_id is not null").collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (3, 4, 5, 8))
    assert found[6].lang_pred in model.langs
    assert language_id.identify(docs, model).count() == len(odd.rows())
    left = language_id.drop_unknown(docs, model)
    assert left.schema == docs.schema and 0 < left.count() < len(odd.rows())
    none = language_id.fit(odd.empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(odd.empty(spark), model).collect() == []


def test_sample_bound(spark):
    rows = [(i, f"some words {i}", f"l{i % 7}") for i in range(700)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=21, clusters=2)
    assert len(model.langs) == 7 and len(model.centers) <= 14


def plain_grams(text):
    """Hashed n-grams of the letters, one after another."""
    low = "".join(c if c.isalpha() else " " for c in text or "")
    plain = " ".join(low.split()).lower()
    if not plain:
        return None
    data, keep, out = f" {plain} ".encode(), (1 << 32) - 1, {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            h = n
            for k, b in enumerate(data[i:i + n]):
                h = (h ^ b) * (2654435761, 2246822519, 3266489917)[k] & keep
                h ^= h >> 15
            bin_ = (h * 2654435761 & keep) >> (32 - language_id.BINS.bit_length() + 1)
            out[bin_] = out.get(bin_, 0) + 1
    return out


def test_predictions_by_brute_force(spark):
    """Document frequencies, TF-IDF and cosines of the whole table in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    grams = {i: plain_grams(r.text) for i, r in rows.items()}
    held = {i: crc32(str(i).encode()) % 3 == 1 for i in rows}
    learnt = [g for i, g in grams.items() if not held[i] and rows[i].lang is not None and g]
    df = [0] * language_id.BINS
    for g in learnt:
        for b in g:
            df[b] += 1
    idf = [math.log((1 + len(learnt)) / (1 + n)) + 1 for n in df]
    assert np.allclose(model.idf, idf)
    for r in language_id.identify(docs, model).collect():
        g = grams[r.doc_id]
        assert r.held_out == held[r.doc_id]
        if g is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = {b: math.log1p(n) * idf[b] for b, n in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        sims = [sum(v / size * float(c[b]) for b, v in x.items()) for c in model.centers]
        best = max(sims)
        assert math.isclose(r.score, min(1.0, max(0.0, best)), abs_tol=1e-4)
        near = {model.langs[o] for o, s in zip(model.owner, sims) if s > best - 1e-4}
        assert r.lang_pred in near
        least = model.least[model.langs.index(r.lang_pred), min(31, sum(g.values()).bit_length())]
        assert r.rejected == (r.score < least) or abs(r.score - least) < 1e-4


def test_clusters_by_brute_force():
    """Far-apart starts and rounds of the nearest centre on plain lists."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(40, 6))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dot = lambda a, b: sum(float(p) * float(q) for p, q in zip(a, b))
    chosen = [0]
    while len(chosen) < 3:
        chosen.append(min(range(40), key=lambda i: max(dot(x[i], x[c]) for c in chosen)))
    centers = [[float(v) for v in x[c]] for c in chosen]
    for _ in range(10):
        own = [max(range(3), key=lambda c: dot(r, centers[c])) for r in x]
        for c in range(3):
            total = [sum(float(r[d]) for r, o in zip(x, own) if o == c) for d in range(6)]
            size = math.sqrt(sum(v * v for v in total))
            if size:
                centers[c] = [v / size for v in total]
    assert np.allclose(language_id.cluster(x, 3), centers, atol=1e-4)


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 5, "en", 0.1, True) for i in range(30)] + [(99, "the cat and the dog " * 200_000, "en", 0.1, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean")
    model = language_id.fit(docs)
    left = language_id.drop_unknown(docs, model)
    assert left.schema == docs.schema and left.count() == 31
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"en"}
