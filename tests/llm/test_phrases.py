import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import odd

from tessera.llm import phrases

BREAKS = "\n\x0b\x0c\r"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split(f"[.,;:!?{BREAKS}]", low)]


def plain(docs, threshold, top=2000, longest=5, absorb=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in words_of(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, seen in f.items():
        often = {p: c for p, c in seen.items() if c >= threshold}
        rows = []
        for p, a in often.items():
            w = p.split(" ")
            if len(w) < 2:
                continue
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * c >= absorb * a for q, c in often.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = often[" ".join(w[:k])], often[" ".join(w[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            rows.append((p, a, left, right, n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def corpus(seed=1, n=400):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["New", "York", "ÉTÉ", "straße", "　x", "a\x00b"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for i in range(n):
        w = rng.choice(vocabulary, rng.integers(0, 60), p=share / share.sum())
        glue = rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "!", "\r\n", " : "], len(w), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.03, 0.02, 0.02, 0.03])
        text = "".join(a + b for a, b in zip(w, glue))
        if i % 3 == 0:
            text += " the quick brown fox jumps over the quick brown fox"
        out.append((["en", "de", None, "und", ""][i % 5], text))
    return out


@pytest.mark.parametrize("room", [None, 0])
def test_like_counting_everything(spark, room):
    docs = corpus()
    df = spark.createDataFrame([(g, t, 1, "x", 2) for g, t in docs], "lang string, text string, n int, phrase string, a int").repartition(5)
    got = phrases.mine(df, threshold=7, top=40, room=room)
    assert got.columns == "lang rank phrase a l r n score".split()
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 7, 40)


def test_absorbed_only_by_enough(spark):
    docs = [("en", "a b c")] * 9 + [("en", "a b")] * 1 + [("en", "q r")] * 4
    df = spark.createDataFrame(docs, "lang string, text string")
    for percent in (100, 90, 91):
        got = phrases.mine(df, threshold=4, absorb_percent=percent).collect()
        assert sorted(tuple(r) for r in got) == plain(docs, 4, absorb=percent)


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    counts = [("en", "", 9 * big), ("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big + 1)]
    monkeypatch.setattr(phrases, "frequent", lambda *a: spark.createDataFrame(counts, "lang string, phrase string, n long"))
    got = phrases.mine(spark.createDataFrame([], "lang string, text string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big + 1, 3 * big, 2 * big, 9 * big, 1000 * (big + 1) * 9 * big // (6 * big * big))]


def test_odd_tables(spark):
    got = phrases.mine(odd.table(spark), threshold=3).collect()
    docs = [(r[2], r[1]) for r in odd.rows()]
    assert sorted(tuple(r) for r in got) == plain(docs, 3)
    assert phrases.mine(odd.empty(spark)).collect() == []
    one = spark.createDataFrame([(None, None)], "lang string, text string")
    assert phrases.mine(one).collect() == []


def test_long_texts_in_slices(monkeypatch):
    texts = [("xx", " ".join(corpus(2, 20)[i][1] for i in range(20))), ("y", "word" * 50), ("z", " .,"), ("z", "")]
    import pandas as pd

    def counts(size):
        out = Counter()
        for t, hashes in phrases.portions([pd.DataFrame(texts, columns=["lang", "text"])], 5, size):
            for df in phrases.counted(t, hashes, 5, 16, None):
                for g, p, n in zip(df["lang"], df["phrase"], df["n"]):
                    out[g, p] += n
        return out

    whole = counts(1 << 30)
    want = Counter()
    for g, text in texts:
        for w in words_of(text):
            for k in range(1, 6):
                want.update((g, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    assert whole == want
    assert counts(1) == counts(7) == counts(100) == want
    monkeypatch.setattr(phrases, "KNOWN_WORDS", 3)
    assert counts(50) == want


def test_a_sequence_is_one_row_a_task(spark, monkeypatch):
    import pandas as pd

    texts = [("en", "a b c. New York"), ("de", "a b"), (None, "")] * 200
    batches = lambda: iter([pd.DataFrame([(g or "und", t) for g, t in texts], columns=["lang", "text"])])
    want = Counter({("en", ""): 1000, ("de", ""): 400, ("und", ""): 0})
    for g, t in texts:
        for w in words_of(t):
            want.update((g, " ".join(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))

    def rows():
        return [(r.lang, r.phrase, r.n) for df in phrases.summed_portions(batches(), 5, 16, None, 40) for r in df.itertuples()]

    once = rows()
    assert len(once) == len(want) and {(g, p): n for g, p, n in once} == want
    for name in ("BLOCK_ENTRIES", "KNOWN_WORDS"):  # rows that leave early add up to the same
        with monkeypatch.context() as m:
            m.setattr(phrases, name, 3)
            got = Counter()
            for g, p, n in rows():
                got[g, p] += n
        assert got == want

    sent = []
    schema = "lang string, phrase string, n long, key long"
    plain_map = type(spark.range(0)).mapInPandas

    def seen(df, f, s):
        made = plain_map(df, f, s)
        if s == schema:
            sent.append(made.where("phrase = 'a b'").select("n").collect())
        return made

    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", seen)
    monkeypatch.setattr(phrases.portions, "__defaults__", (40,))
    monkeypatch.setattr(phrases.summed_portions, "__defaults__", (40,))
    df = spark.createDataFrame(texts, "lang string, text string")
    cores = spark.sparkContext.defaultParallelism
    for parts, most in ((1, 2), (cores * 8, 2 * 2 * cores)):  # one row a language and task, and tasks do not follow the files
        got = phrases.mine(df.repartition(parts), threshold=100)
        assert sorted(tuple(r) for r in got.collect()) == plain(texts, 100)
        assert 2 <= len(sent[-1]) <= most and sum(r.n for r in sent[-1]) == 400


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), max_size=60), max_size=8), st.integers(2, 60))
def test_summary_keeps_what_is_frequent(blocks, threshold):
    old = phrases.MERGE_ENTRIES
    phrases.MERGE_ENTRIES = 4
    try:
        total = Counter()
        for b in blocks:
            for k, n in b:
                total[k] += n
        summary = phrases.MisraGries(sum(total.values()), threshold)
        for b in blocks:
            mine = Counter()
            for k, n in b:
                mine[k] += n
            keys = np.array(sorted(mine), np.uint64)
            summary.add(keys, np.array([mine[int(k)] for k in keys], np.int64))
        kept = {int(k) for k in summary.survivors()}
        assert {k for k, n in total.items() if n >= threshold} <= kept
        assert summary.error < threshold and len(summary.keys) <= summary.capacity
        for k, c in zip(summary.keys.tolist(), summary.counts.tolist()):
            assert c <= total[k] <= c + summary.error
    finally:
        phrases.MERGE_ENTRIES = old


def test_survivors_are_few_and_whole(spark):
    docs = [("en", f"rare{i} words{i} here{i}") for i in range(3000)] + [("en", "one two three")] * 50
    df = spark.createDataFrame(docs, "lang string, text string").repartition(6)
    found = phrases.survivors(df, 2, threshold=50).agg(F.sum("n").alias("n")).head()["n"]
    assert 6 <= found <= 200


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    slots = np.unique(rng.integers(0, 1 << 32, 1000, dtype=np.uint64)).astype(np.uint32)
    counts = rng.integers(1, 1 << 31, len(slots))
    a, b = phrases.unpacked(phrases.packed(slots, counts))
    assert (a == slots).all() and (b == counts).all()
