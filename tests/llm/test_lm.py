import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lm
from tessera.llm.common import byte_words
from tests.conftest import SF
from tests.llm import odd


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    c = Counter(w for (_, t, *_), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)))
        for (i, t, *_), h in zip(rows, held)
    ]


def check(found, rows):
    got = sorted(found, key=lambda r: repr((r[0], r[2], round(r[5], 6))))
    want = sorted(brute(rows), key=lambda r: repr((r[0], r[2], round(r[5], 6))))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    check(lm.score(docs).collect(), rows)
    check(lm.score(docs, known=50).collect(), rows)  # most words by the join


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    held = lm.score(docs).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_shuffled_words_score_lower(spark):
    rng = np.random.default_rng(1)
    words = "the old house stood on a hill and the wind blew over it".split()
    rows = [(i, " ".join(words)) for i in range(300)]
    order = [" ".join(rng.permutation(words)) for _ in range(20)]
    found = lm.score(spark.createDataFrame(rows + [(2000 + k, t) for k, t in enumerate(order)], "doc_id long, text string")).collect()
    straight = np.mean([r.score for r in found if r.doc_id < 300])
    mixed = np.mean([r.score for r in found if r.doc_id >= 2000])
    assert straight > mixed + 1


def batch(texts, lex):
    pieces = [[w.encode() for w in t.split()] + [lm.END] for t in texts]
    ids = [[lex.number.get(w, int(lm.code_of([w], 1)[0])) for w in p] for p in pieces]
    sizes = np.array([len(p) for p in ids])
    return lm.Batch(np.concatenate(ids).astype("<u4"), sizes, np.zeros(len(ids), int), np.ones(len(ids), int), lex)


@pytest.mark.parametrize("trained", [False, True])
def test_distribution_sums_to_one(trained):
    c = Counter(f"w{i % 700 * i % 900}" for i in range(20_000))
    c[""] = 500
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    lex = lm.Lexicon([w for w, _ in top], np.array([n for _, n in top]), sum(c.values()), len(c))
    b = batch([" ".join(w for w, _ in top)] * 3, lex)
    t = lm.Trainer(lm.Weights(), lex)
    if trained:
        t.learn(b)
    p = lm._softmax(lm._class_logits(t.w, lex, b, slice(0, 50))[1])
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    at = np.flatnonzero(b.frequent)[:50]
    q = lm._softmax(lm._word_logits(t.w, lex, b, at)[1])
    assert np.allclose(q.sum(1), 1, atol=1e-5)
    rare = sum(n + 1 for _, n in top[lm.CLASSES * lm.MEMBERS:])
    assert rare + 1 == lex.rare_tokens + lex.rare_distinct + 1  # the last one is for all unseen words


def plain_softmax(scores):
    top = max(scores)
    e = [math.exp(x - top) for x in scores]
    return [x / sum(e) for x in e]


def test_score_by_brute_force():
    """Every probability of the classes and words again, one token and one weight at a time."""
    rng = np.random.default_rng(4)
    c = Counter(f"w{i % 600 * i % 700}" for i in range(9000))
    c[""] = 300
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    lex = lm.Lexicon([w for w, _ in top], np.array([n for _, n in top]), sum(c.values()), len(c))
    w = lm.Weights()
    for t in w.tables:
        t += rng.normal(scale=0.3, size=t.shape).astype(np.float32)
    words = [top[i][0] for i in rng.integers(0, len(top), 40)] + ["never", "seen"]
    b = batch([" ".join(words), ""], lex)
    got = lm.log10_probs(w, lex, b)

    def rows(one, two, salt, size):
        out, keep = [], (1 << 64) - 1
        for k, x in enumerate((2 * one + 1, 2 * two, (one + 1) * 1_000_003 + two + 7)):
            h = (x + k * 0x9E3779B1) * 0x9E3779B97F4A7C15 & keep
            h ^= h >> 32
            h = (h ^ salt * 0xC2B2AE3D27D4EB4F & keep) * 0xBF58476D1CE4E5B9 & keep
            out.append(h >> 65 - size.bit_length())
        return out

    n = lm.CLASSES * lm.MEMBERS
    rank = {word: i for i, (word, _) in enumerate(top)}
    coded = lambda word: rank[word] if rank.get(word, n) < n else int(n + lm.code_of([word.encode()], 1)[0] % (lm.START - n))
    counts = [k for _, k in top]
    classes = [sum(counts[i:min(i + lm.MEMBERS, n)]) for i in range(0, n, lm.MEMBERS)] + [sum(counts[n:])]
    at = 0
    for text in ([x for x in words if x], []):
        one = two = lm.START
        for word in [*text, ""]:
            klass = min(rank.get(word, n), n) // lm.MEMBERS
            z = [math.log((k + 1) / (sum(classes) + len(classes))) for k in classes]
            for r in rows(one, two, 0, w.rows):
                z = [a + float(x) for a, x in zip(z, w.of_class[r])]
            want = math.log10(plain_softmax(z)[klass])
            if klass < lm.CLASSES:
                z = [math.log(k + 1) for k in counts[klass * lm.MEMBERS:(klass + 1) * lm.MEMBERS]]
                for r in rows(one, two, klass + 1, w.rows):
                    z = [a + float(x) for a, x in zip(z, w.of_word[r])]
                want += math.log10(plain_softmax(z)[rank[word] % lm.MEMBERS])
            assert math.isclose(got[at], want, rel_tol=1e-4), word
            at, one, two = at + 1, coded(word), one
    assert at == len(got)


def test_rare_words_follow_their_context(spark):
    rng = np.random.default_rng(2)
    filler = " ".join(f"f{i}" for i in range(600)) + " "  # takes all places of frequent words
    pairs = [f"left{i} right{i}" for i in range(200)]
    rows = [(i, filler * 3 + " ".join(rng.permutation(pairs))) for i in range(40)]
    rows += [(1000 + i, f"left{i} right{i}") for i in range(100)] + [(2000 + i, f"left{i} right{i + 1}") for i in range(100)]
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 1000").collect()
    right = np.mean([r.score for r in found if r.doc_id < 2000])
    wrong = np.mean([r.score for r in found if r.doc_id >= 2000])
    assert right > wrong + 0.2


def test_model_grows_with_the_corpus():
    assert [lm.table_rows(n) for n in (0, 1 << 27, 3 << 26, 1 << 40)] == [1 << 14, 1 << 14, 1 << 15, lm.MOST_ROWS]
    assert [lm.shard_digits(n * lm.SHARD_TOKENS) for n in (0, 1, 2, 8, 9, 4096, 1 << 40)] == [0, 0, 1, 1, 2, 4, lm.MOST_DIGITS]
    assert [lm.chunk_count(n * lm.CHUNK_TOKENS) for n in (0, 1, 2, 1000)] == [2, 2, 2, 1000]


@pytest.mark.parametrize("weights", [False, True])
def test_words_of_all_shards_sum_to_one(weights):
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 1 << 32, 3000))
    n = rng.integers(1, 9, len(code))
    tokens = np.bincount(code >> 29, n + 1, lm.BRANCH)
    lex = lm.Lexicon([], np.zeros(0, int), n.sum(), len(n), 1, lm.path_bias(tokens, 1))
    w = lm.Weights()
    w.of_digit += rng.normal(size=w.of_digit.shape).astype(np.float32)
    total = 0
    for shard in range(lm.BRANCH):
        own = code >> 29 == shard
        mine, count = code[own].astype(np.uint32), n[own]
        learnt = np.repeat(mine, count)
        one, two = rng.integers(0, 40, (2, len(learnt)))
        asked = np.concatenate([mine, [(shard << 29) + 5]])  # the last one has no count
        x = [np.concatenate(p).astype(np.uint32) for p in ((one, np.full(len(asked), 7)), (two, np.full(len(asked), 8)), (learnt, asked))]
        times = (np.arange(len(x[0])) < len(learnt)).astype(int) * (3 if weights else 1)
        p = lm.shard_log10_probs(w, lex, mine, count, *x, times)
        order = rng.permutation(len(times))
        assert np.allclose(lm.shard_log10_probs(w, lex, mine[::-1], count[::-1], *[v[order] for v in x], times[order]), p[order])
        if weights:  # a token with a weight is as many tokens
            again = [np.concatenate([v[:len(learnt)]] * 3 + [v[len(learnt):]]) for v in x]
            more = (np.arange(len(again[0])) < 3 * len(learnt)).astype(int)
            assert np.allclose(lm.shard_log10_probs(w, lex, mine, count, *again, more)[3 * len(learnt):], p[len(learnt):])
        given = 10 ** p[len(learnt):]
        total += given[:-1].sum()
        assert np.isclose(given[-1], 1 / (n.sum() + len(n) + 1))
    assert np.isclose(total + given[-1], 1, atol=1e-4)


def scores(found):
    return sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), r.score) for r in found)


def test_scores_do_not_depend_on_files_or_tasks(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(2).write.parquet(str(tmp_path / "two"))
    docs.orderBy("text").repartition(16).write.parquet(str(tmp_path / "many"))
    a, b = (scores(lm.score(spark.read.parquet(str(tmp_path / d))).collect()) for d in ("two", "many"))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], rtol=1e-5)


def test_long_texts_in_pieces(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = lm.score(docs).collect()
    monkeypatch.setattr(lm, "PIECE_TOKENS", 50)
    cut = lm.score(docs).collect()
    check(cut, [tuple(r) for r in docs.collect()])
    # updates end elsewhere, so scores differ a little
    assert np.corrcoef([x[3] for x in scores(whole)], [x[3] for x in scores(cut)])[0, 1] > 0.999


def test_copies_are_one_piece(spark):
    rows = [(i, "same words again and again") for i in range(300)] + [(300 + i, f"other text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lex = lm.lexicon(lm.written(lm.count_words(lm.learnable(df, "doc_id", "text")), "c"))
    tokens = lm.tokenized(df, lex, lm.sent(spark, lex), "doc_id", "text")
    chunks = tokens.where("tokens is not null").collect()
    assert max(max(r.times) for r in chunks) > 20 and sum(sum(r.times) for r in chunks) == 320
    assert all(len(r.sizes) == len(r.times) and sum(r.times) == len(r.docs) and sum(r.sizes) == len(lm._unsqueezed(r.tokens, "<u4")[0]) for r in chunks)
    assert tokens.where("doc is not null").select("doc").distinct().count() == 320
    check(lm.score(df).collect(), rows)


def test_hot_word_spreads_over_parts(spark, monkeypatch):
    """One word of no class holds half of a shard's tokens: the shard is parted by context."""
    rng = np.random.default_rng(6)
    filler = " ".join(f"f{i}" for i in range(600)) + " aa bb" * 60  # these two take the places of frequent words
    rows = [(i, filler + " " + " ".join(f"c{rng.integers(300)} hot" if rng.random() < 0.5 else f"x{rng.integers(400)}" for _ in range(60))) for i in range(60)]
    monkeypatch.setattr(lm, "CLASSES", 1)
    monkeypatch.setattr(lm, "MEMBERS", 2)
    monkeypatch.setattr(lm, "RARE", 1)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lex = lm.lexicon(lm.written(lm.count_words(lm.learnable(df, "doc_id", "text")), "c"))
    shard = int(lm.shard_of(lm.code_of([b"hot"], 1), lex.digits)[0])
    assert lex.parts.get(shard, 1) > 1
    some = rng.integers(0, 1 << 20, 1000)
    parts = lm.part_of(some, some[::-1], np.full(1000, shard), lex)
    assert set(parts.tolist()) == set(range(lex.parts[shard]))
    check(lm.score(df).collect(), rows)


def test_parts_when_digits_end(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1 << 9)
    monkeypatch.setattr(lm, "MOST_DIGITS", 1)
    lex = lm.lexicon(lm.written(lm.count_words(lm.learnable(docs, "doc_id", "text")), "c"))
    assert lex.digits == 1 and lex.least_parts > 2
    check(lm.score(docs).collect(), [tuple(r) for r in docs.collect()])


def test_many_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1 << 11)
    found = lm.score(docs).collect()
    check(found, [tuple(r) for r in docs.collect()])
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    check(lm.score(odd.table(spark)).collect(), odd.rows())
    assert lm.score(odd.empty(spark)).collect() == []
    held = [i for i in range(100) if crc32(str(i).encode()) % 7 == 2][:3]
    found = lm.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in found] == [(0, 0, 0.0)] * 3


def test_all_tasks_add_up(spark):
    rows = [(k % 5, k, np.full(3, float(k)).astype("<f4").tobytes()) for k in range(40)]
    parts = spark.createDataFrame(rows, "block int, salt int, values binary").repartition(8)
    twice = lm._add_up(lm._add_up(parts.repartition("block", "salt")).repartition("block"))
    got = {r.block: np.frombuffer(r["values"], "<f4").tolist() for r in twice.collect()}
    assert got == {b: [float(sum(range(b, 40, 5)))] * 3 for b in range(5)}


def test_columns_are_kept_byte_by_byte():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 1 << 16, 77).astype("<u2"), rng.integers(0, 1 << 32, 77).astype("<u4"), rng.normal(size=77).astype("<f8")]
    back = lm._unsqueezed(lm._squeezed(*cols), "<u2", "<u4", "<f8")
    assert all((a == b).all() for a, b in zip(cols, back))
    assert [len(x) for x in lm._unsqueezed(lm._squeezed(*[c[:0] for c in cols]), "<u2", "<u4", "<f8")] == [0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text("aZ\u0130\u00c4\u00df \t\n\v\f\r\x1c\x1f\x85\xa0\u2003\u3000\0", max_size=12), max_size=8), st.integers(1, 12), st.integers(0, 2))
def test_words_of_many_texts_at_once(texts, most, skip):
    old, lm.SPLIT_BYTES = lm.SPLIT_BYTES, most
    try:
        found = [[] for _ in texts[skip:]]
        for at, words, sizes in lm.split_texts(pa.array(texts, pa.string())[skip:]):
            cuts = np.cumsum(sizes)
            assert cuts[-1] == len(words)
            for k, (lo, hi) in enumerate(zip(cuts - sizes, cuts)):
                found[at + k] = [w.encode() for w in words[lo:hi].to_pylist()]
        assert found == [byte_words(t) for t in texts[skip:]]
    finally:
        lm.SPLIT_BYTES = old


@pytest.mark.parametrize("counted,held", [(1, 1), (1, 200), (200, 1), (1 << 26, 1 << 25)])
def test_words_are_counted_part_by_part(spark, monkeypatch, counted, held):
    monkeypatch.setattr(lm, "COUNTED_BYTES", counted)
    monkeypatch.setattr(lm, "HELD_BYTES", held)
    monkeypatch.setattr(lm, "SPLIT_BYTES", 40)
    texts = [" ".join(f"W{i * k % 23}" for k in range(i % 9)) + " " * (i % 3) for i in range(200)] + [None, "", "\n"]
    found = lm.count_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = Counter(w or "" for t in texts for w in tokens(t))
    assert {r.word: r.n for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("known", [0, 1, 3, 300])
def test_texts_of_known_and_other_words(spark, known):
    """The end of a text among the known words, and not; words of all texts looked up at once."""
    rows = [(i, " ".join(["the"] * 9 + [f"w{i % 7}", f"x{i}"] * (i % 4)) if i % 5 else None) for i in range(60)]
    check(lm.score(spark.createDataFrame(rows, "doc_id long, text string"), known=known).collect(), rows)


def test_step_by_plain_sums():
    rng = np.random.default_rng(5)
    for size, width, n in ((64, 17, 500), (lm.ROW_BLOCK * 2, 8, 3000), (lm.ROW_BLOCK + 8, 3, 1)):
        table, squares = rng.normal(size=(size, width)).astype(np.float32), rng.random((size, width)).astype(np.float32)
        rows, p = rng.integers(0, size, (3, n)), rng.normal(size=(n, width)).astype(np.float32)
        g = lm.L2 * table.astype(float)
        for r in rows:
            for k in range(n):
                g[r[k]] += p[k]
        more = squares + g * g
        want = table - lm.RATE * g / (np.sqrt(more) + lm.DAMPING)
        lm._update(table, squares, rows, p)
        assert np.allclose(table, want, atol=1e-5) and np.allclose(squares, more, rtol=1e-4)


def test_order_of_hashes():
    code = np.random.default_rng(7).integers(0, 1 << 32, 5000).astype(np.uint32)
    code = np.concatenate([code, code[:900], code & 0xFFFF, code & 0xFFFF0000])
    assert (lm.hash_order(code) == np.argsort(code, kind="stable")).all()
    assert len(lm.hash_order(code[:0])) == 0


def test_tasks_get_no_table_of_python_words(spark):
    """Words are looked up a batch at a time: a table of them in Python took most of the time of a task."""
    lex = lm.Lexicon(["", "a"], np.array([2, 1]), 3, 2)
    assert lex.number == {b"": 0, b"a": 1}
    fresh = lm.Lexicon(["", "a"], np.array([2, 1]), 3, 2)
    assert "number" not in lm.sent(spark, fresh).value
