import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe
from tests.conftest import SF
from tests.llm import odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
V = bpe.Vocabulary(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_every_character():
    """Words break where the library breaks them, whatever the character."""
    for lo in range(0, 0x110000, 0x400):
        chars = [chr(c) for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1 {c}{c}! " for c in chars)
        assert V.encoder.encode([text])[0].tolist() == library(text), hex(lo)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "b", "th", "e", "ing", "'", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "\x1c", "1", "99", "é", "漢", "!", "...", "<|endoftext|>", "<|", "　"]
), max_size=25).map("".join))
def test_texts(text):
    ids = V.encoder.encode([text])[0]
    assert ids.tolist() == library(text)
    assert bpe.decode(ids, V) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30))
def test_decode_any_ids(data):
    ids = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.uint32) % 50_257
    assert bpe.decode(ids, V) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_pairs_against_exact_merging():
    """A pair is compatible exactly if merging its bytes gives the pair back."""
    rng = random.Random(5)
    plain = [t for t in range(50_000) if 1 < len(V.bytes[t]) < 8]
    pairs = [(rng.choice(plain), rng.choice(plain)) for _ in range(4000)]
    pairs += [(t, t) for t in rng.sample(plain, 500)] + [(V.ids[b"a"], V.ids[b"a"]), (V.ids[b" "], V.ids[b" t"])]
    got = V.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = [V.merged(V.bytes[a] + V.bytes[b]) == [a, b] for a, b in pairs]
    assert got.tolist() == want and not all(want)


def test_tokens_that_encode_to_themselves():
    for t in random.Random(1).sample(range(50_256), 3000):
        assert (V.merged(V.bytes[t]) == [t]) == V.whole[t]


def test_only_failing_words_are_merged(monkeypatch):
    exact = []
    many = bpe.Vocabulary.merged_many
    monkeypatch.setattr(bpe.Vocabulary, "merged_many", lambda self, ws: exact.extend(ws) or many(self, ws))
    words = [w.encode() for w in (" the", " thentinger", "ation", " onthhaed", "erre", "zzzzzzz")]
    got = V.encode_words(words)
    assert [g == V.longest(w) for g, w in zip(got, words)].count(False) == len([w for w in exact if V.longest(w) != LIBRARY.encode(w.decode()).ids])
    assert got == [library(w.decode()) for w in words]
    assert 0 < len(exact) < len(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcthe ing1é漢'", min_size=1, max_size=10).map(lambda t: t.encode()).filter(lambda w: len(w) <= 32), max_size=20))
def test_merging_many_words_is_merging_each(words):
    assert V.merged_many(words) == [V.merged(w) for w in words]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 200)
    encoder = bpe.Encoder(V)
    texts = [" ".join(f"word{i}x{k}" for k in range(20)) for i in range(60)]
    assert [e.tolist() for e in encoder.encode(texts)] == [library(t) for t in texts]
    assert len(encoder._now) < 50 + 200 and len(encoder._size) < 2 * (50 + 200)


@pytest.mark.parametrize("long", ["x" * 100_000, " " * 5000 + "y", "ab" * 20_000, "\n" * 3000])
def test_long_words(long):
    assert V.encoder.encode([long])[0].tolist() == library(long)


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd.table(spark)):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library(r.text)
            back = LIBRARY.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode())))
        assert odd.ordered(map(tuple, bpe.round_trip(df, PATH).collect())) == odd.ordered(want)
    ids = {r.doc_id: bytes(r.ids) for r in bpe.encode(odd.table(spark), PATH).collect()}
    assert ids[3] == ids[4] == b""
    assert bpe.round_trip(odd.empty(spark), PATH).collect() == []
