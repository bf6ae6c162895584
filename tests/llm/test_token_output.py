from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, token_output
from tests.llm import odd

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = token_output.Tokenizer(PATH)


def slow_best_fit(sizes, width):
    free, out = [], [0] * len(sizes)
    since = []  # when a row got its present free space
    clock = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [r for r, f in enumerate(free) if f >= sizes[i]]
        r = min(fit, key=lambda r: (free[r], since[r])) if fit else len(free)
        if not fit:
            free.append(width)
            since.append(0)
        clock += 1
        free[r] -= sizes[i]
        since[r] = clock
        out[i] = r
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, w), max_size=60))))
def test_best_fit(case):
    width, sizes = case
    got = token_output.best_fit(sizes, width)
    assert got == slow_best_fit(sizes, width)
    load = Counter()
    for r, n in zip(got, sizes):
        load[r] += n
    assert all(n <= width for n in load.values())


def test_pieces():
    assert token_output.pieces(0, 4) == [(0, 0)]
    assert token_output.pieces(9, 4) == [(0, 4), (4, 4), (8, 1)]


def check(df, rows, tmp_path, **options):
    df = df.withColumn("text", F.regexp_replace("text", "<\\|endoftext\\|>", "end"))  # special in one library only
    written = [r.asDict(recursive=True) for r in token_output.write(df, str(tmp_path / "out"), PATH, **options).collect()]
    parts = defaultdict(list)
    for m in written:
        assert m["cu_seqlens"][0] == 0 and m["cu_seqlens"][-1] == m["n_rows"] * m["row_tokens"]
        assert m["position_resets"] == m["cu_seqlens"][:-1]
        positions = token_output.position_ids(m["cu_seqlens"]).reshape(m["n_rows"], -1)
        assert (positions[:, 0] == 0).all()
        assert len(m["ids"]) == m["n_rows"] * m["row_tokens"] * m["id_bytes"]
        for s, (key, start, ids) in zip(m["segments"], token_output.unpack(m)):
            assert positions[s["row"], s["at"]:s["at"] + s["length"]].tolist() == list(range(s["length"]))
            parts[key].append((start, ids.tolist()))
    encoder = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")).encoder
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = encoder.encode([(t or "").replace("<|endoftext|>", "end")])[0].tolist()
        want[i] += [(s, ids[s:s + n]) for s, n in token_output.pieces(len(ids), options.get("row_tokens", token_output.ROW_TOKENS))]
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    return written


def test_lossless(spark, tmp_path):
    rows = [(i, "some words here " * (i % 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    written = check(df, rows, tmp_path, row_tokens=64, matrix_rows=4, chunk_tokens=5000)
    assert len({m["matrix_id"] for m in written}) == len(written)
    filled = sum(m["n_tokens"] for m in written) / sum(m["n_rows"] * m["row_tokens"] for m in written)
    assert filled > 0.95


def test_odd_rows(spark, tmp_path):
    check(odd.table(spark), odd.rows(), tmp_path)
    assert token_output.pack(odd.empty(spark), PATH).collect() == []
    assert np.dtype("<u2").itemsize == token_output.pack(odd.table(spark), PATH).head()["id_bytes"]


def test_long_runs(spark, tmp_path):
    runs = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x" + " \t" * 400_000 + "y", "ab'll 12 " * 120_000, "é" * 300_000 + " ."]
    rows = list(enumerate(runs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(df, rows, tmp_path)


@settings(max_examples=60, deadline=None)
@given(st.text("ab1 .'\n\tsé\u3000", max_size=120), st.integers(1, 12))
def test_parts_of_a_text_encode_as_the_whole(text, part):
    old, token_output.PART_CHARS = token_output.PART_CHARS, 1 << 14
    try:
        whole = TOKENIZER.encode(text).tolist()
        token_output.PART_CHARS = part
        assert TOKENIZER.encode(text).tolist() == whole
    finally:
        token_output.PART_CHARS = old


def test_many_empty_texts(spark, tmp_path):
    df = spark.range(100_000).selectExpr("id as doc_id", "case when id % 2 = 0 then '' end as text").coalesce(2)
    got = token_output.write(df, str(tmp_path / "out"), PATH, chunk_docs=1000)
    sizes = [len(r.segments) for r in got.select("segments").collect()]
    assert sum(sizes) == 100_000 and max(sizes) == 1000


def test_parts_do_not_end_between_white_space_and_a_word(monkeypatch):
    for text in ("11\n\n1", "ab \t\n.", "a\n\n\nb\n\n1"):
        whole = TOKENIZER.encode(text).tolist()
        for part in range(1, 8):
            monkeypatch.setattr(token_output, "PART_CHARS", part)
            assert TOKENIZER.encode(text).tolist() == whole
        monkeypatch.undo()
