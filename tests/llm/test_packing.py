from collections import Counter, defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing
from tests.llm import odd


def waste(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    got = packing.best_boundaries(lengths, counts, k)
    assert got == sorted(set(got)) and set(got) <= set(lengths) and len(got) <= k and got[-1] == lengths[-1]
    best = min(
        waste(lengths, counts, [*c, lengths[-1]])
        for size in range(min(k, len(lengths))) for c in combinations(lengths[:-1], size)
    )
    assert waste(lengths, counts, got) == best


def test_no_lengths():
    assert packing.best_boundaries([], [], 4) == []


def packed(df, **options):
    return [r.asDict() for r in packing.pack(df, **options).collect()]


def check(rows, want_lengths, batch_tokens):
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter(want_lengths)
    batches = defaultdict(list)
    for r in rows:
        batches[r["batch_id"]].append(r)
        assert r["n_tokens"] <= r["padded_length"]
        assert (r["bucket"] == -1) == (r["n_tokens"] > batch_tokens)
    for b in batches.values():
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len({(r["bucket"], r["padded_length"]) for r in b}) == 1
        assert len(b) == 1 or len(b) * b[0]["padded_length"] <= batch_tokens
    return batches


def test_batches_fill_the_budget(spark):
    rows = [(i, i * i % 97) for i in range(3000)] + [(5000, 300), (5001, 129)]
    df = spark.createDataFrame(rows, "doc_id long, n int")
    got = packed(df.withColumn("text", F.lit("")), n_tokens=F.col("n"), n_buckets=4, batch_tokens=128)
    batches = check(got, rows, 128)
    per_bucket = Counter(b[0]["bucket"] for b in batches.values())
    for bucket, n in per_bucket.items():
        docs = [r for r in got if r["bucket"] == bucket]
        if bucket >= 0:
            fits = 128 // max(docs[0]["padded_length"], 1)
            full = sum(len(b) == fits for b in batches.values() if b[0]["bucket"] == bucket)
            assert n - full <= -(-len(docs) // (fits * packing.BATCHES_PER_SLICE))


def test_odd_rows(spark):
    import re

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    check(packed(odd.table(spark), batch_tokens=10_000), [(i, count(t)) for i, t, *_ in odd.rows()], 10_000)
    assert packed(odd.empty(spark)) == []
    assert {r["bucket"] for r in packed(odd.table(spark).where("doc_id = 6"), batch_tokens=10)} == {-1}
