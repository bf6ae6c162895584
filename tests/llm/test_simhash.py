import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash
from tessera.llm.components import components
from tests.llm import odd


def slow_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.text("aB é\n\t\x1c ", max_size=40), st.integers(1, 4))
def test_fingerprint(text, n):
    assert simhash.fingerprint(text, n) == slow_fingerprint(text, n)


def test_known_hash(spark):
    """The hash is the engine's own xxhash64 of the shingle."""
    from pyspark.sql import functions as F

    want = spark.range(1).select(F.xxhash64(F.lit("a b c"))).head()[0]
    assert xxhash.xxh64_intdigest(b"a b c", 42) == want % (1 << 64)


@pytest.mark.parametrize("index_bytes", [1, 2, 4, 5])
def test_links_are_all_near_pairs(spark, index_bytes):
    rng = np.random.default_rng(index_bytes)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = []
    for x in base.tolist():
        for k in range(6):  # a dense cluster around each, and a few of its own neighbours
            bits = rng.choice(64, k, replace=False).tolist()
            near.append((x ^ sum(1 << b for b in bits)) % (1 << 64))
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in fps + fps[:50]], "fp long")
    got = [tuple(r) for r in simhash.links(df, index_bytes=index_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    other = [(200, 200), (None, 3), (201, 202), (202, 201)]
    df = spark.createDataFrame(chain + star + other, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    clean = [(a, b) for a, b in chain + star + other if a is not None and a != b]
    assert got == groups(clean, {x for p in clean for x in p})
    assert components(df.limit(0)).collect() == []


def test_odd_rows(spark):
    rows = odd.rows()
    found = simhash.near_duplicates(odd.table(spark)).collect()
    assert len(found) == len(rows)
    fps = {slow_fingerprint(t) for _, t, *_ in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    group = groups(pairs, fps)
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[group[slow_fingerprint(t)]].append(i)
    first = {g: min((i for i in xs if i is not None), default=None) for g, xs in ids.items()}
    want = [(i, f"{slow_fingerprint(t):016x}", first[group[slow_fingerprint(t)]]) for i, t, *_ in rows]
    assert odd.ordered((r.doc_id, r.fingerprint, r.component_id) for r in found) == odd.ordered(want)
    assert sum(r.keep for r in found) == len(ids)
    df = odd.table(spark)
    left = simhash.keep_one(df)
    assert left.schema == df.schema
    assert odd.ordered(r.doc_id for r in left.collect()) == odd.ordered(first.values())


def test_empty(spark):
    assert simhash.near_duplicates(odd.empty(spark)).collect() == []
    assert simhash.keep_one(odd.empty(spark)).collect() == []
