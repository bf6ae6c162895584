from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import odd

from tessera.llm import filter_audit

LETTERS = "ABCDE"


def plain(docs, labels):
    """{(part, order, step): row} by removing documents one filter after another."""
    texts = [(i, "" if t is None else t, g or "") for i, t, g in docs]

    def failed(i, t):
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        return {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        }

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = {}
    for part in {g for *_, g in texts}:
        mine = [(i, failed(i, t)) for i, t, g in texts if g == part]
        shapley = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = mine
            for k, c in enumerate(order):
                gone = [x for x in left if x[1][c]]
                left = [x for x in left if not x[1][c]]
                shapley[c] += len(gone)
                fails = [f for _, f in mine if f[c]]
                rows[part, "".join(order), k + 1] = [
                    len(left), len(gone), len(fails) - len(gone), sum(sum(f.values()) == 1 for f in fails),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c,
                ]
        for (p, *_), row in rows.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return rows


def test_like_removing_one_after_another(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [(r[0], r[1], r[2]) for r in odd.rows()] + [
        (20, long, "en"), (21, long, "fr"), (22, long + " 5%", "en"), (23, long.upper(), "en"), (24, "a b " * 60, "en"),
        (25, "A#", ""), (26, "a b " * 60, None), (-1, "", "de"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (21, 1, 1), (23, None, 1), (None, 1, 1), (99, 1, 1), (24, 1, 0), (24, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("x") for c in ("part", "digest", "w", "kept", "A")}
    )
    got = filter_audit.interactions(df.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(docs, labels)
    assert len(got) == len(want) == 120 * 5 * 4
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.interactions(odd.empty(spark), labels)
    assert found.collect() == []
    assert found.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.interactions(odd.table(spark), labels).where("step = 5").collect()
    assert {r.part: r.kept for r in found}.keys() == {"", "en", "de", "fr"}
    assert sum(r.kept for r in found if r.filter_order == "ABCDE") == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=8, max_size=8))
def test_potential_gives_shapley(counts):
    v = filter_audit.coalition_values(np.array(counts), 3)
    for s in range(8):
        assert v[s] == sum(c for t, c in enumerate(counts) if s & t)
    p = filter_audit.potentials(v)
    for i in range(3):
        total = 0
        for order in permutations(range(3)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += int(v[before | 1 << i] - v[before])
        assert p[7] - p[7 ^ 1 << i] == total
    assert p[7] - p[6] + p[7] - p[5] + p[7] - p[3] == 6 * v[7]


def test_other_filters(spark):
    df = spark.createDataFrame([("p", True, None), ("p", True, True), ("p", False, True), ("q", False, False)], "part string, x boolean, y boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(df, {"X": "x", "Y": "y"}).collect()}
    assert got["p", "XY", 1] == (1, 2, 0, 1, 3)
    assert got["p", "XY", 2] == (0, 1, 1, 1, 3)
    assert got["q", "YX", 2] == (1, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(df, {"long": "x"})
