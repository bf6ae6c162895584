import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tests.llm import odd


def brute(rows):
    """Per text: size and the id that stays."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    low = lambda i: (i is not None, i or 0)
    return {t: (max(ids, key=low), len(ids)) for t, ids in groups.items()}


def check(found, rows):
    want = brute(rows)
    got = defaultdict(list)
    for r in found:
        got[bytes(r.digest)].append(r)
    for t, (keep, size) in want.items():
        mine = got[hashlib.sha256(t.encode()).digest()]
        assert len(mine) == size
        assert {(r.keep_id, r.group_size) for r in mine} == {(keep, size)}
        assert [r.doc_id for r in mine if r.kept] == [keep]


def test_odd_rows(spark):
    found = exact_dedup.duplicates(odd.table(spark)).collect()
    assert len(found) == len(odd.rows())
    check(found, odd.rows())


def test_many_batches_go_on_from_the_state(spark):
    rows = [(i, f"text {i % 37}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    check(exact_dedup.duplicates(df, batch_bytes=1).collect(), rows)


def test_later_arrivals(spark, tmp_path):
    schema = "doc_id long, digest binary, _place_file string, _place_row long"
    for k, ids in enumerate(([1, 2], [3])):
        rows = [(i, bytearray(b"x" if i != 2 else b"y"), "f", i) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        exact_dedup.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), spark.createDataFrame([], schema).schema)
        state = {bytes(r.digest): (r.newest[0], r.n) for r in exact_dedup.read_state(spark, str(tmp_path / "state")).collect()}
        assert state == ({b"x": (1, 1), b"y": (2, 1)} if not k else {b"x": (3, 2), b"y": (2, 1)})


def test_equal_digests_of_different_texts(spark):
    rows = [(i, f"t{i % 23}") for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    want = brute(rows)
    for r in exact_dedup.duplicates(df, digest=weak).collect():
        text = dict(rows)[r.doc_id] or ""
        assert (r.keep_id, r.group_size, r.kept) == (*want[text], r.doc_id == want[text][0])


def test_survivors_keep_their_columns(spark):
    df = odd.table(spark)
    left = exact_dedup.keep_newest(df)
    assert left.schema == df.schema
    assert {(r.doc_id, r.text or "") for r in left.collect()} == {(k, t) for t, (k, _) in brute(odd.rows()).items()}
    assert left.count() == len(brute(odd.rows()))


def test_empty(spark):
    assert exact_dedup.duplicates(odd.empty(spark)).collect() == []
    assert exact_dedup.keep_newest(odd.empty(spark)).collect() == []
