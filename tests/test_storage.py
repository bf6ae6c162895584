import contextlib
import io
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import as_float32, frame, matrix

from tessera import scale
from tessera.functions import scalars as SC
from tessera.operators import profiles as P
from tessera.operators import relational as R
from tessera.operators import checks
from tessera.session import work_path
from tessera.sources import generate, loads, results, tables, vector_text, xvecs
from tessera.streaming.stream_load import Ledger, stream_load


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_tsv_round_trip_and_bad_lines(spark):
    path = work_path(spark, "tsv")
    df = frame(spark, matrix(50, 4)).withColumn("user_id", (F.col("id") % 2).cast("int"))
    vector_text.write_vector_tsv(df.select("user_id", "id", "embedding"), path, rows_per_file=10)
    shards = [f for f in os.listdir(path) if f.endswith(".csv.gz")]
    assert len(shards) >= 5
    with open(f"{path}/bad.csv", "w") as f:
        f.write("1\t2\n\n1\t3\t[1,x]\nz\t3\t[1,2]\n7\t8\t1,2,3,4\n")
    back = vector_text.read_vector_tsv(spark, path)
    assert back.count() == 51 and back.where("user_id = 7").head()["embedding"] == [1.0, 2.0, 3.0, 4.0]


def test_xvecs_round_trip_order_and_checks(spark):
    x = as_float32(matrix(90, 5))
    path = work_path(spark, "x")
    xvecs.write_xvecs(frame(spark, x), path, "fvecs", "id")
    for step in (1, 100, 1 << 20):
        rows = sorted(xvecs.read_xvecs(spark, path, "fvecs", step).collect(), key=lambda r: r["row"])
        assert [r["row"] for r in rows] == list(range(90))
        assert all(r["vec"] == [float(v) for v in x[r["row"]]] for r in rows)
    file = work_path(spark, "bad") + ".fvecs"
    with open(file, "wb") as f:
        f.write(b"\x02\0\0\0" + b"\0" * 8 + b"\x03\0\0\0" + b"\0" * 8)
    with pytest.raises(Exception, match="another dimension"):
        xvecs.read_xvecs(spark, file, "fvecs").collect()
    with open(file, "ab") as f:
        f.write(b"\0")
    with pytest.raises(Exception, match="does not fit"):
        xvecs.read_xvecs(spark, file, "fvecs").collect()


def test_labels_load_once(spark):
    path, df = work_path(spark, "lab"), spark.range(10)
    assert loads.load_labelled(df, path, "a") and not loads.load_labelled(df, path, "a")
    assert loads.load_labelled(df, path, "b")
    assert spark.read.parquet(path).count() == 20


def test_stream_load_adds_only_new_files(spark):
    src, out, check = (work_path(spark, n) for n in "ioc")
    schema = T.StructType.fromDDL("id long")
    spark.range(10).repartition(3).write.parquet(src)
    run = lambda: stream_load(spark, src, schema, out, check, "l", files_per_batch=2).count()
    assert run() == 10 and run() == 10
    spark.range(5).write.mode("append").parquet(src)
    assert run() == 15


def test_resume_rewrites_only_incomplete_chunks(spark):
    path, src = work_path(spark, "chunks"), spark.range(100)
    assert loads.write_missing_chunks(src.where("id < 45"), path, 10) == 5
    assert loads.write_missing_chunks(src, path, 10) == 6  # chunk 4 is partial, 5 to 9 are missing
    assert loads.write_missing_chunks(src, path, 10) == 0
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(100))


def test_bucketed_table_needs_no_shuffle(spark):
    df = frame(spark, matrix(300, 2)).withColumn("user_id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7))
    path = work_path(spark, "b")
    t = tables.save_bucketed(df, "t" + path[-12:], 4, ["user_id"], ["user_id", "id"], path)
    assert t.count() == 300
    plan = t.groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # with the bucketed scan forced the plan shows the pruning (it also happens without)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in explained(t.where("user_id = 1"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c"), (1, 2, "d")], "k int, seq int, v string")
    assert {(r["k"], r["v"]) for r in tables.latest_per_key(df, "k", ["seq"]).collect()} == {(1, "b"), (2, "c")}


def _source(spark, path, lo, hi):
    spark.range(lo, hi).selectExpr("id", "id * 2 as v").repartition(3).write.mode("append").parquet(path)


def test_lost_checkpoint_loads_nothing_twice(spark):
    src, out = work_path(spark, "in"), work_path(spark, "table")
    schema = T.StructType.fromDDL("id bigint, v bigint")
    run = lambda label="l": stream_load(spark, src, schema, out, work_path(spark, "check"), label, files_per_batch=2)
    _source(spark, src, 0, 30)
    assert run().count() == 30
    assert sorted(r.id for r in run().collect()) == list(range(30))  # a new checkpoint, the same label
    _source(spark, src, 30, 40)
    again = run()
    assert sorted(r.id for r in again.collect()) == list(range(40))
    assert again.columns == ["id", "v", "label"]
    assert run("other").count() == 80  # another label loads them for itself


def test_folder_without_an_entry_is_no_data(spark):
    src, out, check = (work_path(spark, n) for n in ("in", "table", "check"))
    schema = T.StructType.fromDDL("id bigint, v bigint")
    _source(spark, src, 0, 12)
    broken = Ledger.commit
    try:
        Ledger.commit = lambda self, *a: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(Exception):
            stream_load(spark, src, schema, out, check, "l")
    finally:
        Ledger.commit = broken
    ledger = Ledger(spark, out)
    assert ledger.size() == 0 and ledger.table_rows(schema).count() == 0
    assert stream_load(spark, src, schema, out, check, "l").count() == 12
    assert ledger.entries().count() == ledger.size() > 0


def test_one_of_two_loaders_commits(spark):
    ledger = Ledger(spark, work_path(spark, "table"))
    assert ledger.commit("a", "f0", ["x"], 0)
    assert not ledger.commit("a", "f1", ["x"], 0)
    assert ledger.commit("b", "f2", ["y", "z"], 1)
    assert ledger.size() == 2
    assert {(r.label, r.folder, tuple(r.files)) for r in ledger.entries().collect()} == {("a", "f0", ("x",)), ("b", "f2", ("y", "z"))}
    assert [r.file for r in ledger.loaded("b").orderBy("file").collect()] == ["y", "z"]


def test_even_ranges_of_uneven_positions(spark):
    rows = [(i % 5, i) for i in range(1000)] + [(1, 10**9), (None, 4), (2, None)]
    df = spark.createDataFrame(rows, "v int, pos long").repartition(4)
    bounds = checks.even_bounds(df, "pos", 10, 3)
    assert len(bounds) >= 9 and max(np.diff([0, *bounds, 1000])) < 130  # a far-out position leaves ranges even
    assert checks.even_bounds(df, "pos", 10, 400) == pytest.approx([bounds[0], *[b for b in bounds if b >= bounds[0] + 400][:1], *[b for b in bounds if b >= bounds[0] + 800][:1]], abs=120)
    got = {tuple(r) for r in checks.duplicates_within(df, "v", "pos", 5, 100).collect()}
    assert got == {(i % 5, i, i + 5) for i in range(995)}
    same = spark.createDataFrame([(1, 7)] * 50, "v int, pos long")
    assert checks.duplicates_within(same, "v", "pos", 2, 10).count() == 49
    assert checks.duplicates_within(same.where("pos > 9"), "v", "pos", 2, 10).count() == 0


def test_summary_of_scenarios(spark):
    path = work_path(spark, "summary")
    a = spark.createDataFrame([(1, 2.5), (2, None)], "k int, ms double")
    b = spark.createDataFrame([("x", 7)], "name string, k int")
    results.write_summary({"scale": a, "distfn": b, "cache_raw": a}, path)
    results.write_summary({"distfn": b.union(b)}, path)
    rows = sorted((r.scenario, r.k, r.ms, r.name) for r in results.read_summary(spark, path).collect())
    assert rows == [("distfn", 7, None, "x"), ("distfn", 7, None, "x"), ("scale", 1, 2.5, None), ("scale", 2, None, None)]
    lines = [r.value for r in spark.read.text(f"{path}/scenario=scale").collect()]
    assert sorted(lines) == ['{"k":1,"ms":2.5}', '{"k":2}']


def test_result_repair_keeps_two_scenarios(spark):
    df = spark.createDataFrame([("distfn", "x"), ("scale", "y"), ("concscale", None)], "scenario string, dist_fn string")
    rows = {r["scenario"]: r for r in results.repair_results(df, "l2", "flat").collect()}
    assert rows["distfn"]["dist_fn"] == "x" and rows["distfn"]["search_mode"] is None
    assert rows["scale"]["dist_fn"] == "l2" and rows["scale"]["limit"] is None
    assert rows["concscale"]["limit"] == results.DEFAULT_LIMIT


def test_generators_do_not_depend_on_partitions(spark):
    src = frame(spark, matrix(30, 3))
    a = {tuple(r[:2]): r["embedding"] for r in generate.resample(src, 4, 25).collect()}
    b = {tuple(r[:2]): r["embedding"] for r in generate.resample(src.repartition(9), 4, 25).collect()}
    assert a == b and len(a) == 100
    assert len({tuple(v) for v in a.values()}) > 15
    zero = spark.range(500).withColumn("embedding", F.array_repeat(F.lit(0.0), 8))
    u = generate.uniform_vectors(zero).collect()
    flat = [x for r in u for x in r["embedding"]]
    assert min(flat) >= 1 and max(flat) < 100 and 45 < sum(flat) / len(flat) < 56
    assert {r["category"] for r in u} == set(range(1, 10))
    n = generate.normal_unit(src).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in n)
    schema = T.StructType.fromDDL("a int, b decimal(6,2), c date, d timestamp, e string, f double, g boolean, h tinyint")
    rows = generate.typed_rows(spark.range(100), "id", schema, ranges={"a": (5, 9)}).collect()
    assert max(r["b"] for r in rows) > 9000
    assert {r["a"] for r in rows} == {5, 6, 7, 8, 9} and all(r["b"] < 10000 for r in rows)
    assert all(r[c] is not None for r in rows for c in "abcdefgh")


@pytest.mark.parametrize("text,ms", [("1sec456ms", 1456.0), ("2hour3min", 7380000.0), ("1.5us", 0.0015), ("7ns", 7e-6),
                                     ("3min", 180000.0), ("5", None), ("", None), ("1ms2sec", None), ("x1ms", None)])
def test_durations(spark, text, ms):
    got = spark.createDataFrame([(text,)], "s string").select(SC.duration_to_ms("s").alias("v")).head()["v"]
    assert got == pytest.approx(ms) if ms is not None else got is None


@pytest.mark.parametrize("text,mb", [("3.93 MB", 3.93), ("512KB", 0.5), ("1 GB", 1024.0), ("1048576 B", 1.0),
                                     ("2 tb", 2097152.0), ("3 XB", None), ("MB", None), ("", None)])
def test_sizes(spark, text, mb):
    got = spark.createDataFrame([(text,)], "s string").select(SC.size_to_mb("s").alias("v")).head()["v"]
    assert got == pytest.approx(mb) if mb is not None else got is None


def test_not_in_and_cross(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    lists = {(1,): [2], (): [1, 2, None], (1, None): []}
    for lst, want in lists.items():
        right = spark.createDataFrame([(v,) for v in lst], "b int")
        assert [r["a"] for r in R.not_in(left, "a", right, "b").collect()] == want
    assert R.cross_dimensions(left, spark.range(50)).count() == 150


@pytest.mark.parametrize("values,dup", [([1, 2, 3, 1], True), ([], False), ([1], False), ([1, 2, 3, 4], False),
                                        ([5, 5], True), ([None, None], False)])
def test_duplicates(spark, values, dup):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, pos int")
    assert checks.has_duplicates(df, "v").head()["dup"] == dup


def test_duplicates_within_over_ranges(spark):
    values = [(i * 7) % 11 if i % 3 else 1 for i in range(200)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, pos int")
    last, want = {}, set()
    for i, v in enumerate(values):
        if v in last and i - last[v] <= 4:
            want.add((v, last[v], i))
        last[v] = i
    for size in (1, 10, 1000):
        assert {tuple(r) for r in checks.duplicates_within(df, "v", "pos", 4, size).collect()} == want


PROFILE = """Summary:
   - Profile ID: q1
   - Total: 1sec500ms
   - Sql Statement: select 1
MergedProfile
  inside
Execution Profile q1:
   OLAP_SCAN_OPERATOR (id=1. table name = a(a)):
      - BlockSize: 2.00 MB
      VScanner:
        - RowsRead: 1.2K (1200)
        - ColumnCount: 3
        - ScannerSerializationBlockTime: 2.5ms
   OLAP_SCAN_OPERATOR (id=2. table name = a(a)):
      VScanner:
        - RowsRead: 99
   OLAP_SCAN_OPERATOR (id=3. table name = b(b)):
      - BlockSize: many
        - RowsRead: 500
"""


def test_profile_scans(spark):
    texts = spark.createDataFrame([("f", PROFILE), ("g", "no profile")], "file string, text string")
    rows = P.scan_rows(texts).collect()
    assert len(rows) == 1  # one scan is too small, one has no readable size
    r = rows[0]
    assert (r["query_id"], r["total_ms"], r["rows_read"], r["block_mb"], r["ser_ms"], r["deser_ms"]) == (
        "q1", 1500.0, 1200, 2.0, 2.5, 0.0)
    assert [r["line"] for r in P.section(texts, "MergedProfile", "Execution Profile").collect()] == ["  inside"]


def test_markers_need_both_ends(spark):
    rows = [("a", 1, 2, "d", "begin-x"), ("b", 3, 4, "d", "s"), ("c", 5, 9, "d", "s"), ("e", 6, 7, "d", "end-x")]
    log = spark.createDataFrame(rows, "query_id string, begin_at int, end_at int, db string, sql string")
    hit = P.log_between_markers(log, "begin-x", "end-x", "d")
    assert {r["query_id"] for r in hit.collect()} == {"a", "b"}
    assert P.log_between_markers(log.where("query_id <> 'e'"), "begin-x", "end-x", "d").count() == 0


def test_plans_of_the_main_searches(spark):
    """Top-k without a full sort, filters and columns at the scan."""
    from tests.conftest import SF

    from tessera.operators import search as S
    from tessera.sources.views import Tables

    t = Tables(spark, SF)
    v = t.user_vectors
    plan = S.knn(v, [0.0] * 64, 5, where=F.col("category") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan
    pruned = t.lineitem_x.groupBy("l_returnflag").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in pruned


def test_appended_vector_files_add_up(spark, tmp_path):
    path = str(tmp_path / "v")
    for k in range(2):
        xvecs.write_xvecs(frame(spark, matrix(8, 3, k)), path, "fvecs", "id")
    back = xvecs.read_xvecs(spark, path, "fvecs").collect()
    assert sorted(r["row"] for r in back) == list(range(16))
    first = {r["row"]: r["vec"] for r in back}
    assert np.allclose([first[i] for i in range(16)], np.vstack([matrix(8, 3, 0), matrix(8, 3, 1)]), atol=1e-6)


def _chain(spark, parents):
    rows = [("f", i, P.STREAM_SINK, None, [p]) for i, p in parents.items() if p is not None]
    rows += [("f", i, "EXCHANGE_OPERATOR", i, None) for i in parents]
    return spark.createDataFrame(rows, "file string, fragment int, name string, id int, dest_ids array<int>")


def test_plan_edges_at_any_depth(spark):
    deep = P.plan_edges(_chain(spark, {0: None, **{i: i - 1 for i in range(1, 400)}}))
    assert {r["fragment"]: r["depth"] for r in deep.collect()} == {i: i for i in range(400)}
    with pytest.raises(ValueError):
        P.plan_edges(_chain(spark, {0: None, 1: 2, 2: 3, 3: 1}))


class _Cluster:
    """A session whose master is a cluster and whose shared folder is given by a plain path."""

    def __init__(self, spark, shared):
        self._jvm, self.conf = spark._jvm, self
        self.sparkContext, self.shared = self, shared
        self._jsc, self.master = spark.sparkContext._jsc, "spark://host:7077"

    def get(self, key, default=None):
        return self.shared if key == "spark.checkpoint.dir" else default


def test_vector_files_in_a_shared_folder_without_scheme(spark, tmp_path):
    cluster = _Cluster(spark, f"{tmp_path}/shared")
    assert xvecs.qualified(cluster, f"{tmp_path}/shared/queries") == f"file://{tmp_path}/shared/queries"
    for path in (f"{tmp_path}/own", f"{tmp_path}/shared-not", f"{tmp_path}/shared/../own"):
        with pytest.raises(ValueError, match="local to each machine"):
            xvecs.qualified(cluster, path)


def test_vector_files_below_a_mount_of_spark(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.vectors.link./in", f"file://{tmp_path}")
    x = as_float32(matrix(7, 3))
    xvecs.write_xvecs(frame(spark, x), "viewfs://vectors/in/some/x", "fvecs", "id")
    back = xvecs.read_xvecs(spark, "viewfs://vectors/in/some/x", "fvecs").collect()
    assert {r["row"]: r["vec"] for r in back} == dict(enumerate(x.tolist()))


@pytest.mark.parametrize("rows", [50_000, 3])
def test_pairs_of_hot_keys_are_dealt_out(spark, monkeypatch, rows):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    left = spark.createDataFrame([(i % 2 if i % 5 else None, i) for i in range(20)], "k long, a long")
    right = spark.createDataFrame([(i % 3 if i % 7 else None, i % 150) for i in range(300)], "j long, b long").coalesce(1)
    got = R.hash_join(left, right, "k", "j").select("k", "a", "b", F.spark_partition_id().alias("task")).collect()
    want = [(x.k, x.a, y.b) for x in left.collect() for y in right.collect() if x.k is not None and x.k == y.j]
    assert sorted((r.k, r.a, r.b) for r in got) == sorted(want)
    share = Counter(r.task for r in got)
    assert len(share) > 4 and max(share.values()) < len(want) / 2


@pytest.mark.parametrize("block", [1, 4, 256])
def test_join_by_blocks_keeps_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    left = spark.createDataFrame([(i % 3 if i % 5 else None, i % 11 if i % 4 else None, "x.y") for i in range(60)], "k int, a long, `dotted.name` string")
    right = spark.createDataFrame([(i % 4 if i % 7 else None, i % 40 if i % 3 else None) for i in range(200)], "j long, b long")
    got = R.hash_join(left, right, "k", "j")
    assert got.columns == ["k", "a", "dotted.name", "j", "b"]
    want = [(*x, *y) for x in left.collect() for y in right.collect() if x.k is not None and x.k == y.j]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_pairs_of_a_hot_key_take_few_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        left = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("a"))
        right = spark.range(30_000).select(F.lit(1).alias("j"), F.col("id").alias("b"))
        pairs = R.hash_join(left, right, "k", "j").select("k", "a", "b")
        pairs.write.option("compression", "snappy").parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 1_800_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1_800_000 / 2
