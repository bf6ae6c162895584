import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_float32, asked, brute, frame, matrix, ranked

from tessera import scale
from tessera.operators import approx as A
from tessera.operators import ivf
from tessera.operators import quantize as C
from tessera.operators import search as S
from tessera.session import work_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    mids = rng.normal(scale=4, size=(8, 12))
    x = as_float32(mids[np.arange(600) % 8] + rng.normal(size=(600, 12)))
    return x, frame(spark, x).cache()


@pytest.fixture(scope="module")
def built(spark, data):
    x, df = data
    centers = ivf.train(df, 8, rounds=4)
    cf = ivf.centers_frame(spark, centers)
    return centers, cf, ivf.assign(df, centers).cache()


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# ---------------------------------------------------------------- range


def exact_range(x, q, r):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = np.lexsort((np.arange(len(x)), d))
    return [int(i) for i in order if d[i] < r]


@pytest.mark.parametrize("radius", [0.5, 3.0, 9.0, 1e6])
def test_range_is_exact(spark, data, built, radius):
    x, df = data
    qs = np.vstack([x[:3] + 0.1, matrix(3, 12, 4) * 6])
    index, lists = A.write_range_index(built[2], built[1], work_path(spark, "r"))
    got = ranked(A.range_search(index, lists, asked(spark, qs), radius))
    for i, q in enumerate(qs):
        assert got.get(i, []) == exact_range(x, q, radius)
    top = ranked(A.range_search(index, lists, asked(spark, qs), radius, k=4))
    assert all(top.get(i, []) == exact_range(x, q, radius)[:4] for i, q in enumerate(qs))


def test_range_reads_only_lists_in_reach(spark, data, built):
    x, df = data
    index, lists = A.write_range_index(built[2], built[1], work_path(spark, "r"))
    q = asked(spark, x[:1] + 0.05)
    reach = A.lists_in_reach(lists, q, 2.0)
    assert 0 < reach.count() < 8
    plan = plan_of(A.range_search(index, lists, q, 2.0))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    assert "EqualTo(list_id" in pushed and "GreaterThan(center_dist" in pushed and "LessThan(center_dist" in pushed
    stats = {r["list_id"]: r for r in lists.collect()}
    d = np.sqrt(((x - built[0][[r["list_id"] for r in sorted(built[2].collect(), key=lambda r: r["id"])]]) ** 2).sum(1))
    assert abs(max(r["farthest"] for r in stats.values()) - d.max()) < 1e-9 and sum(r["n"] for r in stats.values()) == 600


def test_range_of_many_queries_in_blocks(spark, data, built, monkeypatch):
    x, df = data
    qs = x[::40] + 0.05
    index, lists = A.write_range_index(built[2], built[1], work_path(spark, "r"))
    want = {i: exact_range(x, q, 4.0) for i, q in enumerate(qs)}
    assert ranked(A.range_search(index, lists, asked(spark, qs), 4.0)) == want
    monkeypatch.setattr(A, "SHELL_LISTS", 2)
    assert ranked(A.range_search(index, lists, asked(spark, qs), 4.0)) == want
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 60)
    assert ranked(A.range_search(index, lists, asked(spark, qs), 4.0)) == want


@pytest.mark.parametrize("values", [8_000_000, 100])
def test_pairs_within_a_limit(spark, data, values, monkeypatch):
    x, df = data
    qs = x[:9] + 0.1
    monkeypatch.setattr(scale, "BROADCAST_VALUES", values)
    limit = F.when(F.col("id") % 2 == 0, 5.0).otherwise(2.0)
    got = S.within(df.withColumn("tag", F.col("id") * 10), asked(spark, qs), limit, keep=["tag"], block_values=400).collect()
    want = {
        (j, i) for j, q in enumerate(qs) for i in range(len(x)) if np.sqrt(((x[i] - q) ** 2).sum()) < (5.0 if i % 2 == 0 else 2.0)
    }
    assert {(r.qid, r.id) for r in got} == want and len(got) == len(want) and all(r.tag == 10 * r.id for r in got)
    up = S.within(df, asked(spark, qs), 40.0, "inner_product", block_values=400).collect()
    assert {(r.qid, r.id) for r in up} == {(j, i) for j, q in enumerate(qs) for i in range(len(x)) if x[i] @ q > 40}


def test_range_without_queries_or_vectors(spark, built):
    index, lists = A.write_range_index(built[2].where("id < 0"), built[1], work_path(spark, "r"))
    q = asked(spark, matrix(2, 12))
    assert A.range_search(index, lists, q, 1.0).count() == 0
    index, lists = A.write_range_index(built[2], built[1], work_path(spark, "r"))
    assert A.range_search(index, lists, q.where("qid < 0"), 1.0).count() == 0


# ---------------------------------------------------------------- product codes


def code_brute(x, lists, centers, codec, q, probed, k, metric):
    moved = x - centers[lists]
    near = codec.vectors(codec.codes(moved).astype(int)) + centers[lists]
    rows = np.flatnonzero(np.isin(lists, probed))
    if metric == "inner_product":
        d = -(near[rows] @ q)
    else:
        d = ((near[rows] - q) ** 2).sum(1)
    order = np.lexsort((rows, d.round(9)))[:k]
    return rows[order].tolist()


@pytest.mark.parametrize("metric", ["l2", "l2_sq", "inner_product"])
def test_residual_codes_by_tables(spark, data, built, metric, monkeypatch):
    x, df = data
    centers, cf, lists = built
    codec = C.pq_train(A.residuals(lists, cf), 4, 4, rounds=3)
    coded = A.encode_residuals(lists, cf, codec).cache()
    assert coded.columns == ["list_id", "id", "codes"]
    of = np.array([r["list_id"] for r in sorted(lists.collect(), key=lambda r: r["id"])])
    qs = x[::75] + 0.1
    probes = ivf.probe(cf, asked(spark, qs), 3)
    by = {}
    for r in probes.collect():
        by.setdefault(r["qid"], []).append(r["list_id"])
    found = A.search_codes(coded, probes, asked(spark, qs), codec, 12, cf, metric)
    want = {i: code_brute(x, of, centers, codec, q, by[i], 12, metric) for i, q in enumerate(qs)}
    got = ranked(found)
    assert {i: set(v) for i, v in got.items()} == {i: set(v) for i, v in want.items()}
    first = found.where("qid = 0").orderBy("rank").collect()
    near = codec.vectors(codec.codes(x - centers[of]).astype(int)) + centers[of]
    for r in first:
        d = ((near[r.id] - qs[0]) ** 2).sum()
        assert np.isclose(r.dist, {"l2": np.sqrt(d), "l2_sq": d, "inner_product": near[r.id] @ qs[0]}[metric])
    monkeypatch.setattr(A, "QUERY_BLOCK", 2)
    monkeypatch.setattr(A, "CODE_BLOCK", 5)
    assert {i: set(v) for i, v in ranked(A.search_codes(coded, probes, asked(spark, qs), codec, 12, cf, metric)).items()} == {i: set(v) for i, v in want.items()}
    bounded = scale.bounded_vectors
    monkeypatch.setattr(scale, "bounded_vectors", lambda df, i, v, m=None: None if v == "qvec" else bounded(df, i, v, m))
    many = A.search_codes(coded, probes, asked(spark, qs), codec, 12, cf, metric)
    assert {i: set(v) for i, v in ranked(many).items()} == {i: set(v) for i, v in want.items()}


def test_plain_codes_by_tables_equal_decoded(spark, data, built):
    x, df = data
    centers, cf, lists = built
    codec = C.pq_train(df, 4, 4, rounds=3)
    coded = lists.select("list_id", "id", codec.encode("embedding").alias("codes"))
    q = asked(spark, x[:5] + 0.1)
    probes = ivf.probe(cf, q, 3)
    old = {(r.qid, r.id): r.dist for r in ivf.search(coded, probes, q, 600, data="codes", decode=ivf.decoder(codec)).collect()}
    new = {(r.qid, r.id): r.dist for r in A.search_codes(coded, probes, q, codec, 600).collect()}
    assert old.keys() == new.keys() and all(np.isclose(old[i], new[i]) for i in old)
    with pytest.raises(ValueError):
        A.search_codes(coded, probes, q, codec, 3, metric="cosine_distance")


def test_residual_codes_find_more(spark, data, built):
    x, df = data
    centers, cf, lists = built
    q = asked(spark, x[::20] + 0.2)
    want = {i: set(brute(x, v, 10)) for i, v in enumerate(x[::20] + 0.2)}
    probes = ivf.probe(cf, q, 8)
    plain = C.pq_train(df, 4, 3, rounds=4)
    of_rest = C.pq_train(A.residuals(lists, cf), 4, 3, rounds=4)
    a = ranked(A.search_codes(lists.select("list_id", "id", plain.encode("embedding").alias("codes")), probes, q, plain, 10))
    b = ranked(A.search_codes(A.encode_residuals(lists, cf, of_rest), probes, q, of_rest, 10, cf))
    hits = lambda found: sum(len(set(found[i]) & want[i]) for i in want)
    assert hits(b) > hits(a)


def test_centers_joined_beyond_the_bound(spark, data, built, monkeypatch):
    x, df = data
    centers, cf, lists = built
    one = {r.id: r.embedding for r in A.residuals(lists, cf).collect()}
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 20)
    two = {r.id: r.embedding for r in A.residuals(lists, cf).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[i], two[i]) for i in one)


# ---------------------------------------------------------------- inner product


@pytest.fixture(scope="module")
def sized(spark):
    rng = np.random.default_rng(8)
    mids = rng.normal(size=(10, 16))
    x = mids[np.arange(1500) % 10] + 0.6 * rng.normal(size=(1500, 16))
    x *= rng.uniform(0.2, 3.0, size=(1500, 1))
    return as_float32(x), frame(spark, as_float32(x)).cache()


def test_inner_product_lists(spark, sized):
    x, df = sized
    most = A.longest(df)
    assert np.isclose(most, np.sqrt((x * x).sum(1)).max())
    ext = np.array([r.extended for r in A.extended(df, most).orderBy("id").collect()])
    assert np.allclose((ext * ext).sum(1), 1)
    centers, m = A.train_ip(df, 16, rounds=5)
    assert m == most and np.allclose((centers * centers).sum(1), 1) and centers.shape == (16, 17)
    lists, cf = A.assign_ip(df, centers, most), ivf.centers_frame(spark, centers)
    q = matrix(40, 16, 2)
    asks = asked(spark, q)
    want = {i: np.lexsort((np.arange(len(x)), -(x @ v)))[:10].tolist() for i, v in enumerate(q)}
    recall = []
    for nprobe in (2, 6, 16):
        got = ranked(ivf.search(lists, A.probe_ip(cf, asks, nprobe), asks, 10, "inner_product"))
        recall.append(np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]))
    assert recall[2] == 1 and recall[1] >= 0.9 and recall == sorted(recall)
    plain = ivf.train(df, 16, rounds=5)
    flat = ranked(ivf.search(ivf.assign(df, plain), ivf.probe(ivf.centers_frame(spark, plain), asks, 6, "inner_product"), asks, 10, "inner_product"))
    assert recall[1] >= np.mean([len(set(flat.get(i, [])) & set(want[i])) / 10 for i in want])


def test_inner_product_of_zero_vectors(spark):
    df = frame(spark, np.zeros((5, 3)))
    most = A.longest(df)
    assert most == 0
    assert [r.extended for r in A.extended(df, most).collect()] == [[0, 0, 0, 1]] * 5
    assert A.longest(df.where("id < 0")) == 0


def test_spherical_training_in_two_levels(spark, sized, monkeypatch):
    x, df = sized
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 200)
    rows = A.extended(df, A.longest(df)).select("id", F.col("extended").alias("embedding"))
    c = C.lloyd(rows, 20, rounds=2, unit=True)[0]
    assert c.shape == (20, 17) and np.allclose((c * c).sum(1), 1)


# ---------------------------------------------------------------- two-level training


@pytest.mark.parametrize("sizes,k", [({0: 5, **{i: 1 for i in range(1, 8)}}, 4), ({0: 100, 1: 1, 2: 1}, 50), ({0: 3, 1: 3}, 10), ({0: 7, 1: 7, 2: 7}, 10), ({0: 1000, 1: 500, 2: 3, 3: 1}, 37)])
def test_shares_are_exact(sizes, k):
    share = C._shares(sizes, k)
    assert sum(share.values()) == min(k, sum(sizes.values()))
    assert all(1 <= n <= sizes[c] for c, n in share.items())
    if k >= len(sizes):
        assert share.keys() == sizes.keys()


def test_no_center_is_lost_in_two_levels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(120, 4)), 50 + rng.normal(size=(3, 4)), [[200, 0, 0, 200]]])
    df = frame(spark, as_float32(x))
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 30)
    for parts in (1, 2):
        assert C.lloyd(df, 16, parts, rounds=2).shape == (parts, 16, 4 // parts)
    assert len(ivf.train(df, 13, rounds=2)) == 13


# ---------------------------------------------------------------- allowed ids, joins


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_allowed_equals_filter_then_search(spark, data, built, kind):
    x, df = data
    centers, cf, lists = built
    big = lambda c: c if kind == "string" else (F.col(c) * 7919 - 100_000 if isinstance(c, str) else c)
    index = lists.withColumn("id", big("id") if kind != "string" else F.col("id").cast("string")).withColumn("id", F.col("id").cast(kind))
    keep = index.where("cast(list_id as long) % 2 = 0 or id % 3 = 0" if kind != "string" else "list_id % 2 = 0").select("id")
    ids = keep.union(keep).union(spark.createDataFrame([(None,)], f"id {kind}"))
    q = asked(spark, matrix(6, 12, 9) * 4)
    probes = ivf.probe(cf, q, 4)
    got = ranked(ivf.search(A.only_allowed(index, ids), probes, q, 7))
    want = ranked(ivf.search(index.join(keep.distinct(), "id", "left_semi"), probes, q, 7))
    assert got == want


def test_filter_comes_before_the_vectors_are_read_by_tasks(spark, data, built):
    _, _, lists = built
    index = ivf.write_index(lists, work_path(spark, "a"))
    q = asked(spark, matrix(2, 12, 9))
    plan = plan_of(ivf.search(A.only_allowed(index, index.where("id % 5 = 0").select("id")), ivf.probe(built[1], q, 2), q, 3))
    assert plan.index("MapInArrow") < plan.index("BroadcastHashJoin")  # a parent is printed first
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(list_id", plan)


def test_join_form(spark, data, built):
    x, df = data
    _, cf, lists = built
    index = lists.withColumn("group", F.when(F.col("id") % 11 != 0, F.col("id") % 7))
    other = spark.createDataFrame(
        [(0, "a"), (0, "b"), (2, "c"), (3, "d"), (3, "d"), (None, "n"), (9, "z")], "group long, name string")
    q = asked(spark, matrix(5, 12, 3) * 4)
    got = A.knn_join(index, cf, q, other, "group", 9, 8).collect()
    names = {0: ["a", "b"], 2: ["c"], 3: ["d", "d"]}
    for i, v in enumerate(matrix(5, 12, 3) * 4):
        d = np.sqrt(((x - v) ** 2).sum(1))
        rows = sorted((d[j], j, n) for j in range(600) if j % 11 and j % 7 in names for n in names[j % 7])[:9]
        mine = sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])
        assert [(r.id, r.name) for r in mine] == [(j, n) for _, j, n in rows]


def test_long_lists_are_pushed_in_any_session(spark):
    old = spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "10")
    try:
        path = work_path(spark, "lists")
        spark.range(4000).selectExpr("cast(id % 200 as int) as list_id", "id").repartitionByRange(40, "list_id").sortWithinPartitions("list_id").write.parquet(path)
        rows = spark.read.parquet(path)
        wanted = list(range(0, 200, 9))
        found = rows.where(ivf.in_lists(wanted))
        assert found.count() == 20 * len(wanted)
        pushed = re.search(r"PushedFilters: \[(.*)\]", plan_of(found))[1]
        assert pushed.count("In(list_id") == 3
        assert rows.where(ivf.in_lists([])).count() == 0
    finally:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", old)


def test_tenant_layout_reads_one_bucket(spark, data):
    from tessera.sources import tables

    x, df = data
    # tenant 7 holds two thirds of the rows
    rows = df.withColumn("user_id", F.when(F.col("id") % 3 > 0, 7).otherwise((F.col("id") % 20).cast("int")).cast("int"))
    path = work_path(spark, "tenants")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # as many writers as a large table has
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = tables.save_bucketed(rows, "t_" + path.rsplit("-", 1)[1], 8, ["user_id"], ["user_id", "id"], path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tenant in (7, 4, 19, 99):
        found = S.knn(table, x[0].tolist(), 5, where=F.col("user_id") == tenant)
        mine = [r["id"] for r in rows.where(F.col("user_id") == tenant).collect()]
        d = np.sqrt(((x[mine] - x[0]) ** 2).sum(1)) if mine else np.empty(0)
        assert [r["id"] for r in found.collect()] == [mine[i] for i in np.lexsort((mine, d))[:5]]
        assert "EqualTo(user_id" in plan_of(found) and "Exchange" not in plan_of(found)
        # the planner names the bucket only where it also keeps buckets apart; files are left out either way
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        try:
            plan = plan_of(S.knn(table, x[0].tolist(), 5, where=F.col("user_id") == tenant))
            assert "SelectedBucketsCount: 1 out of 8" in plan
        finally:
            spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    files = spark.read.parquet(path).withColumn("f", F.input_file_name()).groupBy("f").agg(F.count("*").alias("n"), F.max((F.col("user_id") == 7).cast("int")).alias("hot"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        one, all_of = (t.select("id", "embedding").rdd.getNumPartitions() for t in (table.where("user_id = 4"), table))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one < all_of
    assert files.where("hot = 1").count() > 1  # the hot tenant is several files, which several tasks read


@pytest.mark.parametrize("form", ["sq8", "sq4", "fp16"])
def test_refine_over_stored_codes(spark, data, built, form):
    x, df = data
    _, cf, lists = built
    codec = C.HalfCodec(12) if form == "fp16" else C.sq_train(df, 8 if form == "sq8" else 4)
    stored = ivf.write_index(lists.select("list_id", "id", codec.encode("embedding").alias("codes")), work_path(spark, "codes"))
    q = matrix(5, 12, 9) * 4
    probes = ivf.probe(cf, asked(spark, q), 3)
    cand = ivf.search(lists, probes, asked(spark, q), 40)
    got = ranked(ivf.refine(cand, stored, asked(spark, q), 6, data="codes", decode=ivf.decoder(codec), probes=probes))
    near = codec.vectors(codec.codes(x).astype(int))
    held = ranked(cand)
    for i, v in enumerate(q):
        d = np.sqrt(((near[held[i]] - v) ** 2).sum(1))
        assert got[i] == [held[i][j] for j in np.lexsort((held[i], d))[:6]]
    if form == "fp16":
        assert np.allclose(near, x.astype(np.float16))
    plan = plan_of(ivf.refine(cand, stored, asked(spark, q), 6, data="codes", decode=ivf.decoder(codec), probes=probes))
    assert re.search(r"PushedFilters: \[[^\n]*(In|EqualTo)\(list_id", plan)
