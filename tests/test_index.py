import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_float32, asked, brute, frame, matrix, ranked

from tessera.functions.vectorstats import dim_stats, mean_vector
from tessera.operators import ivf
from tessera.operators import quantize as C
from tessera.operators import search as S
from tessera.session import work_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    mids = rng.normal(scale=4, size=(6, 16))
    x = as_float32(mids[np.arange(400) % 6] + rng.normal(size=(400, 16)))
    return x, frame(spark, x).cache()


def odd_sum(df):
    """A sum over all numbers of all vectors."""
    x = np.array(sorted(tuple(r["embedding"]) for r in df.select("embedding").collect()))
    return x.sum(0).round(4).tolist()


def test_dim_stats(spark, data):
    x, df = data
    rows = sorted(dim_stats(df).collect(), key=lambda r: r["pos"])
    assert np.allclose([r["lo"] for r in rows], x.min(0)) and np.allclose([r["hi"] for r in rows], x.max(0))
    by = mean_vector(df.withColumn("g", F.col("id") % 3), "g")
    for r in by.collect():
        assert np.allclose(r["center"], x[np.arange(400) % 3 == r["g"]].mean(0))


@pytest.mark.parametrize("bits", [4, 8])
@pytest.mark.parametrize("shared", [False, True])
def test_scalar_codes_stay_within_half_a_step(data, bits, shared):
    x, df = data
    codec = C.sq_train(df, bits, shared)
    codes = codec.codes(x)
    assert codes.min() >= 0 and codes.max() <= codec.top
    assert (np.abs(codec.vectors(codes) - x) <= codec.step / 2 + 1e-12).all()


def test_flat_dimension_and_outliers(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [2.0, 5.0])], "id long, embedding array<float>")
    codec = C.sq_train(df)
    assert codec.step[1] == C.ZERO_STEP
    assert codec.codes(np.array([[99.0, 5.0], [-99.0, 5.0]])).tolist() == [[255, 0], [0, 0]]


def test_lookup_equals_decoded_distance(data):
    x, df = data
    q = x[7].tolist()
    for codec in (C.sq_train(df, 4), C.pq_train(df, 4, 3, rounds=3)):
        coded = df.select("id", codec.encode("embedding").alias("codes"))
        got = {r["id"]: r["dist"] for r in C.adc_search(coded, codec, q, 400).collect()}
        want = ((codec.vectors(codec.codes(x).astype(int)) - x[7]) ** 2).sum(1)
        assert np.allclose([got[i] for i in range(400)], want)


def test_packed_codes_have_the_stated_size(data):
    from tessera.operators import quality as Q

    x, df = data
    sizes = {r["method"]: r["bytes"] for r in Q.code_size(df, [(4, 8), (8, 4), (4, 3)]).collect()}
    codecs = {"SQ8": C.sq_train(df, 8), "SQ4": C.sq_train(df, 4),
              "PQ8x4": C.ProductCodec(np.random.default_rng(0).normal(size=(8, 16, 2))),
              "PQ4x8": C.ProductCodec(np.random.default_rng(0).normal(size=(4, 256, 4)))}
    for name, codec in codecs.items():
        coded = df.select("id", codec.encode("embedding").alias("c")).select(
            "id", F.octet_length("c").alias("n"), codec.unpacked("c").alias("u")).collect()
        assert {r["n"] for r in coded} == {sizes[name]} == {codec.code_bytes}
        want = codec.codes(x)
        assert all(r["u"] == want[r["id"]].astype(int).tolist() for r in coded)
    wide = C.ProductCodec(np.random.default_rng(0).normal(size=(3, 300, 2)))
    codes = np.array([[0, 299, 256], [7, 8, 9]])
    assert wide.unpack(wide.pack(codes)).tolist() == codes.tolist()
    odd = C.ProductCodec(np.random.default_rng(0).normal(size=(3, 16, 2)))
    assert odd.unpack(odd.pack(codes % 16)).tolist() == (codes % 16).tolist()


def test_product_codes(data):
    x, df = data
    assert C.pq_train(df, 5, 2) is None
    mse = [C.reconstruction_error(df, C.pq_train(df, m, 4, rounds=4)).head()["mse"] for m in (1, 4, 16)]
    assert mse[0] > mse[1] > mse[2]
    part = C.pq_train(df, 4, 4, rounds=3, fraction=0.5)
    assert part.centers.shape == (4, 16, 4) and np.isfinite(part.centers).all()
    uniform = C.reconstruction_error(df, C.sq_train(df, 4)).head()["mse"]
    adaptive = C.reconstruction_error(df, C.sq_kmeans_train(df, 16, rounds=6)).head()["mse"]
    assert adaptive < uniform * 1.1


def test_kmeans_lowers_error_and_fills_empty_clusters(spark, data):
    x, df = data
    err = lambda c: ((x[:, None, :] - c[None]) ** 2).sum(2).min(1).mean()
    e = [err(C.lloyd(df, 6, rounds=r)[0]) for r in (0, 1, 4)]
    assert e[0] >= e[1] >= e[2]
    far = np.full((1, 3, 16), 1e6)
    far[0, 0] = x.mean(0)
    assert np.abs(C.lloyd(df, 3, rounds=2, start=far)[0]).max() < 1e3


def test_half_precision(data):
    x, df = data
    back = df.select("id", C.half_vectors(C.half_codes("embedding")).alias("v")).collect()
    assert all(np.allclose(r["v"], x[r["id"]].astype(np.float16)) for r in back)


def test_bit_estimate_is_close_and_ranks(data):
    x, df = data
    codec = C.bit_train(df)
    coded = C.bit_encode(df, codec)
    exact = ((x - x[5]) ** 2).sum(1)
    for kind in ({}, {"query_bits": 8}):
        got = {r["id"]: r["dist"] for r in C.bit_search(coded, codec, x[5].tolist(), 400, **kind).collect()}
        est = np.array([got[i] for i in range(400)])
        assert abs((est - exact).mean()) < 0.15 * exact.mean()
        assert np.corrcoef(est, exact)[0, 1] > 0.9
    simple = C.bit_search(coded, codec, x[5].tolist(), 400, sign_query=True).collect()
    assert len(simple) == 400


def test_all_lists_probed_is_exact(spark, data):
    x, df = data
    q = matrix(8, 16, 9)
    centers = ivf.train(df, 7, rounds=3)
    cf, lists = ivf.centers_frame(spark, centers), ivf.assign(df, centers)
    want = {i: brute(x, q[i], 5) for i in range(8)}
    assert ranked(ivf.knn_approx(lists, cf, asked(spark, q), 5, 7)) == want
    recall = []
    for n in (1, 3, 7):
        got = ranked(ivf.knn_approx(lists, cf, asked(spark, q), 5, n))
        recall.append(sum(len(set(got[i]) & set(want[i])) for i in range(8)))
    assert recall == sorted(recall) and recall[-1] == 40


def test_blocks_equal_broadcast(spark, data):
    """The way for large query sets gives what the broadcast way gives, hot list included."""
    x, df = data
    q = asked(spark, matrix(8, 16, 9))
    hot = df.withColumn("list_id", F.when(F.col("id") % 3 > 0, 0).otherwise((F.col("id") % 5).cast("int")).cast("int"))
    probes = q.select("qid", F.explode(F.lit([0, 3])).alias("list_id"))
    one = ranked(ivf.search(hot, probes, q, 6))
    found = ivf._search_blocks(hot, probes, q, 6, "l2", "id", "embedding", ivf._plain, block=3)
    from tessera import scale

    assert ranked(scale.rank_per_group(found, ["qid"], [F.asc("dist"), F.col("id")], 6)) == one


def test_refine_with_many_candidates_is_exact(spark, data):
    x, df = data
    q = matrix(4, 16, 11)
    cand = S.knn_batch(df, asked(spark, q), 400, "inner_product").select("qid", "id")
    want = {i: brute(x, q[i], 5) for i in range(4)}
    assert ranked(ivf.refine(cand, df, asked(spark, q), 5, "flat")) == want
    assert ranked(ivf.refine(cand, df, asked(spark, q), 5, "unknown")) == want
    for form in ("sq8", "fp16", "sq4"):
        got = ranked(ivf.refine(cand, df, asked(spark, q), 5, form))
        assert sum(len(set(got[i]) & set(want[i])) for i in range(4)) >= 16


def test_bit_lists(spark, data):
    x, df = data
    q = matrix(4, 16, 11)
    centers = ivf.train(df, 5, rounds=3)
    lists, cf = ivf.assign(df, centers), ivf.centers_frame(spark, centers)
    probes = ivf.probe(cf, asked(spark, q), 5)
    for centered in (True, False):
        got = ranked(ivf.search_bits(lists, probes, asked(spark, q), centers, 80, centered=centered))
        hits = sum(len(set(got[i]) & set(brute(x, q[i], 10))) for i in range(4))
        assert hits >= 24


def test_bit_lists_in_batches(spark, data, monkeypatch):
    from tessera import scale

    x, df = data
    q = asked(spark, matrix(7, 16, 11))
    centers = ivf.train(df, 5, rounds=2)
    lists, cf = ivf.assign(df, centers), ivf.centers_frame(spark, centers)
    probes = ivf.probe(cf, q, 2)
    whole = ranked(ivf.search_bits(lists, probes, q, centers, 10))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 4)
    assert ranked(ivf.search_bits(lists, probes, q, centers, 10)) == whole
    one = q.where("qid = 0")
    wide = ivf.probe(cf, one, 5)  # more probes of one query than the bound
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 2)
    small = ranked(ivf.search_bits(lists, wide, one, centers, 10))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 50_000)
    assert small == ranked(ivf.search_bits(lists, wide, one, centers, 10))


def test_bad_vectors_are_no_candidates(spark, monkeypatch):
    from tessera import scale

    x = as_float32(matrix(40, 3))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    q = asked(spark, matrix(3, 3, 5))
    want = {i: brute(x, v, 4) for i, v in enumerate(matrix(3, 3, 5))}
    shorter = df.where("id <> 102")
    assert ranked(S.knn_batch(df, q, 4)) == want
    assert ranked(S.knn_grid(df, q, 4, block_values=60)) == want
    centers = matrix(2, 3, 9)
    lists = ivf.assign(df, centers)
    assert lists.count() == 40
    probes = ivf.probe(ivf.centers_frame(spark, centers), q, 2)
    assert ranked(ivf.search(lists, probes, q, 4)) == want
    assert sum(r["n"] for r in dim_stats(shorter).collect()) == 3 * 40


@pytest.mark.parametrize("k", [3, 1000])
def test_nearest_in_blocks(monkeypatch, k):
    from tessera.operators import kernels

    monkeypatch.setattr(kernels, "BLOCK_VALUES", 500)
    x, c = matrix(60, 4), matrix(40, 4, 7)
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    few = min(k, 40)
    assert (kernels.nearest_few(x, c, few) == np.argsort(d, axis=1, kind="stable")[:, :few]).all()
    assert (C.nearest(x, c) == d.argmin(1)).all()


def test_many_centers_train_in_two_levels(spark, data, monkeypatch):
    from tessera import scale

    x, df = data
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 300)
    c = C.lloyd(df, 24, rounds=1)[0]
    assert c.shape == (24, 16)
    near = lambda m: ((x[:, None, :] - m[None]) ** 2).sum(2).min(1).mean()
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 8_000_000)
    plain = C.lloyd(df, 24, rounds=1)[0]
    assert near(c) < 1.5 * near(plain)
    both = C.lloyd(df, 4, parts=2, rounds=1)
    assert both.shape == (2, 4, 8)


def test_stored_index_prunes_to_probed_lists(spark, data):
    _, df = data
    lists = ivf.assign(df, ivf.train(df, 6, rounds=2))
    stored = ivf.write_index(lists, work_path(spark, "t"))
    assert stored.count() == 400
    assert odd_sum(stored) == odd_sum(df)
    cf = ivf.centers_frame(spark, ivf.train(df, 6, rounds=2))
    q = asked(spark, matrix(2, 16, 11))
    plan = ivf.search(stored, ivf.probe(cf, q, 1), q, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(list_id", plan)
    assert "nearest" not in plan
    assert ivf.list_stats(lists, 6).head()["total"] == 400
