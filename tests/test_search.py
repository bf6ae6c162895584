import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_float32, asked, brute, frame, matrix, ranked

from tessera import scale
from tessera.functions import distance as D
from tessera.operators import kernels
from tessera.operators import search as S


@pytest.mark.parametrize("metric", list(D.METRICS))
def test_constant_and_column_forms_agree(spark, metric):
    x = matrix(40, 12)
    q = [float(v) for v in matrix(1, 12, 1)[0]]
    df = frame(spark, x)
    m = D.METRICS[metric]
    rows = df.select(m.to_query("embedding", q).alias("a"), m.between("embedding", D.constant(q)).alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-9 for r in rows)


@pytest.mark.parametrize("metric", ["l2", "inner_product", "cosine_similarity", "ip_distance"])
def test_batch_grid_and_brute_force_agree(spark, metric):
    x, q = as_float32(matrix(300, 8)), matrix(9, 8, 5)
    x[200:] = x[:100]  # exact copies: ties go to the lower id
    v, qs = frame(spark, x), asked(spark, q)
    small = ranked(S.knn_batch(v, qs, 7, metric))
    grid = ranked(S.knn_grid(v, qs, 7, metric, block_values=8 * 40))
    sign = 1 if metric in kernels.ASCENDING else -1
    want = {
        i: np.lexsort((np.arange(300), sign * kernels.exact_scores(x, q[i], metric)))[:7].tolist() for i in range(9)
    }
    assert small == want
    assert grid == want


def test_large_query_set_takes_the_grid(spark, monkeypatch):
    x, q = as_float32(matrix(60, 4)), matrix(10, 4, 2)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    got = ranked(S.knn_batch(frame(spark, x), asked(spark, q), 4))
    assert got == {i: brute(x, q[i], 4) for i in range(10)}


def test_wrong_vectors_drop_out(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    assert [r["id"] for r in S.knn(df, [1.0, 0.0], 10).collect()] == [1, 4]
    # the cosine of a zero vector is not defined
    assert [r["id"] for r in S.knn(df, [1.0, 0.0], 10, "cosine_similarity").collect()] == [1]


def test_range_and_outside_partition_the_table(spark):
    x = as_float32(matrix(100, 6))
    df, q = frame(spark, x), x[3].tolist()
    radius = float(np.sqrt(((x - x[3]) ** 2).sum(1))[50])
    inside = {r["id"] for r in S.range_search(df, q, radius).collect()}
    outside = {r["id"] for r in S.range_search_outside(df, q, radius).collect()}
    assert inside | outside == set(range(100)) and not inside & outside
    assert 50 in outside  # the bound itself is outside
    assert {r["id"] for r in S.compound_search(df, q, radius, 5).collect()} <= inside


def test_bound_parameters(spark):
    frame(spark, matrix(20, 3)).createOrReplaceTempView("bound_vectors")
    hit = S.knn_param_query(spark, "bound_vectors", "0.1,0.2,0.3", 4)
    assert hit.count() == 4
    x = as_float32(matrix(20, 3))
    odd = frame(spark, matrix(20, 3)).unionByName(spark.createDataFrame([(90, None), (91, [1.0])], "id long, embedding array<float>"))
    odd.createOrReplaceTempView("bound_vectors")
    for text, q in (("[0.1, 0.2, 0.3]", [0.1, 0.2, 0.3]), ("-1,0,2e0", [-1, 0, 2])):
        rows = S.knn_param_query(spark, "bound_vectors", text, 22).collect()
        assert [r["id"] for r in rows] == brute(x, np.array(q), 20)
        assert np.isclose(rows[0]["dist"], np.sqrt(((x[rows[0]["id"]] - q) ** 2).sum()))
    with pytest.raises(ValueError):
        S.knn_param_query(spark, "bound_vectors", "[1, x]", 4)
    for bad in ("x; drop table y", "a b", "1a", ""):
        with pytest.raises(ValueError):
            S.knn_param_query(spark, bad, "[1]", 4)


def test_tenants_and_samples(spark):
    assert S.tenant_set(100, 5, 42) == S.tenant_set(100, 5, 42)
    assert 42 in S.tenant_set(100, 5, 42) and len(set(S.tenant_set(100, 50, 42))) == 50
    df = frame(spark, matrix(50, 3))
    a = [r["qid"] for r in S.sample_queries([df], 5).collect()]
    assert a == [r["qid"] for r in S.sample_queries([df.limit(0), df.repartition(7)], 5).collect()]
    with pytest.raises(ValueError):
        S.sample_queries([df.limit(0)], 5)


@pytest.mark.parametrize("text,ok", [("[1,2]", True), ("1, 2.5", True), ("[]", False), ("", False), ("[1,x]", False),
                                     ("abc", False)])
def test_parse_vector(spark, text, ok):
    v = spark.createDataFrame([(text,)], "s string").select(D.parse_vector("s").alias("v")).head()["v"]
    assert (v is not None) == ok


def test_hot_groups_numbers_and_percentiles(spark):
    rows = [("hot" if i % 3 else f"k{i % 30}", i, float((i * 37) % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    plain = {tuple(r) for r in scale.row_numbers(df, ["k"], ["v", "i"]).collect()}
    spread = {tuple(r) for r in scale.row_numbers(df, ["k"], ["v", "i"], small=0).collect()}
    assert plain == spread
    ps = (0.0, 0.1, 0.5, 0.99, 1.0)
    a = {(r["k"], r["p"]): r["v"] for r in scale.percentiles(df, ["k"], "v", ps).collect()}
    b = {(r["k"], r["p"]): r["v"] for r in scale.percentiles(df, ["k"], "v", ps, small=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-9 for x in a)
    g = scale.percentiles(df, [], "v", ps, small=0).collect()
    want = np.percentile([r[2] for r in rows], [p * 100 for p in ps])
    assert np.allclose([r["v"] for r in sorted(g, key=lambda r: r["p"])], want)
    order = [F.desc("v"), F.col("i")]
    one = {tuple(r) for r in scale.rank_per_group(df, ["k"], order, 3).collect()}
    two = {tuple(r) for r in scale.rank_per_group_salted(df, ["k"], order, 3, "i", 4).collect()}
    assert one == two


def test_ranking_in_two_steps_is_the_same(spark, monkeypatch):
    x = as_float32(matrix(300, 5))
    q = asked(spark, matrix(4, 5, 2))
    plain = ranked(S.knn_batch(frame(spark, x), q, 7))
    monkeypatch.setattr(scale, "RANK_ROWS", 0)
    assert ranked(S.knn_batch(frame(spark, x), q, 7)) == plain


@pytest.mark.parametrize("values", [8_000_000, 10])
def test_metrics_in_one_scan(spark, monkeypatch, values):
    from tessera import scale

    x, q = as_float32(matrix(200, 5)), matrix(4, 5, 2)
    df, qs = frame(spark, x), asked(spark, q)
    names = ["l2", "inner_product", "cosine_similarity", "cosine_distance", "neg_inner_product"]
    want = {m: ranked(S.knn_batch(df, qs, 6, m)) for m in names}
    monkeypatch.setattr(scale, "BROADCAST_VALUES", values)
    got = S.knn_batch_metrics(df, qs, 6, names)
    for m in names:
        assert ranked(got.where(F.col("metric") == m)) == want[m]
    assert S.knn_batch_metrics(df, qs.where("qid < 0"), 6, names).count() == 0
