import math


import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st

from tests.conftest import as_float32, asked, brute, frame, matrix, ranked

from tessera import scale
from tessera.operators import graph as G
from tessera.operators import hybrid as H
from tessera.operators import ivf
from tessera.operators import kernels
from tessera.operators import postings as P
from tessera.session import work_path


@pytest.fixture(scope="module")
def world(spark):
    x = as_float32(matrix(80, 3, 4))
    df = frame(spark, x).cache()
    return x, df, G.knn_graph(df, 12).cache()


def neighbours(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: (r["src"], r["dist"], r["dst"])):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


def test_exact_graph(world):
    x, _, edges = world
    got = neighbours(edges)
    for i in range(80):
        assert got[i] == [j for j in brute(x, x[i], 13) if j != i][:12]


def test_cells_with_all_copies_equal_exact(spark, world):
    _, df, edges = world
    centers = ivf.centers_frame(spark, ivf.train(df, 4, rounds=2))
    assert neighbours(G.knn_graph_cells(df, centers, 4, 12, block=7)) == neighbours(edges)


def greedy_cover(x, p, cand, degree, alpha):
    """Reference rule on plain lists."""
    d = lambda a, b: ((x[a] - x[b]) ** 2).sum()
    out = []
    for c in cand:
        px = d(p, c)
        hit = any((d(c, y) < px) if alpha is None else (alpha * d(c, y) <= px) for y in out)
        if not hit:
            out.append(c)
        if len(out) == degree:
            break
    return out


@pytest.mark.parametrize("alpha", [None, 1.0, 1.5])
@pytest.mark.parametrize("first", [None, 2])
def test_prune_equals_the_greedy_rule(world, alpha, first):
    """Also when the first step sees too few candidates and nodes must run again."""
    x, df, edges = world
    got = neighbours(G.prune(edges, df, 4, alpha, first=first))
    cand = neighbours(edges)
    for p in cand:
        assert got[p] == greedy_cover(x, p, cand[p], 4, alpha)


def test_greedy_and_beam(spark, world):
    x, df, edges = world
    und = G.undirected(edges, 80).cache()
    links = neighbours(und)
    q = matrix(6, 3, 8)
    got = {r["qid"]: r["node"] for r in G.greedy_search(df, und, asked(spark, q), 0).collect()}
    for i in range(6):
        d = ((x - q[i]) ** 2).sum(1)
        cur = 0
        while True:
            nxt = min(links[cur], key=lambda n: (d[n], n))
            if d[nxt] >= d[cur]:
                break
            cur = nxt
        assert got[i] == cur
    wide = ranked(G.beam_search(df, und, asked(spark, q), 0, 80, 10_000, 5))
    assert wide == {i: brute(x, q[i], 5) for i in range(6)}
    some = G.beam_search(df, und, asked(spark, q), 0, 4, 12, 3).collect()
    assert len(some) == 18 and all(r["computed"] < 80 for r in some)


def test_refine_pass_bounds_degree(spark, world):
    _, df, _ = world
    start = G.with_distances(G.random_graph(df, 4), df)
    out = neighbours(G.refine_pass(df, start, 0, 5, 8))
    assert len(out) == 80 and max(map(len, out.values())) <= 5


# ---------------------------------------------------------------- text


@pytest.mark.parametrize("bound", [None, 2])
def test_bm25_against_plain_python(spark, monkeypatch, bound):
    """Both the scan for small query sets and the join for large ones."""
    if bound:
        monkeypatch.setattr(scale, "BROADCAST_VALUES", bound)
    docs = ["red apple pie", "red red wine", "blue sky over the sea", "the apple of the eye", "", "red sky"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    qs = spark.createDataFrame([(0, "red Apple"), (1, "the sky sky")], "qid long, qtext string")
    words = [d.split() for d in docs]
    n, mean = len(docs), sum(map(len, words)) / len(docs)
    freq = {w: sum(w in d for d in words) for d0 in words for w in d0}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in freq.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    got = {(r["qid"], r["doc_id"]): r["score"] for r in H.bm25(df, qs, 10).collect()}
    for qid, text in ((0, "red apple"), (1, "the sky sky")):
        for i, d in enumerate(words):
            want = sum(
                idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in text.split()
            )
            assert abs(got.get((qid, i), 0.0) - want) < 1e-6


def test_rrf(spark):
    a = spark.createDataFrame([(0, 5, 1), (0, 6, 2)], "qid long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 6, 1)], "qid long, doc_id long, rank int")
    got = {r["doc_id"]: r["score"] for r in H.rrf([a, b]).collect()}
    assert abs(got[6] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got[5] - 1 / 61) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_chunks_cover_the_text(text, size, overlap):
    chunks, at = H.split_chunks(text, size, overlap), 0
    assert all(0 < len(c) <= size for c in chunks)
    covered = 0
    for c in chunks:
        start = text.find(c, max(covered - overlap, 0) if at else 0)
        while start > covered:  # an earlier equal piece must exist: chunks leave no gap
            start = text.rfind(c, 0, start + len(c) - 1)
        assert 0 <= start <= covered
        covered, at = max(covered, start + len(c)), 1
    assert covered == len(text)




def test_climb_of_many_steps(spark):
    n = 150
    x = np.arange(n, dtype=float)[:, None] * np.ones((1, 2))
    edges = spark.createDataFrame([(i, i + 1, 2.0) for i in range(n - 1)], "src long, dst long, dist double")
    q = asked(spark, x[-1:])
    got = G.greedy_search(frame(spark, x), edges, q, 0).collect()
    assert [(r["node"], r["dist"]) for r in got] == [(n - 1, 0.0)]


def test_null_texts_are_no_documents(spark, monkeypatch):
    from tessera import scale

    docs = spark.createDataFrame(
        [(1, "a b c"), (2, None), (3, "b b"), (4, ""), (5, "c d a")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "d")], "qid long, qtext string")
    scan = sorted(map(tuple, H.bm25(docs, q, 3).collect()))
    assert scan == sorted(map(tuple, H.bm25(docs.where("text is not null"), q, 3).collect()))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 1)
    assert scan == sorted(map(tuple, H.bm25(docs, q, 3).collect()))


# ---------------------------------------------------------------- layers, hubs, stored graphs


@pytest.mark.parametrize("alpha", [None, 1.1])
def test_hub_is_pruned_in_rounds(spark, alpha):
    """One node with most of the candidates: blocks, distributed filtering, the result of one pass."""
    rng = np.random.default_rng(2)
    x = as_float32(rng.normal(size=(1500, 8)))
    df = frame(spark, x).cache()
    d = lambda a, b: float(((x[a] - x[b]) ** 2).sum())
    pairs = [(0, j) for j in range(1, 1500)] + [(i, j) for i in range(1, 30) for j in rng.choice(1500, 12, replace=False).tolist() if i != j]
    edges = spark.createDataFrame([(int(a), int(b), d(a, b)) for a, b in pairs], "src long, dst long, dist double").repartition(5)
    for first in (3, 20, 5000):
        got = neighbours(G.prune(edges, df, 10, alpha, first=first))
        for p in {a for a, _ in pairs}:
            cand = sorted({b for a, b in pairs if a == p}, key=lambda j: (d(p, j), j))
            assert got[p] == greedy_cover(x, p, cand, 10, alpha), (first, p)


def test_uncovered_rows_spread_over_tasks(spark):
    """What is held against the kept vectors is one row per candidate, not one group per node."""
    x = as_float32(matrix(300, 4))
    df = frame(spark, x)
    rest = spark.createDataFrame([(0, j, float(((x[0] - x[j]) ** 2).sum())) for j in range(50, 300)], "src long, dst long, dist double")
    kept = spark.createDataFrame([(0, j, 0.0, True) for j in (3, 7)], "src long, dst long, dist double, pre boolean")
    left = G._uncovered(rest, kept, df, None, "id", "embedding")
    want = {j for j in range(50, 300) if all(((x[j] - x[y]) ** 2).sum() >= ((x[0] - x[j]) ** 2).sum() for y in (3, 7))}
    assert {r.dst for r in left.collect()} == want
    assert "MapInArrow" not in left._jdf.queryExecution().executedPlan().toString()


def beam_brute(x, links, q, entry, beam, budget, k):
    d = ((x - q) ** 2).sum(1)
    seen, done = [entry], set()
    while len(seen) < budget:
        near = sorted(seen, key=lambda n: (d[n], n))[:beam]
        todo = [n for n in near if n not in done]
        if not todo:
            break
        done.update(todo)
        for n in sorted({m for t in todo for m in links.get(t, [])} - set(seen)):
            seen.append(n)
    return sorted(seen, key=lambda n: (d[n], n))[:k], len(seen)


@pytest.mark.parametrize("rows", [50_000, 3])
def test_beam_search_over_a_stored_graph(spark, world, rows, monkeypatch):
    x, df, edges = world
    und = G.undirected(edges, 80)
    links = neighbours(und)
    path = work_path(spark, "graph")
    v, e = G.store_graph(df, und, "g_" + path.rsplit("-", 1)[1], path, 8)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    q = matrix(5, 3, 8)
    for beam, budget in ((3, 20), (8, 60)):
        got = G.beam_search(v, e, asked(spark, q), 0, beam, budget, 6).collect()
        for i, one in enumerate(q):
            want, n = beam_brute(x, links, one, 0, beam, budget, 6)
            mine = sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])
            assert [r["id"] for r in mine] == want and {r["computed"] for r in mine} == {n}


def exchanges_above(plan, table):
    """Whether an exchange lies above the scan of a table in a formatted plan's tree."""
    lines = [line for line in plan.split("\n\n")[0].splitlines() if line.strip()]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    at = next(i for i, line in enumerate(lines) if table in line)
    level = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            if "Exchange" in line:
                return True
    return False


def test_only_the_frontier_moves(spark, world, monkeypatch):
    x, df, edges = world
    path = work_path(spark, "graph")
    name = "g_" + path.rsplit("-", 1)[1]
    v, e = G.store_graph(df, G.undirected(edges, 80), name, path, 8)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ask = G._Asked(v, e, asked(spark, matrix(9, 3, 8)), "id", "embedding")
        active = spark.createDataFrame([(q, n) for q in range(9) for n in range(40)], "qid long, node long")
        hops = ask.around(active, 360)
        scored = ask.scored(active, 360)
        for df_, table in ((hops, f"{name}_edges"), (scored, f"{name}_nodes")):
            tree = df_._jdf.queryExecution().executedPlan().treeString()
            lines = tree.splitlines()
            at = next(i for i, line in enumerate(lines) if table in line)
            indent = len(lines[at]) - len(lines[at].lstrip(" :+-"))
            up, level = [], indent
            for line in reversed(lines[:at]):
                here = len(line) - len(line.lstrip(" :+-"))
                if here < level:
                    up.append(line.strip(" :+-"))
                    level = here
            below_join = up[: next(i for i, line in enumerate(up) if "Join" in line)]
            assert not any("Exchange" in line for line in below_join), tree
        seen = G._Seen(spark, 8)
        rows = active.withColumn("dist", F.col("node") * 1.0)
        assert seen.add(rows.where("node < 20")).count() == 9 * 20
        assert seen.add(rows.where("node < 5 and qid < 0")).count() == 0
        assert seen.without(active).count() == 9 * 20
        seen.drop()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layers(spark):
    x = as_float32(np.random.default_rng(9).uniform(size=(1000, 2)))  # long ways without layers
    df = frame(spark, x).cache()
    centers = ivf.centers_frame(spark, ivf.train(df, 8, rounds=3))
    layers = scale.cut_lineage(G.layered_graph(df, centers, 3, 10, 24))
    level = {r["id"]: r["l"] for r in df.select("id", G.node_level(F.col("id")).alias("l")).collect()}
    rows = layers.collect()
    assert all(min(level[r["src"]], level[r["dst"]]) >= r["level"] for r in rows)
    counts = G.level_counts(df).orderBy("level").collect()
    assert [r["nodes"] for r in counts] == [sum(v == lv for v in level.values()) for lv in range(len(counts))]
    assert [r["reached"] for r in counts] == [sum(v >= lv for v in level.values()) for lv in range(len(counts))]
    assert len(counts) >= 3 and counts[1]["reached"] < 0.4 * counts[0]["reached"]
    top, node = G.top_node(df)
    assert (top, node) == (max(level.values()), min(i for i, v in level.items() if v == max(level.values())))
    q = asked(spark, x[::100] + 0.001)
    got = G.layered_search(df, layers, q, 16, 10_000, 10)
    want = {i: set(brute(x, v, 10)) for i, v in enumerate(x[::100] + 0.001)}
    found = ranked(got)
    recall = np.mean([len(want[i] & set(found[i])) / 10 for i in want])
    flat = G.beam_search(df, layers.where("level = 0").drop("level"), q, 0, 16, 10_000, 10)
    flat_found = ranked(flat)
    cost = lambda f: f.groupBy("qid").agg(F.max("computed").alias("c")).agg(F.avg("c").alias("m")).head()["m"]
    assert recall >= 0.9 and recall >= np.mean([len(want[i] & set(flat_found[i])) / 10 for i in want]) - 0.02
    assert cost(got) < cost(flat)  # fewer computed distances than without layers


# ---------------------------------------------------------------- stored postings


def corpus(spark, n=600):
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    share = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40), p=share / share.sum())) + (" rare" if i == 577 else "") for i in range(n)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9001, None), (9002, "W1 w1\tw2"), (9003, texts[5]), (9004, texts[5])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def asks(spark):
    return spark.createDataFrame([(0, "w1 w2 rare"), (1, "w0 w0 w3 unknown"), (2, "nothing here"), (3, ""), (4, "w200 w300 W399"), (5, "w0")], "qid long, qtext string")


@pytest.mark.parametrize("block,first,values", [(16, 1, 8_000_000), (64, 2, 8_000_000), (64, 2, 5), (10_000, 2, 8_000_000)])
def test_postings_equal_the_scan(spark, block, first, values, monkeypatch):
    """Both the matrices for small query sets and the join for large ones."""
    docs, q = corpus(spark), asks(spark)
    monkeypatch.setattr(scale, "BROADCAST_VALUES", values)
    index = P.write_postings(docs, work_path(spark, "p"), block_docs=block)
    assert max(r["n"] for r in index.blocks.select("n").collect()) <= block
    for k in (1, 7, 2000):
        want = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in H.bm25(docs, q, k).collect()}
        got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in P.bm25_search(index, q, k, first=first).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], abs_tol=1e-8) for i in got)


def test_blocks_out_of_reach_stay_closed(spark):
    docs, q = corpus(spark), asks(spark)
    index = P.write_postings(docs, work_path(spark, "p"), block_docs=16)
    found, steps = P.search_steps(index, q, 3)
    rows = steps.collect()
    best = {}
    for r in found.collect():
        best.setdefault(r["qid"], []).append(r["score"])
    assert 0 < sum(r["opened"] for r in rows) < len(rows)
    # one document has the rare word: its block gives a bar that no other block reaches
    rare = [r for r in P.search_steps(index, q, 1)[1].collect() if r["qid"] == 0]
    assert len(rare) > 30 and sum(r["opened"] for r in rare) == P.FIRST_BLOCKS
    for r in rows:
        if not r["opened"]:
            assert r["bound"] < min(best[r["qid"]])


def test_no_text_is_read_at_query_time(spark):
    docs = corpus(spark)
    index = P.write_postings(docs, work_path(spark, "p"), block_docs=64)
    weights = P.weights_of(index, asks(spark))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "In(token" in plan.replace("PushedFilters: [In(token", "In(token") and "IsNotNull(token)" in plan
    opened = P._scored(index, scale.cut_lineage(weights), scale.cut_lineage(P.block_bounds(index, weights)))
    text = opened._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in text and "blocks" in text
    metadata = P.block_bounds(index, weights)._jdf.queryExecution().executedPlan().toString()
    assert "docs" not in metadata.split("FileScan")[1].split("ReadSchema")[1][:80]


def test_postings_of_nothing(spark):
    docs = corpus(spark).where("doc_id < 0")
    index = P.write_postings(docs, work_path(spark, "p"))
    assert P.bm25_search(index, asks(spark), 5).count() == 0


def test_postings_build_moves_texts_once_and_words_never(spark, tmp_path, monkeypatch):
    """Words are counted where their block is; many (query, block) pairs still take the matrices."""
    docs, q = corpus(spark, 300), asks(spark)
    path = work_path(spark, "p")
    index = P.write_postings(docs, path, block_docs=16)
    files = index.blocks.select("block", F.input_file_name().alias("f")).distinct().groupBy("block").count()
    assert files.agg(F.max("count")).head()[0] == 1
    want = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in H.bm25(docs, q, 5).collect()}
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 20)  # fewer than pairs

    def joined(*_):
        raise AssertionError("every posting was repeated per query")

    monkeypatch.setattr(P, "_scored", joined)
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in P.bm25_search(index, q, 5).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], abs_tol=1e-8) for i in got)


def test_postings_of_repeated_ids_stay_in_a_block(spark):
    rows = [(i // 3, "a b" if i % 2 else "a c c") for i in range(60)] + [(None, "a b"), (70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = P.write_postings(docs, work_path(spark, "p"), block_docs=2)
    assert index.n_docs == 61
    per = index.blocks.where("token = 'a'").select("block", F.explode("docs").alias("doc")).distinct().groupBy("doc").count()
    assert {r["count"] for r in per.collect()} == {1} and per.count() == 20


# ---------------------------------------------------------------- kernels


def test_best_rows_of_many_queries_in_arrays():
    """Positions that come again, ties, and few batches for many queries."""
    rng = np.random.default_rng(5)
    x, qs = rng.integers(-2, 3, (500, 4)).astype(float), rng.integers(-2, 3, (700, 4)).astype(float)
    top = kernels.TopK(qs, 6, "l2_sq")
    for s in range(0, 500, 90):
        top.add(np.arange(s, min(s + 90, 500)), x[s : s + 90])
    d = ((qs[:, None, :] - x[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")[:, :6]
    (p, ids, score), = top.rows()
    assert (ids.reshape(700, 6) == order).all() and (score.reshape(700, 6) == np.take_along_axis(d, order, 1)).all()
    best = kernels.Best(700, 6)
    for s in range(0, 500, 90):
        best.add(np.arange(700), d[:, s : s + 90], np.arange(s, min(s + 90, 500)))
    assert (next(best.rows())[1] == ids).all()
    types = [pa.int64(), pa.int64()]
    assert len(list(kernels.all_hits(types, list(range(700)), top))) == 1
    twice = kernels.TopK(qs[:2], 4, "l2_sq")
    twice.add(np.array([7, 8]), x[:2], np.array([0, 1, 0]))
    assert [len(i) for _, i, _ in twice.result()] == [4, 2]
    inside = {(int(a), int(b)) for q, i, _ in kernels.pairs_within(x, qs, 1.5) for a, b in zip(q, i)}
    assert inside == set(zip(*map(np.ndarray.tolist, np.nonzero(np.sqrt(d) < 1.5))))
