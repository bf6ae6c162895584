"""Registered queries: neighbour graphs, keyword and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import scale
from tessera.operators import graph as G
from tessera.operators import hybrid as H
from tessera.operators import postings as P
from tessera.plans.index import CENT, centers, r6
from tessera.plans.registry import kept, query
from tessera.plans.vectors import QSET, qset
from tessera.session import work_path

KNN = """p as (select a.vec_id as src, b.vec_id as dst,
      pow(list_distance(a.embedding::double[], b.embedding::double[]), 2) as dist
    from {embeddings} a join {embeddings} b on a.vec_id <> b.vec_id),
  knn as (select src, dst, dist from p
    qualify row_number() over (partition by src order by round(dist, 12), dst) <= DEG)"""


CELLS = f"""{CENT}, cells as (select vec_id as id, list_id, embedding::double[] as v from {{embeddings}}, cent
    qualify row_number() over (partition by vec_id order by list_distance(embedding::double[], cv), list_id) <= 3)"""


def knn_sql(degree: int) -> str:
    """The graph from overlapping clusters, on which the other graph queries are built."""
    return CELLS + f""", p as (select distinct a.id as src, b.id as dst, pow(list_distance(a.v, b.v), 2) as dist
      from cells a join cells b using (list_id) where a.id <> b.id),
    knn as (select src, dst, dist from p
      qualify row_number() over (partition by src order by round(dist, 12), dst) <= {degree})"""


BOTH = """twoway as (select src, dst, min(dist) as dist from
    (from knn union all select dst as src, src as dst, dist from knn) group by all)"""


def cell_graph(t, degree: int):
    """Every vector in its three nearest clusters; no comparison of all pairs."""
    return G.knn_graph_cells(t.user_vectors, centers(t), 3, degree)


def stored_graph(t, degree: int, both: int):
    """An undirected graph written once, as searches read it in every round."""
    return scale.cut_lineage(G.undirected(cell_graph(t, degree), both))


@query("knn_graph", f"with {KNN.replace('DEG', '8')} select src, dst, round(dist, 6) as dist from knn")
def knn_graph(t):
    """The exact graph, block against block: the check of the one from clusters."""
    return r6(G.knn_graph(t.user_vectors, 8), "dist")


@query(
    "overlap_assign",
    f"""with {CENT} select vec_id as id, list_id, row_number() over
      (partition by vec_id order by list_distance(embedding::double[], cv), list_id)::int as rank
    from {{embeddings}}, cent qualify rank <= 3""",
)
def overlap_assign(t):
    return G.overlap_assign(t.user_vectors, centers(t), 3).select("id", "list_id", "rank")


@query(
    "knn_graph_cells",
    f"with {knn_sql(8)} select src, dst, round(dist, 6) as dist from knn",
)
def knn_graph_cells(t):
    """The graph from overlapping clusters, every vector in its three nearest."""
    return r6(cell_graph(t, 8), "dist")


@query("set_union_edges", f"with {knn_sql(6)}, {BOTH} select src, dst, round(dist, 6) as dist from twoway")
def set_union_edges(t):
    e = cell_graph(t, 6)
    return r6(G.union_edges(e, G.reverse(e)), "dist")


@query(
    "graph_undirected",
    f"""with {knn_sql(6)}, {BOTH} select src, dst, round(dist, 6) as dist from twoway
    qualify row_number() over (partition by src order by dst) <= 8""",
)
def graph_undirected(t):
    return r6(G.undirected(cell_graph(t, 6), 8), "dist")


@query(
    "graph_prune_nearest",
    f"""with {knn_sql(8)}, {BOTH}, near as (select src, dst, dist from twoway
      qualify row_number() over (partition by src order by round(dist, 12), dst) <= 5)
    select a.src, a.dst, round(a.dist, 6) as dist from near a join near b on a.src = b.dst and a.dst = b.src""",
)
def graph_prune_nearest(t):
    e = cell_graph(t, 8)
    return r6(G.prune_nearest(G.union_edges(e, G.reverse(e)), 5), "dist")


@query(
    "graph_degree_stats",
    f"""with {knn_sql(6)}, {BOTH}, d as (select src, count(*) as degree from twoway group by src)
    select degree, count(*) as nodes from d group by degree""",
)
def graph_degree_stats(t):
    e = cell_graph(t, 6)
    return G.degree_stats(G.union_edges(e, G.reverse(e)))


def beam_ctes(start: str, links: str, beam: int, budget: int, tag: str = "") -> str:
    """CTE ``seen<tag>``: (qid, seen) after all rounds from ``start`` (qid, node, dist) over ``links`` (src, dst).

    ``d`` must hold (qid, node, dist). A round is one step: the nodes among the nearest ``beam`` seen ones that
    were not expanded give their unseen neighbours, each once.
    """
    return f"""bs{tag} as (
      select qid, 0 as r, [{{{{'dist': dist, 'node': node, 'done': false}}}}] as seen from {start}
      union all
      select qid, r + 1, list_concat(list_transform(seen, lambda s: {{{{'dist': s.dist, 'node': s.node, 'done': s.done or list_contains(todo, s.node)}}}}), fresh)
      from (select t.qid, t.r, any_value(t.seen) as seen, any_value(t.todo) as todo, coalesce(list(distinct {{{{'dist': d.dist, 'node': d.node, 'done': false}}}})
            filter (where d.node is not null and not list_contains(t.nodes, d.node)), []) as fresh
          from (select qid, r, seen, list_transform(list_filter(list_sort(seen)[1:{beam}], lambda s: not s.done), lambda s: s.node) as todo,
              list_transform(seen, lambda s: s.node) as nodes from bs{tag} where len(seen) < {budget}) t, unnest(t.todo) as u(x)
            left join {links} l on l.src = u.x left join d on d.qid = t.qid and d.node = l.dst
          group by t.qid, t.r)),
    seen{tag} as materialized (select qid, arg_max(list_sort(seen), r) as seen from bs{tag} group by qid)"""


def beam_hits(k: int, extra: str = "0", join: str = "", tag: str = "") -> str:
    return f"""select qid, seen[rank].node as id, round(seen[rank].dist, 6) as dist, rank::int as rank, len(seen) + {extra} as computed
    from (select *, unnest(range(1, least(len(seen), {k}) + 1)) as rank from seen{tag}) {join}"""


def prune_ctes(out: str, cand: str, degree: int, alpha: float) -> str:
    """CTE ``out`` (src, dst, dist): greedy pruning of ``cand`` (src, dst, dist), one candidate rank per recursion step."""
    covers = f"{alpha}::double * pow(list_distance(y.v, c.v), 2) <= c.dist"
    return f"""{out}_c as materialized (select src, dst, dist, embedding::double[] as v, row_number() over (partition by src order by dist, dst) as rn
        from {cand} join {{embeddings}} on vec_id = dst),
      {out}_g as (select vec_id as src, 0 as i, []::struct(id bigint, v double[], px double)[] as kept from {{embeddings}}
        union all
        select g.src, g.i + 1, case when len(kept) < {degree} and len(list_filter(kept, lambda y: {covers})) = 0
          then list_append(kept, {{{{'id': c.dst, 'v': c.v, 'px': c.dist}}}}) else kept end
        from {out}_g g join {out}_c c on c.src = g.src and c.rn = g.i + 1),
      {out} as materialized (select src, k.id as dst, k.px as dist from
        (select src, unnest(kept) as k from (select src, arg_max(kept, i) as kept from {out}_g group by src)))"""


def braces(sql: str) -> str:
    """Struct literals lose the doubling that keeps them apart from table marks."""
    return sql.replace("{{", "{").replace("}}", "}")


UND = "und as materialized (select src, dst from twoway qualify row_number() over (partition by src order by dst) <= 20)"
D_QUERIES = """d as materialized (select qid, vec_id as node, pow(list_distance(embedding::double[], qv), 2) as dist
        from {embeddings}, qset)"""


def prune_sql(covers: str) -> str:
    """Greedy pruning of 24 candidates per node to 8, one candidate rank per recursion step."""
    return f"""with recursive {knn_sql(24)},
      cand as materialized (select src, dst, dist, embedding::double[] as v,
        row_number() over (partition by src order by dist, dst) as rn
        from knn join {{embeddings}} on vec_id = dst),
      g as (select vec_id as src, 0 as i, []::struct(id bigint, v double[], px double)[] as kept from {{embeddings}}
        union all
        select g.src, g.i + 1, case when len(kept) < 8
          and len(list_filter(kept, lambda y: {covers})) = 0
          then list_append(kept, {{{{'id': c.dst, 'v': c.v, 'px': c.dist}}}}) else kept end
        from g join cand c on c.src = g.src and c.rn = g.i + 1)
    select src, k.id as dst, round(k.px, 6) as dist from (select src, unnest(kept) as k from g where i = 24)
    """.replace("{{", "{").replace("}}", "}")


D_XY = "pow(list_distance(y.v, c.v), 2)"


@query("graph_prune_rng", prune_sql(f"{D_XY} < c.dist"))
def graph_prune_rng(t):
    return r6(G.prune(cell_graph(t, 24), t.user_vectors, 8), "dist")


@query("graph_prune_robust", prune_sql(f"0.6::double * {D_XY} <= c.dist"))
def graph_prune_robust(t):
    """The factor is below one because random vectors hardly cover each other at 1.2."""
    return r6(G.prune(cell_graph(t, 24), t.user_vectors, 8, alpha=0.6), "dist")


@query(
    "graph_greedy_search",
    f"""with recursive {knn_sql(10)}, {BOTH}, {QSET},
      und as materialized (select src, dst from twoway qualify row_number() over (partition by src order by dst) <= 20),
      d as materialized (select qid, vec_id as node, pow(list_distance(embedding::double[], qv), 2) as dist
        from {{embeddings}}, qset),
      g as (select qid, node, dist, 1::bigint as computed, true as moved from d where node = 0
        union all
        select qid, case when bd < dist then bn else node end, least(bd, dist), computed + c, bd < dist
        from (select g.qid, g.node, g.dist, g.computed, min(d.dist) as bd, arg_min(d.node, d.dist) as bn, count(*) as c
          from g join und on und.src = g.node join d on d.qid = g.qid and d.node = und.dst
          where g.moved group by all))
    select qid, node, round(dist, 6) as dist, computed from g where not moved""",
)
def graph_greedy_search(t):
    return r6(G.greedy_search(t.user_vectors, stored_graph(t, 10, 20), qset(t), 0), "dist")


@query(
    "graph_beam_search",
    braces(f"""with recursive {knn_sql(10)}, {BOTH}, {QSET}, {UND}, {D_QUERIES},
      st as (select * from d where node = 0), {beam_ctes("st", "und", 16, 200)} {beam_hits(10)}"""),
)
def graph_beam_search(t):
    return r6(G.beam_search(t.user_vectors, stored_graph(t, 10, 20), qset(t), 0, 16, 200, 10), "dist")


# every node draws eight others by number; numbers follow the ids
START = """nd as (select vec_id as id, row_number() over (order by vec_id) as i, count(*) over () as n from {embeddings}),
  pick as (select distinct a.id as src, b.id as dst from (select id, n, unnest(range(1, 9)) as k from nd) a
    join nd b on b.i = ('0x' || substr(md5(concat('42:', a.id, ':', a.k)), 1, 8))::bigint % a.n + 1 where a.id <> b.id),
  vv as (select vec_id as id, embedding::double[] as v from {embeddings}),
  pe as materialized (select src, dst, pow(list_distance(a.v, b.v), 2) as dist from pick join vv a on a.id = src join vv b on b.id = dst)"""


@query(
    "graph_refine_pass",
    braces(f"""with recursive {START},
      d as materialized (select a.id as qid, b.id as node, pow(list_distance(a.v, b.v), 2) as dist from vv a, vv b),
      st as (select * from d where node = 0), {beam_ctes("st", "pe", 16, 64)},
      cand as (select src, dst, min(dist) as dist from (select qid as src, s.node as dst, s.dist from
          (select qid, unnest(seen[1:32]) as s from seen) union all from pe) where src <> dst group by all),
      {prune_ctes("one", "cand", 8, 1.2)},
      back as (select src, dst, min(dist) as dist from (from one union all select dst, src, dist from one) group by all),
      {prune_ctes("two", "back", 8, 1.2)}
    select src, dst, round(dist, 6) as dist from two"""),
)
def graph_refine_pass(t):
    """One build pass for every node from a seeded start graph."""
    start = scale.cut_lineage(G.with_distances(G.random_graph(t.user_vectors, 8), t.user_vectors))
    return r6(G.refine_pass(t.user_vectors, start, 0, 8, 16), "dist")


# ---------------------------------------------------------------- layers

# levels by leading zero bits of a hash, two bits a level; on each a graph of the nodes that reach it
LAYERS = CELLS + """, lv as (select vec_id as id, floor((31 - floor(log2(greatest(('0x' || substr(md5(concat('42:level:', vec_id)), 1, 8))::bigint, 0.5::double)))) / 2)::bigint as level
    from {embeddings}),
  lc as (select l.level as top, cells.* from cells join lv l on l.id = cells.id),
  lp as (select distinct unnest(range(0, least(a.top, b.top)::bigint + 1)) as level, a.id as src, b.id as dst, pow(list_distance(a.v, b.v), 2) as dist
    from lc a join lc b using (list_id) where a.id <> b.id),
  lk as (select * from lp qualify row_number() over (partition by level, src order by round(dist, 12), dst) <= 10),
  lb as (select level, src, dst, min(dist) as dist from (from lk union all select level, dst as src, src as dst, dist from lk) group by all),
  lu as materialized (select * from lb qualify row_number() over (partition by level, src order by dst) <= 20)"""


def layers(t):
    """The layered graph, written once per state of the table's files."""

    def make() -> str:
        path = work_path(t.spark, "layers")
        G.layered_graph(t.user_vectors, centers(t), 3, 10, 20).write.partitionBy("level").parquet(path)
        return path

    return t.spark.read.parquet(kept(t, "layers", make))


@query("graph_layers", f"with {LAYERS} select level::int as level, src, dst, round(dist, 6) as dist from lu")
def graph_layers(t):
    return r6(layers(t).select("level", "src", "dst", "dist"), "dist")


@query(
    "graph_layer_counts",
    f"""with {LAYERS}, m as (select unnest(range(0, max(level)::bigint + 1)) as level from lv),
      c as (select m.level, count(lv.id) as nodes from m left join lv on lv.level = m.level group by m.level),
      le as (select level, count(*) as edges from lu group by level)
    select c.level::int as level, nodes, (sum(nodes) over (order by c.level desc))::bigint as reached, coalesce(edges, 0) as edges
    from c left join le on le.level = c.level""",
)
def graph_layer_counts(t):
    """Nodes by highest level, nodes on each level, and edges there."""
    edges = layers(t).groupBy("level").agg(F.count("*").alias("edges"))
    return G.level_counts(t.user_vectors).join(edges, "level", "left").select(
        "level", "nodes", "reached", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(
    "graph_layer_search",
    braces(f"""with recursive {LAYERS}, {QSET}, {D_QUERIES},
      tp as (select level::bigint as level, min(id) as node from lv where level = (select max(level) from lv) group by 1),
      g as (select qid, tp.level, tp.node, dist, 1::bigint as computed from d join tp on tp.node = d.node
        union all
        select qid, case when bd < dist then level else level - 1 end, case when bd < dist then bn else node end,
          case when bd < dist then bd else dist end, computed + c
        from (select g.qid, g.level, g.node, g.dist, g.computed, min(d.dist) as bd, arg_min(d.node, d.dist) as bn, count(d.node) as c
          from g left join lu on lu.level = g.level and lu.src = g.node left join d on d.qid = g.qid and d.node = lu.dst
          where g.level > 0 group by all)),
      st as (select * from g where level = 0), l0 as (select src, dst from lu where level = 0),
      {beam_ctes("st", "l0", 16, 200)} {beam_hits(10, "st.computed - 1", "join st using (qid)")}"""),
)
def graph_layer_search(t):
    """A climb on every level from the top, then a beam on the lowest."""
    return r6(G.layered_search(t.user_vectors, layers(t), qset(t), 16, 200, 10), "dist")


# ---------------------------------------------------------------- text

TOKENS = r"""words as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') as ws
    from {documents})"""


@query(
    "txt_tokenize",
    f"""with {TOKENS}, w as (select doc_id, unnest(ws) as token from words)
    select doc_id, token, count(*) as n from w group by all""",
)
def txt_tokenize(t):
    return H.tokenize(t.documents).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


BM25 = TOKENS + r""", st as (select count(*) as n, avg(len(ws)) as mean_len from words),
  tf as (select doc_id, len as dl, token, count(*) as tf from
    (select doc_id, len(ws) as len, unnest(ws) as token from words) group by all),
  df as (select token, count(*) as df from tf group by token),
  raw as (select token, mean_len, ln(n - df + 0.5::double) - ln(df + 0.5::double) as raw from df, st),
  idf as (select token, mean_len, case when raw < 0 then 0.25::double * (select avg(raw) from raw) else raw end as idf from raw),
  ask as (select item_id as qid, token, count(*) as times from (select item_id,
    unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) as token from {benchmark}) group by all),
  sc as (select qid, doc_id, round(sum(times * idf * tf * 2.5::double
    / (tf + 1.5::double * (0.25::double + 0.75::double * dl / mean_len))), 9) as score
    from ask join idf using (token) join tf using (token) group by all),
  bm as (select *, row_number() over (partition by qid order by score desc, doc_id)::int as rank from sc qualify rank <= TOPK)"""


def asked(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))


@query("bm25_rank", f"with {BM25.replace('TOPK', '10')} select qid, doc_id, round(score, 6) as score from bm")
def bm25_rank(t):
    """Every passage of the benchmark table as a query over all documents, from stored postings."""
    return r6(P.bm25_search(postings(t), asked(t), 10), "score").drop("rank")


def postings(t):
    """The keyword index of the documents, written once per state of the table's files."""

    def make() -> str:
        path = work_path(t.spark, "postings")
        P.write_postings(t.documents, path, block_docs=256)
        return path

    return P.read_postings(t.spark, kept(t, "postings", make, "documents"))


@query("bm25_scan", f"with {BM25.replace('TOPK', '10')} select qid, doc_id, round(score, 6) as score from bm")
def bm25_scan(t):
    """The same ranking in one pass over the texts, without an index."""
    return r6(H.bm25(t.documents, asked(t), 10), "score").drop("rank")


VRANK = """vq as (select vec_id as qid, embedding::double[] as qv from {embeddings} join {benchmark} on item_id = vec_id),
  vr as (select qid, vec_id as doc_id, list_distance(embedding::double[], qv) as dist, row_number() over
    (partition by qid order by list_distance(embedding::double[], qv), vec_id)::int as rank
    from {embeddings}, vq qualify rank <= 10)"""


def vector_ranking(t):
    """Vectors stand for documents of the same number, those of the benchmark items are queries."""
    docs = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    q = docs.join(t.benchmark, F.expr("doc_id = item_id"), "left_semi").select(
        F.col("doc_id").alias("qid"), F.col("embedding").alias("qvec"))
    return H.vec_rank(docs, q, 10)


@query("vec_rank", f"with {VRANK} select qid, doc_id, round(dist, 6) as dist, rank from vr")
def vec_rank(t):
    return r6(vector_ranking(t), "dist")


@query(
    "rrf_fuse",
    f"""with {BM25.replace('TOPK', '10')}, {VRANK} select qid, doc_id, round(sum(1 / (60.0::double + rank)), 6) as score
    from (select qid, doc_id, rank from bm union all select qid, doc_id, rank from vr) group by all""",
)
def rrf_fuse(t):
    words = P.bm25_search(postings(t), asked(t), 10)
    return r6(H.rrf([words, vector_ranking(t)]), "score")


def chunk_sql() -> str:
    """Chunks by recursion over their starts: ``ch (doc_id, chunk_no, chunk)``."""
    size, overlap = H.CHUNK_SIZE, H.CHUNK_OVERLAP
    full = f"least(s + {size}, n)"
    seg = f"reverse(substring(text, s + {overlap + 2}, {full} - s - {overlap + 1}))"
    cuts = ", ".join(
        f"{full} - nullif(strpos({seg}, {sep}), 0) + 1" for sep in ("chr(10) || chr(10)", "chr(10)", "' '"))
    end = f"case when {full} < n then coalesce({cuts}, {full}) else n end"
    back = f"greatest(e - {overlap}, s + 1)"
    gap = f"nullif(strpos(substring(text, {back} + 1, e - {back}), ' '), 0)"
    return f"""starts as (select doc_id, chunk_no, s, {end} as e, text, n from
        (select doc_id, 0 as chunk_no, 0::bigint as s, text, length(text) as n from {{documents}} where text <> '')
      union all
      select doc_id, chunk_no, s, {end}, text, n from
        (select doc_id, chunk_no + 1 as chunk_no, text, n,
          case when {back} + {gap} - 1 < e - 1 then {back} + {gap} else {back} end as s from starts where e < n)),
    ch as (select doc_id, chunk_no, substring(text, s + 1, e - s) as chunk from starts)"""


@query("txt_chunk", f"with recursive {chunk_sql()} select doc_id, chunk_no, chunk from ch")
def txt_chunk(t):
    return H.chunk_text(t.documents)


@query(
    "retrieve_context",
    f"""with recursive {chunk_sql()}, {CENT}, r as (select list_id as qid, doc_id || ':' || chunk_no as chunk_id,
        list_distance(embedding::double[], cv) as dist, chunk
      from ch join {{embeddings}} on vec_id = doc_id % (select count(*) from {{embeddings}}), cent)
    select qid, chunk_id, round(dist, 6) as dist, row_number() over w::int as rank, chunk from r
    window w as (partition by qid order by round(dist, 9), chunk_id) qualify row_number() over w <= 3""",
)
def retrieve_context(t):
    """Chunks of every document; vectors stand for documents round robin, the label means ask."""
    n = t.embeddings.agg(F.count("*").alias("n"))  # one row
    docs = t.documents.crossJoin(F.broadcast(n)).join(t.embeddings, F.expr("doc_id % n = vec_id"))
    vectors = docs.select("doc_id", "embedding")
    chunks = H.chunk_text(t.documents).join(vectors, "doc_id").select(
        F.concat_ws(":", "doc_id", "chunk_no").alias("chunk_id"), "chunk", "embedding")
    q = centers(t).select(F.col("list_id").alias("qid"), F.col("center").alias("qvec"))
    return r6(H.retrieve_context(chunks, q, 3), "dist")


