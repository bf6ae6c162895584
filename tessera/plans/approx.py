"""Registered queries: further forms of approximate search.

As in the other list searches, centers are the mean vectors of the labels, which both engines compute
from the whole table, and the queries are every row whose id is divisible by 20.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.vectorstats import mean_vector
from tessera.operators import approx as A
from tessera.operators import ivf
from tessera.operators import quality as Q
from tessera.operators import quantize as C
from tessera.operators import search as S
from tessera.plans.index import (
    ASG, CENT, FACTOR, HITS, PQ, book, centers, found, levels_of, lists, lloyd_sql, prb, r6, refined, stored,
)
from tessera.plans.registry import kept, query
from tessera.plans.vectors import E64, QSET, qset
from tessera.session import work_path

# ---------------------------------------------------------------- range


@query(
    "knn_approx_range",
    f"""with {QSET}, d as (select qid, vec_id as id, list_distance({E64}, qv) as dist from {{embeddings}}, qset)
    select qid, id, round(dist, 6) as dist, row_number() over (partition by qid order by dist, id)::int as rank
    from d where dist < 1.2""",
)
def knn_approx_range(t):
    """Every vector within the radius, from lists in reach only."""
    index, reach = kept(t, "range", lambda: A.write_range_index(lists(t), centers(t), work_path(t.spark, "index-range")))
    return r6(A.range_search(index, reach, qset(t), 1.2), "dist")


# ---------------------------------------------------------------- residual product codes

# residuals of the assigned vectors, a code book trained on them, their codes, and the tables of queries
RESIDUAL = f"""{ASG}, re as materialized (select asg.id as vec_id, e.pos, e.x - cl.c as x from asg join e on e.vec_id = asg.id
    join cl on cl.list_id = asg.list_id and cl.pos = e.pos), {lloyd_sql(8, 16, 3, "_r", "re")},
  rc as (select vec_id, part, code from (select vec_id, part, code, sum((x - c) * (x - c)) as d from re join c3_r using (pos) group by all)
    qualify row_number() over (partition by vec_id, part order by d, code) = 1)"""
TABLES = """qe as (select qid, generate_subscripts(qv, 1) - 1 as pos, unnest(qv) as x from qset),
  tab as (select qid, prb.list_id, part, code, sum((qe.x - cl.c - w.c) * (qe.x - cl.c - w.c)) as d
    from prb join qe using (qid) join cl on cl.list_id = prb.list_id and cl.pos = qe.pos join c3_r w on w.pos = qe.pos group by all),
  rd as (select qid, vec_id as id, sqrt(sum(d)) as dist from rc join asg on asg.id = rc.vec_id
    join tab on tab.list_id = asg.list_id and tab.part = rc.part and tab.code = rc.code group by all),
  rf as (select qid, id, dist, row_number() over (partition by qid order by round(dist, 9), id) as rank from rd qualify rank <= 10)"""


def residual_codes(t):
    """(index, codec): stored residual codes and the code book trained on all residuals."""

    def make():
        codec = C.pq_train(A.residuals(lists(t), centers(t)), parts=8, bits=4, rounds=3)
        path = work_path(t.spark, "index-residual")
        ivf.write_index(A.encode_residuals(lists(t), centers(t), codec), path)
        return path, codec

    path, codec = kept(t, "residual", make)
    return t.spark.read.parquet(path), codec


@query("ivf_search_pq_residual", f"with {CENT}, {RESIDUAL}, {prb(3)}, {TABLES} select qid, id, round(dist, 6) as dist from rf")
def ivf_search_pq_residual(t):
    """Residual codes by one lookup table per query and list; no vector is decoded."""
    q = qset(t)
    index, codec = residual_codes(t)
    hit = A.search_codes(index, ivf.probe(centers(t), q, 3), q, codec, 10, centers(t))
    return r6(hit.drop("rank"), "dist")


def recall_sql(name: str, form: str) -> str:
    return f"""select '{form}' as form, count(*)::bigint as queries, round(avg(n) / 10, 4) as recall
      from (select qset.qid, count({name}.id) as n from qset left join ex on ex.qid = qset.qid
        left join {name} on {name}.qid = ex.qid and {name}.id = ex.id group by 1)"""


EXACT = f"""ex as (select qid, vec_id as id from {{embeddings}}, qset
    qualify row_number() over (partition by qid order by list_distance({E64}, qv), vec_id) <= 10)"""


@query(
    "ivf_pq_recall",
    f"with {PQ}, {RESIDUAL}, {prb(8)}, {TABLES}, {EXACT}, "
    f"{found('round(list_distance(dv, qv), 9)', 10, 'join pqd on pqd.id = asg.id')}, "
    f"{found('list_distance(v, qv)', 10).replace('fnd as', 'flt as')} "
    + " union all ".join([recall_sql("fnd", "plain"), recall_sql("rf", "residual"), recall_sql("flt", "vectors")]),
)
def ivf_pq_recall(t):
    """Recall at 10 of plain codes, residual codes and whole vectors in the same eight lists."""
    c, q = centers(t), qset(t)
    probes = ivf.probe(c, q, 8)
    exact = S.knn_batch(t.user_vectors, q, 10)
    index, codec = residual_codes(t)
    forms = {
        "plain": A.search_codes(stored(t, "pq"), probes, q, book(t), 10),
        "residual": A.search_codes(index, probes, q, codec, 10, c),
        "vectors": ivf.search(stored(t), probes, q, 10),
    }
    return _recalls(exact, forms, q)


def _recalls(exact, forms, q):
    out = None
    for form, hit in forms.items():
        both = exact.select("qid", "id").join(hit.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("n"))
        per = q.select("qid").join(both, "qid", "left")
        row = per.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("n", F.lit(0))) / 10, 4).alias("recall"))
        row = row.select(F.lit(form).alias("form"), "queries", "recall")
        out = row if out is None else out.unionByName(row)
    return out


REFINED = "select fnd.qid, fnd.id from fnd join asg on asg.id = fnd.id join qset on qset.qid = fnd.qid REST " \
    "qualify row_number() over (partition by fnd.qid order by round(list_distance(VEC, qv), 12), fnd.id) <= 10"


@query(
    "ivf_refine_recall",
    f"with {PQ}, {ASG}, {prb(8)}, {EXACT}, {found('round(list_distance(dv, qv), 9)', 10 * FACTOR, 'join pqd on pqd.id = asg.id')}"
    f"{levels_of(4)}, r0 as ({REFINED.replace('VEC', 'v').replace('REST', '')}), "
    f"r4 as ({REFINED.replace('VEC', 'sv').replace('REST', 'join sqd on sqd.id = fnd.id')}) "
    + recall_sql("r0", "flat") + " union all " + recall_sql("r4", "sq4"),
)
def ivf_refine_recall(t):
    """Recall at 10 after the second stage, on whole vectors and on four-bit codes."""
    q = qset(t)
    exact = S.knn_batch(t.user_vectors, q, 10)
    return _recalls(exact, {"flat": refined(t, "flat"), "sq4": refined(t, "sq4")}, q)


# ---------------------------------------------------------------- inner product

# vectors of five lengths, extended to unit vectors; unit centers from the labels
IP = """sv as (select vec_id as id, label, [x::double * (1 + (vec_id % 5) / 4.0::double) for x in embedding] as v from {embeddings}),
  mx as (select max(sqrt(list_inner_product(v, v))) as m from sv),
  ext as materialized (select id, label, v, list_append([x / m for x in v], sqrt(greatest(1 - list_inner_product(v, v) / (m * m), 0))) as u from sv, mx),
  cm as (select label, pos, avg(x) as c from (select label, generate_subscripts(u, 1) as pos, unnest(u) as x from ext) group by all),
  cn as (select label, sqrt(sum(c * c)) as n from cm group by 1),
  cent as (select cm.label as list_id, list(c / n order by pos) as cv from cm join cn on cn.label = cm.label group by 1),
  asg as materialized (select id, v, list_id from ext, cent qualify row_number() over (partition by id order by list_distance(u, cv), list_id) = 1)"""
IP_FOUND = """(select qid, id, list_inner_product(v, qv) as dist, row_number() over (partition by qid order by list_inner_product(v, qv) desc, id) as rank
    from (select qid, qv, list_id from qset, cent qualify row_number() over
      (partition by qid order by list_inner_product(qv, cv[1:64]) desc, list_id) <= {n}) join asg using (list_id) qualify rank <= 10)"""


def sized_vectors(t):
    """Stand-in input: the vectors at five lengths."""
    times = 1 + F.col("vec_id") % 5 / F.lit(4.0)
    return t.embeddings.select(
        F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") * times).alias("embedding")
    )


def ip_index(t):
    """(index, centers): lists of the extended vectors, stored with the vectors as they are."""

    def make():
        rows = sized_vectors(t)
        most = A.longest(rows)
        means = mean_vector(A.extended(rows, most), "label", "extended").collect()  # one row per label
        mat = np.array([r["center"] for r in sorted(means, key=lambda r: r["label"])])
        unit = mat / np.sqrt((mat * mat).sum(1, keepdims=True))
        path = work_path(t.spark, "index-ip")
        ivf.write_index(A.assign_ip(rows, unit, most), path)
        return path, ivf.centers_frame(t.spark, unit)

    path, c = kept(t, "ip", make)
    return t.spark.read.parquet(path), c


@query("knn_approx_ip", f"with {QSET}, {IP} select qid, id, round(dist, 6) as dist, rank::int as rank from {IP_FOUND.format(n=8)}")
def knn_approx_ip(t):
    """The ten largest inner products in eight probed lists."""
    index, c = ip_index(t)
    q = qset(t)
    return r6(ivf.search(index, A.probe_ip(c, q, 8), q, 10, "inner_product"), "dist")


@query(
    "knn_approx_ip_recall",
    f"""with {QSET}, {IP}, ex as (select qid, id from sv, qset
      qualify row_number() over (partition by qid order by list_inner_product(v, qv) desc, id) <= 10) """
    + " union all ".join(recall_sql(f"f{n}", f"nprobe {n}").replace(f"left join f{n}", f"left join {IP_FOUND.format(n=n)} f{n}") for n in (2, 5, 8, 10)),
)
def knn_approx_ip_recall(t):
    """Recall at 10 against all products, by number of probed lists."""
    index, c = ip_index(t)
    q = qset(t)
    exact = S.knn_batch(sized_vectors(t), q, 10, "inner_product")
    forms = {f"nprobe {n}": ivf.search(index, A.probe_ip(c, q, n), q, 10, "inner_product") for n in (2, 5, 8, 10)}
    return _recalls(exact, forms, q)


# ---------------------------------------------------------------- join and subquery


@query(
    "knn_approx_subquery",
    f"""with {CENT}, {ASG}, {prb(8)}, {found('list_distance(v, qv)', 10,
        "where asg.id in (select doc_id from {documents} where lang = 'en' and n_chars > 500)")} {HITS}""",
)
def knn_approx_subquery(t):
    """Top-k among the ids of a subquery, as bitmap pieces that meet the lists before any distance."""
    allowed = t.documents.where("lang = 'en' and n_chars > 500").select(F.col("doc_id").alias("id"))
    q = qset(t)
    rows = A.only_allowed(stored(t), allowed)
    return r6(ivf.search(rows, ivf.probe(centers(t), q, 8), q, 10), "dist")


@query(
    "knn_approx_join",
    f"""with {CENT}, {ASG}, {prb(8)}, j as (select qid, id as frame_id, v.video_id, video_source, video_type, list_distance(asg.v, qv) as dist
      from prb join asg using (list_id) join {{video_frame_vectors}} v on v.frame_id = asg.id join {{video_meta}} m on m.video_id = v.video_id)
    select qid, frame_id, round(dist, 6) as dist, row_number() over (partition by qid order by dist, frame_id)::int as rank,
      video_id, video_source, video_type from j qualify rank <= 10""",
)
def knn_approx_join(t):
    """Top-k of vectors joined with their metadata; vectors without any are dropped before the search."""

    def make():
        path = work_path(t.spark, "index-video")
        ivf.write_index(ivf.assign(t.video_frame_vectors, centers(t), "frame_id"), path, "frame_id")
        return path

    index = t.spark.read.parquet(kept(t, "video", make))
    return r6(A.knn_join(index, centers(t), qset(t), t.video_meta, "video_id", 10, 8, id_col="frame_id"), "dist")
