"""Registered queries: distances and exact vector search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import scale
from tessera.functions import distance as D
from tessera.functions.scalars import vector_text
from tessera.functions.vectorstats import mean_vector
from tessera.operators import hybrid
from tessera.operators import search as S
from tessera.plans.registry import kept, query
from tessera.session import work_path
from tessera.sources import tables

# the query vector of single-query runs is row 0 of the table
Q0 = "(select embedding::double[] from {embeddings} where vec_id = 0)"
E64 = "embedding::double[]"
# the query set of searches for many queries: every row whose id is divisible by 20
QSET = "qset as (select vec_id as qid, embedding::double[] as qv from {embeddings} where vec_id % 20 = 0)"
# twenty seeded query vectors, as operators.search.sample_queries picks them
SAMPLE = """qset as (select vec_id as qid, embedding::double[] as qv from {embeddings}
  order by md5(concat('42:', cast(vec_id as string))), vec_id limit 20)"""


def q0(t) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").head()["embedding"]]


def qset(t):
    """Every row whose id is divisible by 20; a small set is read once and kept as a local table."""
    if "_qset" not in vars(t):
        rows = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
        t._qset = scale.local_table(rows) if scale.is_small(rows) else rows
    return t._qset


def r6(c):
    return F.round(c, 6)


def _distance(name: str, col, sql: str):
    @query(name, f"select vec_id, round({sql}, 6) + 0.0 as dist from {{embeddings}}")
    def run(t):
        q = D.constant(q0(t))
        return t.embeddings.select("vec_id", (r6(col("embedding", q)) + 0.0).alias("dist"))


_distance("vec_l2", D.l2, f"list_distance({E64}, {Q0})")
_distance("vec_l2_sq", D.l2_sq, f"pow(list_distance({E64}, {Q0}), 2)")
_distance("vec_ip", D.inner_product, f"list_inner_product({E64}, {Q0})")
_distance("vec_cosine_sim", D.cosine_similarity, f"list_cosine_similarity({E64}, {Q0})")
_distance("vec_cosine_dist", D.cosine_distance, f"1 - list_cosine_similarity({E64}, {Q0})")


@query(
    "vec_neg_ip",
    f"""select vec_id, round(-list_inner_product({E64}, {Q0}), 6) + 0.0 as neg_ip,
      round(1 - list_inner_product({E64}, {Q0}), 6) + 0.0 as ip_dist from {{embeddings}}""",
)
def vec_neg_ip(t):
    q = D.constant(q0(t))
    return t.embeddings.select(
        "vec_id",
        (r6(D.neg_inner_product("embedding", q)) + 0.0).alias("neg_ip"),
        (r6(D.ip_distance("embedding", q)) + 0.0).alias("ip_dist"),
    )


@query(
    "vec_normalize",
    """with z as (select vec_id, case when vec_id % 50 = 0 then [0.0::double for x in embedding]
        else [x::double * 3 for x in embedding] end as v from {embeddings}),
      n as (select vec_id, v, sqrt(list_inner_product(v, v)) as len from z)
    select vec_id, generate_subscripts(v, 1) - 1 as pos,
      round(unnest([case when len > 0 then x / len else x end for x in v]), 6) + 0.0 as x from n""",
)
def vec_normalize(t):
    """Unit vectors; every fiftieth input is a zero vector, which must stay zero."""
    stretched = t.embeddings.withColumn(
        "v",
        F.transform(
            "embedding",
            lambda x: F.when(F.col("vec_id") % 50 == 0, F.lit(0.0)).otherwise(x.cast("double") * 3),
        ),
    )
    flat = stretched.select("vec_id", F.posexplode(D.normalize("v")).alias("pos", "x"))
    return flat.select("vec_id", F.col("pos").cast("long").alias("pos"), (r6("x") + 0.0).alias("x"))


@query(
    "vec_norm_identity",
    f"select vec_id, round(pow(list_distance({E64}, {Q0}), 2), 6) as d2 from {{embeddings}}",
)
def vec_norm_identity(t):
    """Squared L2 through norms about the mean vector; must equal the direct value."""
    center = mean_vector(t.embeddings).head()["center"]
    d2 = D.l2_sq_by_norms("embedding", D.constant(q0(t)), D.constant(center))
    return t.embeddings.select("vec_id", F.abs(r6(d2)).alias("d2"))


def _ranked(df, k_label=None):
    cols = [F.col("id"), r6("dist").alias("dist")]
    return df.select(*cols if k_label is None else [F.lit(k_label).alias("k"), *cols])


@query(
    "knn_topk",
    "with d as (select vec_id as id, list_distance(embedding::double[], " + Q0 + ") as dist "
    "from {embeddings}), r as (select *, row_number() over (order by dist, id) as rn from d) "
    "select k, id, round(dist, 6) as dist from r join (values (1), (10), (100), (5000)) v(k) on rn <= k",
)
def knn_topk(t):
    """Global exact top-k for k = 1, 10, 100, 5000: one search for the largest, cut for the others."""
    best = S.knn(t.user_vectors, kept(t, "q0", lambda: q0(t)), 5000)
    rank = F.row_number().over(Window.orderBy("dist", "id"))  # at most 5000 rows
    cut = best.withColumn("rn", rank).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 10, 100, 5000)])))
    return cut.where("rn <= k").select("k", "id", r6("dist").alias("dist"))


@query(
    "knn_tenant",
    f"""select id, round(list_distance({E64}, {Q0}), 6) as dist from {{user_vectors}}
    where user_id = 3 order by list_distance({E64}, {Q0}), id limit 10""",
)
def knn_tenant(t):
    """One tenant of a table laid out by tenant: one bucket is read."""
    q = kept(t, "q0", lambda: q0(t))
    return _ranked(S.knn(tenant_layout(t), q, 10, where=F.col("user_id") == 3))


def tenant_layout(t):
    """The vectors bucketed and sorted by tenant, written once per state of the table's files."""

    def make() -> str:
        path = work_path(t.spark, "tenants")
        name = "tenants_" + path.rsplit("-", 1)[1]
        tables.save_bucketed(t.user_vectors, name, 16, ["user_id"], ["user_id", "id"], path)
        return name

    return t.spark.table(kept(t, "tenants", make))


@query(
    "knn_prefilter",
    f"""select * from (select 'equal' as form, video_id, frame_id,
        round(list_distance({E64}, {Q0}), 6) as dist from {{video_frame_vectors}}
        where video_id = 'video_1' order by list_distance({E64}, {Q0}), frame_id limit 10)
      union all select * from (select 'in' as form, video_id, frame_id,
        round(list_distance({E64}, {Q0}), 6) as dist from {{video_frame_vectors}}
        where video_id in ('video_1', 'video_2', 'video_3')
        order by list_distance({E64}, {Q0}), frame_id limit 10)""",
)
def knn_prefilter(t):
    q, out = q0(t), []
    for form, cond in (
        ("equal", F.col("video_id") == "video_1"),
        ("in", F.col("video_id").isin("video_1", "video_2", "video_3")),
    ):
        hit = S.knn(t.video_frame_vectors, q, 10, id_col="frame_id", where=cond, keep=["video_id"])
        out.append(hit.select(F.lit(form).alias("form"), "video_id", "frame_id",
                              r6("dist").alias("dist")))
    return out[0].union(out[1])


@query(
    "knn_batch",
    "with " + QSET + """, d as (select qid, vec_id as id,
        list_distance(embedding::double[], qv) as dist from {embeddings}, qset),
      r as (select *, row_number() over (partition by qid order by dist, id) as rank from d)
    select qid, id, round(dist, 6) as dist, rank::int as rank from r where rank <= 10""",
)
def knn_batch(t):
    return S.knn_batch(t.user_vectors, qset(t), 10).withColumn("dist", r6("dist"))


@query(
    "knn_by_metric",
    "with " + QSET + """, d as (select qid, vec_id as id,
        list_distance(embedding::double[], qv) as l2,
        list_inner_product(embedding::double[], qv) as ip,
        list_cosine_similarity(embedding::double[], qv) as cs from {embeddings}, qset),
      m as (select 'l2' as metric, qid, id, l2 as dist, l2 as key from d
        union all select 'inner_product', qid, id, ip, -ip from d
        union all select 'cosine_similarity', qid, id, cs, -cs from d
        union all select 'cosine_distance', qid, id, 1 - cs, 1 - cs from d),
      r as (select *, row_number() over (partition by metric, qid order by round(key, 9), id) rn from m)
    select metric, qid, id, round(dist, 6) + 0.0 as dist from r where rn <= 5""",
)
def knn_by_metric(t):
    """The same search under four metrics, each in its own direction, in one scan."""
    names = ("l2", "inner_product", "cosine_similarity", "cosine_distance")
    hit = S.knn_batch_metrics(t.user_vectors, qset(t), 5, names)
    return hit.select("metric", "qid", "id", (r6("dist") + 0.0).alias("dist"))


@query(
    "range_search",
    f"""select vec_id as id, round(list_distance({E64}, {Q0}), 6) as dist from {{embeddings}}
    where list_distance({E64}, {Q0}) < 1.3""",
)
def range_search(t):
    return _ranked(S.range_search(t.user_vectors, q0(t), 1.3))


@query(
    "range_search_outside",
    f"""select vec_id as id, round(list_distance({E64}, {Q0}), 6) as dist from {{embeddings}}
    where list_distance({E64}, {Q0}) >= 1.3""",
)
def range_search_outside(t):
    return _ranked(S.range_search_outside(t.user_vectors, q0(t), 1.3))


@query(
    "compound_search",
    f"""select vec_id as id, round(list_distance({E64}, {Q0}), 6) as dist from {{embeddings}}
    where list_distance({E64}, {Q0}) < 1.4 order by list_distance({E64}, {Q0}), vec_id limit 20""",
)
def compound_search(t):
    return _ranked(S.compound_search(t.user_vectors, q0(t), 1.4, 20))


@query(
    "radius_at_percentile",
    f"""with d as (select quantile_cont(list_distance({E64}, {Q0}), [0.01, 0.05, 0.1, 0.5, 0.9]) as r
      from {{embeddings}})
    select unnest([1.0::double, 5, 10, 50, 90]) as percent,
      unnest([round(x, 6) for x in r]) as radius from d""",
)
def radius_at_percentile(t):
    out = S.radius_at_percentile(t.user_vectors, q0(t), (1, 5, 10, 50, 90))
    return out.select("percent", r6("radius").alias("radius"))


@query(
    "knn_param_query",
    f"""select id, user_id, round(list_distance({E64}, {Q0}), 6) as dist from {{user_vectors}}
    order by list_distance({E64}, {Q0}), id limit 10""",
)
def knn_param_query(t):
    t.user_vectors.createOrReplaceTempView("knn_param_vectors")
    text = "[" + ",".join(repr(x) for x in q0(t)) + "]"
    hit = S.knn_param_query(t.spark, "knn_param_vectors", text, 10, extra=["user_id"])
    return hit.withColumn("dist", r6("dist"))


@query(
    "join_vec_meta",
    f"""select v.video_id, frame_id, round(list_distance({E64}, {Q0}), 6) as dist, video_source,
      video_type from {{video_frame_vectors}} v join {{video_meta}} m on v.video_id = m.video_id
    order by list_distance({E64}, {Q0}), frame_id limit 10""",
)
def join_vec_meta(t):
    """Top-k over the joined rows: the join comes first because it can drop candidates."""
    joined = t.video_frame_vectors.join(t.video_meta, "video_id")
    hit = S.knn(joined, q0(t), 10, id_col="frame_id",
                keep=["video_id", "video_source", "video_type"])
    return hit.withColumn("dist", r6("dist"))


@query(
    "sub_topk_filter",
    f"""select * from (select video_id, frame_id, round(list_distance({E64}, {Q0}), 6) as dist
      from {{video_frame_vectors}} order by list_distance({E64}, {Q0}), frame_id limit 20)
    where dist < 1.2""",
)
def sub_topk_filter(t):
    """Filter after the limit: can return fewer rows than the limit."""
    hit = S.knn(t.video_frame_vectors, q0(t), 20, id_col="frame_id", keep=["video_id"])
    return hit.withColumn("dist", r6("dist")).where("dist < 1.2")


@query(
    "flt_user_set",
    """with n as (select 1 as n_users, unnest([3]) as user_id union all
        select 5, unnest(TENANTS5) union all select 10, unnest([0,1,2,3,4,5,6,7,8,9]))
    select n_users, user_id, count(*) as rows, sum(id)::bigint as ids
    from {user_vectors} join n using (user_id) group by all""".replace(
        "TENANTS5", str(S.tenant_set(10, 5, 3))
    ),
)
def flt_user_set(t):
    """Rows kept by tenant sets of 1, 5 and 10 tenants."""
    out = []
    for n in (1, 5, 10):
        kept = S.tenant_filter(t.user_vectors, S.tenant_set(10, n, 3))
        out.append(
            kept.groupBy(F.lit(n).alias("n_users"), "user_id")
            .agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))
        )
    return reduce(lambda a, b: a.union(b), out)


@query("sample_queries", "with " + SAMPLE + """
    select qid, len(qv)::int as dim, round(list_sum(qv), 6) as total from qset""")
def sample_queries(t):
    """Falls back past an empty first source."""
    empty = t.user_vectors.where(F.lit(False))
    q = S.sample_queries([empty, t.user_vectors], 20)
    total = F.aggregate("qvec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return q.select("qid", F.size("qvec").alias("dim"), r6(total).alias("total"))


@query(
    "rank_within_query",
    "with " + QSET + """, d as (select qid, vec_id as id,
        list_inner_product(embedding::double[], qv) as ip from {embeddings}, qset),
      r as (select qid, id, row_number() over (partition by qid order by ip desc, id)::int as rank from d)
    select * from r where rank <= 50""",
)
def rank_within_query(t):
    """1-based rank of every hit within its query, higher score first."""
    hits = S.knn_batch(t.user_vectors, qset(t), 50, "inner_product").drop("rank")
    return hybrid.rank_hits(hits, "qid", "dist", "id", ascending=False).select("qid", "id", "rank")


@query(
    "set_intersect_ids",
    "with " + QSET + """, d as (select qid, vec_id as id,
        list_distance(embedding::double[], qv) as l2,
        list_inner_product(embedding::double[], qv) as ip from {embeddings}, qset),
      a as (select *, row_number() over (partition by qid order by l2, id) as r1,
        row_number() over (partition by qid order by ip desc, id) as r2 from d)
    select qid, id from a where r1 <= 50 and r2 <= 60""",
)
def set_intersect_ids(t):
    """Ids that are in two result lists of the same query."""
    v, q = t.user_vectors, qset(t)
    near = S.knn_batch(v, q, 50).select("qid", "id")
    by_ip = S.knn_batch(v, q, 60, "inner_product").select("qid", "id")
    return near.join(by_ip, ["qid", "id"])


@query(
    "set_except_ids",
    f"select vec_id as id from {{embeddings}} where not list_distance({E64}, {Q0}) < 1.35",
)
def set_except_ids(t):
    inside = S.range_search(t.user_vectors, q0(t), 1.35).select("id")
    return t.user_vectors.select("id").join(inside, "id", "left_anti")


@query(
    "fn_vec_to_text",
    "select vec_id, '[' || array_to_string([printf('%.6f', x::double) for x in embedding], ',') "
    "|| ']' as txt from {embeddings}",
)
def fn_vec_to_text(t):
    return t.embeddings.select("vec_id", vector_text("embedding").alias("txt"))


@query(
    "fn_cast_array",
    """select 'bracketed' as form, count(*) as n, count(*) as n_ok, sum(len(embedding))::bigint as dims
      from {embeddings}
    union all select 'bare', count(*), count(*), sum(len(embedding))::bigint from {embeddings}
    union all select 'invalid', count(*), 0, 0 from {events}""",
)
def fn_cast_array(t):
    """Vector text in both spellings, and text that is no vector (must give NULL)."""
    text = t.embeddings.select(vector_text("embedding").alias("s"))
    forms = (
        text.select(F.lit("bracketed").alias("form"), "s")
        .union(text.select(F.lit("bare"), F.expr("substring(s, 2, length(s) - 2)")))
        .union(t.events.select(F.lit("invalid"), F.col("props")))
    )
    v = forms.withColumn("v", D.parse_vector("s"))
    return v.groupBy("form").agg(
        F.count("*").alias("n"),
        F.count("v").alias("n_ok"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.size("v"))), F.lit(0)).alias("dims"),
    )


@query(
    "fn_array_repeat",
    """select video_id, frame_id, round(list_distance(embedding::double[],
      [0.01::float::double for x in embedding]), 6) as score
    from {video_frame_vectors}""",
)
def fn_array_repeat(t):
    """Distance of every frame to a constant vector."""
    q = F.array_repeat(F.lit(0.01).cast("float"), 64)
    return t.video_frame_vectors.select(
        "video_id", "frame_id", r6(D.l2("embedding", q)).alias("score")
    )
