"""Registered queries: search quality and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.operators import search as S
from tessera.plans.registry import query
from tessera.plans.vectors import QSET, qset

# exact lists, and lists found on vectors cut to a coarse grid
LISTS = QSET + """, pairs as (select qid, vec_id as id, list_distance(embedding::double[], qv) as dist,
    list_distance([floor(x::double * 8) / 8 for x in embedding], qv) as rough from {embeddings}, qset),
  ranked as (select qid, id, dist, rough,
      row_number() over (partition by qid order by dist, id) as tr,
      row_number() over (partition by qid order by rough, id) as fr from pairs)"""


def lists(t, k):
    q = qset(t)
    grid = F.transform("embedding", lambda x: F.floor(x.cast("double") * 8) / 8.0)
    rough = t.user_vectors.withColumn("embedding", grid)
    return S.knn_batch(t.user_vectors, q, k), S.knn_batch(rough, q, k)


@query(
    "recall_at_k",
    "with " + LISTS + """ select qid, round(count(*) filter (where fr <= 10) / 10.0::double, 6) as recall
    from ranked where tr <= 10 group by qid""",
)
def recall_at_k(t):
    return Q.recall_at_k(*lists(t, 10)).withColumn("recall", F.round("recall", 6))


@query(
    "recall_prefix",
    "with " + LISTS + """, p as (select k, qid, count(*) filter (where fr <= k) / max(k)::double as r
      from ranked, (values (1), (10), (50), (100)) v(k) where tr <= k group by all)
    select k, round(avg(r), 6) as recall from p group by k""",
)
def recall_prefix(t):
    out = Q.recall_prefix(*lists(t, 100), (1, 10, 50, 100))
    return out.withColumn("recall", F.round("recall", 6))


@query(
    "recall_1nn_at_k",
    "with " + LISTS + """ select k, round(count(*) filter (where fr <= k) / count(*)::double, 6) as recall
    from ranked, (values (1), (5), (10)) v(k) where tr = 1 group by k""",
)
def recall_1nn_at_k(t):
    return Q.recall_1nn_at_k(*lists(t, 10), (1, 5, 10)).withColumn("recall", F.round("recall", 6))


def _match(column):
    name = f"{column}_dist"

    @query(
        name,
        "with " + LISTS + f""" select qid, round(count(*) filter
          (where tr <= 20 and fr <= 20 and abs(dist - rough) <= 0.05) / 20.0::double, 6) as {name}
        from ranked group by qid""",
    )
    def run(t):
        out = Q.match_by_distance(qset(t), *lists(t, 20), tol=0.05)
        return out.select("qid", F.round(column, 6).alias(name))


for _c in ("precision", "recall", "overlap"):
    _match(_c)


@query(
    "recall_summary",
    "with " + LISTS + """, p as (select qid, count(*) filter (where fr <= 10) / 10.0::double as r
      from ranked where tr <= 10 group by qid)
    select round(avg(r), 4) as avg_recall, round(min(r), 4) as min_recall,
      round(max(r), 4) as max_recall, round(stddev_pop(r), 4) as std_recall,
      round(quantile_cont(r, 0.1), 4) as p10_recall, round(quantile_cont(r, 0.9), 4) as p90_recall
    from p""",
)
def recall_summary(t):
    return Q.recall_summary(Q.recall_at_k(*lists(t, 10)))


@query(
    "latency_stats",
    """select scale, concurrency, round(avg(latency_ms), 4) as avg_ms,
      round(quantile_cont(latency_ms, 0.5), 4) as p50_ms,
      round(quantile_cont(latency_ms, 0.9), 4) as p90_ms,
      round(quantile_cont(latency_ms, 0.99), 4) as p99_ms, round(min(latency_ms), 4) as min_ms,
      round(max(latency_ms), 4) as max_ms, round(stddev_pop(latency_ms), 4) as std_ms
    from {search_log} group by all""",
)
def latency_stats(t):
    return Q.latency_stats(t.search_log, ["scale", "concurrency"], digits=4)


@query(
    "throughput_stats",
    """with w as (select scale, concurrency, count(*) as total_queries,
        (max(epoch_us(ts) + latency_ms * 1000) - min(epoch_us(ts))) / 1e6::double as wall,
        avg(latency_ms) as a, quantile_cont(latency_ms, 0.5) as p50,
        quantile_cont(latency_ms, 0.9) as p90, quantile_cont(latency_ms, 0.99) as p99
      from {search_log} group by all)
    select scale, concurrency, total_queries, round(wall, 4) as wall_s, round(a, 4) as avg_ms,
      round(total_queries / wall, 4) as qps, round(p50, 4) as p50_ms, round(p90, 4) as p90_ms,
      round(p99, 4) as p99_ms from w""",
)
def throughput_stats(t):
    return Q.throughput_stats(t.search_log, ["scale", "concurrency"], digits=4)


@query(
    "success_stats",
    """select query_type, count(*) as n, round(100.0::double * sum(ok) / count(*), 6) as success_rate,
      round(coalesce(avg(latency_ms) filter (where ok = 1), 0), 6) as avg_ms,
      coalesce(min(latency_ms) filter (where ok = 1), 0) as min_ms,
      coalesce(max(latency_ms) filter (where ok = 1), 0) as max_ms,
      round(coalesce(avg(n_results) filter (where ok = 1), 0), 6) as avg_results
    from {search_log} group by query_type""",
)
def success_stats(t):
    out = Q.success_stats(t.search_log)
    return out.select(
        "query_type", "n", F.round("success_rate", 6).alias("success_rate"),
        F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms",
        F.round("avg_results", 6).alias("avg_results"),
    )


TIMINGS = """select concat('q', cast(scale * 5 + concurrency + 1 as string)) as query,
    avg(case when ok = 1 and concurrency <> 3 then latency_ms end) as avg_time,
    min(case when ok = 1 and concurrency <> 3 then latency_ms end) as min_time, max(latency_ms) as max_time
  from {search_log} group by 1"""


@query(
    "bench_table_avg",
    f"""with q as ({TIMINGS}) select query, round(avg_time, 6) as avg_time,
      round(min_time, 6) as min_time, round(max_time, 6) as max_time from (
      select * from q union all select 'Average', avg(avg_time), avg(min_time), avg(max_time) from q)""",
)
def bench_table_avg(t):
    cols = ["avg_time", "min_time", "max_time"]
    out = Q.with_average_row(t.sql(TIMINGS), "query", cols)
    return out.select("query", *[F.round(c, 6).alias(c) for c in cols])


CONFIGS = """select concat('s', cast(scale as string), 'c', cast(concurrency as string)) as config,
    round(avg(ok), 6) as recall, round(avg(latency_ms), 6) as search_ms,
    cast(count(*) as double) as compression
  from {search_log} group by scale, concurrency"""


@query(
    "best_config",
    f"""with c as ({CONFIGS})
    select * from (select 'recall' as goal, config, recall as value from c order by recall desc, config limit 1)
    union all select * from (select 'fastest', config, search_ms from c order by search_ms, config limit 1)
    union all select * from (select 'compression', config, compression from c
      order by compression desc, config limit 1)""",
)
def best_config(t):
    goals = {"recall": ("recall", True), "fastest": ("search_ms", False), "compression": ("compression", True)}
    return Q.best_config(t.sql(CONFIGS), "config", goals)


KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "result_pivot",
    "select scale, " + ", ".join(
        f"round(avg(latency_ms) filter (where query_type = '{k}'), 6) as {k}" for k in KINDS
    ) + " from {search_log} group by scale",
)
def result_pivot(t):
    out = Q.result_pivot(t.search_log, "scale", "query_type", KINDS, "latency_ms")
    return out.select("scale", *[F.round(k, 6).alias(k) for k in KINDS])


@query(
    "code_size",
    """with s as (select len(embedding)::int as dim, count(*) as n from {embeddings} group by 1),
      m as (select * from (values ('Flat', 4.0::double, 0.0::double), ('SQ8', 1, 0), ('SQ4', 0.5, 0), ('FP16', 2, 0),
        ('PQ8x8', 0, 8), ('PQ16x4', 0, 8)) v(method, per_dim, fixed))
    select dim, n, method, dim * per_dim + fixed as bytes, dim * 4 / (dim * per_dim + fixed) as ratio
    from s, m""",
)
def code_size(t):
    """PQ with 7 sub-vectors does not divide 64 and is left out."""
    return Q.code_size(t.embeddings, [(8, 8), (16, 4), (7, 8)])
