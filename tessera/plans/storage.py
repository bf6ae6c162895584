"""Registered queries: sources, sinks, loads and generators, each run on the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational as R
from tessera.operators import search as S
from tessera.functions.vectorstats import mean_vector
from tessera.plans.registry import query
from tessera.session import work_path
from tessera.sources import generate, loads, results, tables, vector_text, xvecs
from tessera.streaming.stream_load import stream_load

SUM = "round(list_sum(embedding::double[]), 4) + 0.0"


def total(col, digits: int = 4):
    s = F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.round(s, digits) + 0.0


def stats(col: str, digits: int = 4):
    return [F.size(col).alias("dim"), total(col, digits).alias("total")]


# ---------------------------------------------------------------- vector files


@query(
    "src_tsv_vectors",
    "select user_id, id::int as id, len(embedding)::int as dim, round(list_sum([printf('%.6f', x::double)::float::double "
    "for x in embedding]), 6) + 0.0 as total from {user_vectors}",
)
def src_tsv_vectors(t):
    """Good lines come back, short and malformed ones are skipped."""
    path = work_path(t.spark, "tsv")
    good = t.user_vectors.select(
        F.concat_ws("\t", "user_id", "id", F.expr("'['")).alias("a"), "embedding"
    )
    line = F.concat(
        F.col("a"),
        F.array_join(F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double"))), ","),
        F.lit("]"),
    )
    bad = t.events.select(F.concat_ws("\t", "user_id", "event_id", "props").alias("value")).union(
        t.events.select(F.concat_ws("\t", "user_id", "event_id"))
    )
    good.select(line.alias("value")).union(bad).write.option("compression", "gzip").text(path)
    return vector_text.read_vector_tsv(t.spark, path).select("user_id", "id", *stats("embedding", 6))


@query(
    "sink_tsv_shards",
    "select user_id, id, generate_subscripts(embedding, 1) - 1 as pos, round(unnest(embedding)::double, 6) + 0.0 as x from {user_vectors}",
)
def sink_tsv_shards(t):
    """Every number of every vector, read back from the text files."""
    path = work_path(t.spark, "shards")
    vector_text.write_vector_tsv(t.user_vectors.select("user_id", "id", "embedding"), path, 100)
    back = vector_text.read_vector_tsv(t.spark, path, "user_id int, id bigint")
    flat = back.select("user_id", "id", F.posexplode("embedding").alias("pos", "x"))
    return flat.select("user_id", "id", F.col("pos").cast("long").alias("pos"), (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


@query("src_parquet_cols", f"select len(embedding)::int as dim, {SUM} as total from {{embeddings}}")
def src_parquet_cols(t):
    path = f"{t.sf_dir}/embeddings.parquet"
    return vector_text.read_vector_column(t.spark, path, "embedding").select(*stats("embedding"))


@query(
    "src_parquet_merge",
    f"select len(embedding)::int as dim, {SUM} as total from (from {{embeddings}} union all from {{embeddings}})",
)
def src_parquet_merge(t):
    """Two shards with different column names become one column."""
    first, second = f"{t.sf_dir}/embeddings.parquet", work_path(t.spark, "shard")
    t.embeddings.select(F.col("embedding").alias("emb_2"), "label").write.parquet(second)
    names = {first: "embedding", second: "emb_2"}
    return vector_text.merge_shards(t.spark, [first, second], names).select(*stats("emb"))


@query("src_fvecs", f"select vec_id as row, len(embedding)::int as dim, {SUM} as total from {{embeddings}}")
def src_fvecs(t):
    """Read in small record ranges, so several tasks share one file."""
    path = work_path(t.spark, "fvecs")
    xvecs.write_xvecs(t.embeddings, path, "fvecs", "vec_id")
    return xvecs.read_xvecs(t.spark, path, "fvecs", 16 * 1024).select("row", *stats("vec"))


@query(
    "sink_fvecs",
    "select vec_id as row, vec_id::int as a, label as b from {embeddings}",
)
def sink_fvecs(t):
    """Integer records written and read back in order."""
    path = work_path(t.spark, "ivecs")
    pairs = t.embeddings.select("vec_id", F.array(F.col("vec_id").cast("int"), "label").alias("embedding"))
    xvecs.write_xvecs(pairs, path, "ivecs", "vec_id")
    back = xvecs.read_xvecs(t.spark, path, "ivecs")
    return back.select("row", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))


@query(
    "src_query_vectors",
    """with q as (select label as qid, embedding::double[] as qv from (select *, row_number() over
        (partition by label order by vec_id) as rn from {embeddings}) where rn = 1),
      d as (select qid, vec_id, row_number() over (partition by qid
        order by list_distance(embedding::double[], qv), vec_id) as rank from {embeddings}, q)
    select qid::bigint as qid, rank - 1 as pos, vec_id::int as id from d where rank <= 5""",
)
def src_query_vectors(t):
    """The first vector of each label as query file, its exact neighbours as truth file."""
    first = t.embeddings.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("qvec"))
    near = S.knn_batch(t.user_vectors, first, 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"])
    truth = near.groupBy("qid").agg(ids.alias("ids"))  # five ids per query
    qp, tp = work_path(t.spark, "queries"), work_path(t.spark, "truth")
    xvecs.write_xvecs(first, qp, "fvecs", "qid", "qvec")
    xvecs.write_xvecs(truth, tp, "ivecs", "qid", "ids")
    both = xvecs.read_query_set(t.spark, qp, tp)
    return both.select("qid", F.posexplode("truth").alias("pos", "id")).select(
        "qid", F.col("pos").cast("long").alias("pos"), "id"
    )


# ---------------------------------------------------------------- loads


@query(
    "stream_load",
    "select user_id, count(*) as n, round(sum(value), 2) as total from {events} group by 1",
)
def stream_load_events(t):
    """The events arrive as files; later runs of the same label add nothing, with or without the checkpoint."""
    src, out, check, lost = (work_path(t.spark, n) for n in ("in", "table", "check", "check"))
    t.events.select("event_id", "user_id", F.col("value").alias("v")).repartition(4).write.parquet(src)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, v double")
    mapped = {"event_id": "event_id", "user_id": "user_id", "value": F.col("v")}
    for kept in (check, check, lost):
        table = stream_load(t.spark, src, schema, out, kept, "events", mapped, files_per_batch=3)
    return table.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


PARTIAL = "not (event_id % 7 = 0 and event_id // 500 % 2 = 1) and event_id // 500 % 5 <> 3"


@query(
    "chunked_resume_load",
    f"""select event_id // 500 as chunk, count(*) as src_rows, count(*) filter (where {PARTIAL}) as dst_rows,
      count(*) = count(*) filter (where {PARTIAL}) as complete, count(*) as final_rows
    from {{events}} group by 1""",
)
def chunked_resume_load(t):
    """A target with whole, partial and missing chunks is completed."""
    dst = t.events.where(PARTIAL.replace("//", "div"))
    status = loads.chunk_status(t.events, dst, 500, "event_id")
    done = loads.load_missing_chunks(t.events, dst, 500, "event_id")
    final = done.groupBy(F.expr("event_id div 500").alias("chunk")).agg(F.count("*").alias("final_rows"))
    return status.join(final, "chunk")


@query(
    "load_gate",
    """select 'orders' as name, (select count(distinct o_orderkey) from {orders}) as expected,
      (select count(*) from {orders}) as actual, true as skip
    union all select 'lineitem', (select count(distinct l_orderkey) from {lineitem}),
      (select count(*) from {lineitem}), false""",
)
def load_gate(t):
    named = lambda df, n, c: df.agg(c).select(F.lit(n).alias("name"), "*")
    want = named(t.orders, "orders", F.count_distinct("o_orderkey").alias("expected")).union(
        named(t.lineitem, "lineitem", F.count_distinct("l_orderkey")))
    have = named(t.orders, "orders", F.count("*").alias("actual")).union(
        named(t.lineitem, "lineitem", F.count("*")))
    return loads.load_gate(want, have)


# ---------------------------------------------------------------- tables


@query(
    "tbl_bucketed",
    "select user_id, id, category, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as x from {user_vectors}",
)
def tbl_bucketed(t):
    """Every number of every vector, read back from a bucketed table."""
    path = work_path(t.spark, "bucketed")
    name = "vectors_" + path.rsplit("-", 1)[1]
    table = tables.save_bucketed(t.user_vectors, name, 8, ["user_id"], ["user_id", "id"], path)
    flat = table.select("user_id", "id", "category", F.posexplode("embedding").alias("pos", "x"))
    return flat.withColumn("pos", F.col("pos").cast("long"))


@query(
    "tbl_unique_key",
    """select user_id, event_id, event_type, value from (select *, row_number() over
      (partition by user_id order by ts desc, event_id desc) as rn from {events}) where rn = 1""",
)
def tbl_unique_key(t):
    last = tables.latest_per_key(t.events, "user_id", ["ts", "event_id"])
    return last.select("user_id", "event_id", "event_type", "value")


@query(
    "tbl_agg_bitmap",
    """select event_type, (user_id * 700 - 1) // 32768 + 1 as bucket, count(distinct user_id) as bits
    from {events} where user_id > 0 group by all""",
)
def tbl_agg_bitmap(t):
    """Daily bitmaps merged per key, as rows of an aggregating table would be."""
    src = t.events.where("user_id > 0").select(
        F.concat_ws("|", "event_type", F.col("ts").cast("date")).alias("k"), (F.col("user_id") * 700).alias("v")
    )
    daily = R.bitmap_table(src, "k", "v").withColumn("event_type", F.split_part("k", F.lit("|"), F.lit(1)))
    merged = R.bitmap_merge(daily, "event_type")
    return merged.select("event_type", "bucket", F.bitmap_count("bm").alias("bits"))


@query(
    "insert_select_multi",
    f"select vec_id::int as id, {SUM} as a, {SUM} as b, {SUM} as c from {{embeddings}}",
)
def insert_select_multi(t):
    wide = tables.repeat_vector(t.embeddings, "vec_id", "embedding", ["e16", "e32", "e64"])
    return wide.select("id", total("e16").alias("a"), total("e32").alias("b"), total("e64").alias("c"))


RESULTS = """select query_type, cast(count(*) as bigint) as n, avg(case when ok = 1 then latency_ms end) as mean_ms,
    max(latency_ms) as max_ms from {search_log} group by query_type"""
FIELDS = ["query_type", "n", "mean_ms", "max_ms", "error"]


@query(
    "sink_results",
    f"""select query_type, n::string as n, coalesce(printf('%.6f', mean_ms), '') as mean_ms,
      printf('%.6f', max_ms) as max_ms, '' as error from ({RESULTS})""",
)
def sink_results(t):
    """Result rows appended in two runs, blanks for NULL and for a field no row has."""
    path, rows = work_path(t.spark, "results"), t.sql(RESULTS)
    results.append_results(rows.where("query_type < 'f'"), path, FIELDS)
    results.append_results(rows.where("query_type >= 'f'"), path, FIELDS)
    return results.read_results(t.spark, path, FIELDS)


SUMMARY = {
    "scale": "select scale, count(*) as n, max(latency_ms) as max_ms from {search_log} group by scale",
    "concscale": "select scale, concurrency, count(*) as n, cast(10 as bigint) as top from {search_log} group by scale, concurrency",
    "distfn": "select query_type, cast(sum(ok) as bigint) as ok, case when max(ok) = 1 then max(latency_ms) end as max_ms from {search_log} group by query_type",
    "cache_raw": "select event_id, latency_ms from {search_log}",
}


@query(
    "sink_summary",
    " union all by name ".join(f"select '{name}' as scenario, * from ({sql})" for name, sql in SUMMARY.items() if name != "cache_raw"),
)
def sink_summary(t):
    """The combined JSON summary of scenarios with different fields, written twice and read back."""
    path = work_path(t.spark, "summary")
    for _ in range(2):
        results.write_summary({name: t.sql(sql) for name, sql in SUMMARY.items()}, path)
    back = results.read_summary(t.spark, path)
    whole = {c: F.col(c).cast("bigint") for c in ("scale", "concurrency", "n", "top", "ok")}
    return back.withColumns(whole)


SCENARIOS = """case event_type when 'click' then 'scale' when 'view' then 'concscale' when 'error' then 'distfn'
    when 'signup' then 'cache_raw' else 'topk' end"""


@query(
    "repair_result_schema",
    f"""select event_id, {SCENARIOS} as scenario,
      case when event_type in ('error', 'signup') then case when event_id % 2 = 1 then 'old_fn' end
        else 'l2_distance' end as dist_fn,
      case when event_type not in ('error', 'signup') then 'bruteforce' end as search_mode,
      case when event_id % 2 = 1 then event_id % 100 when event_type = 'view' then 10 end as "limit"
    from {{events}}""",
)
def repair_result_schema(t):
    """Old files lack columns the newer ones have; one merged read, then one projection."""
    path = work_path(t.spark, "old_results")
    rows = t.events.select("event_id", F.expr(SCENARIOS).alias("scenario"))
    rows.where("event_id % 2 = 0").write.parquet(f"{path}/run=1")
    newer = rows.where("event_id % 2 = 1").withColumns(
        {"dist_fn": F.lit("old_fn"), "limit": F.col("event_id") % 100})
    newer.write.parquet(f"{path}/run=2")
    merged = t.spark.read.option("mergeSchema", True).parquet(path).drop("run")
    return results.repair_results(merged, "l2_distance", "bruteforce")


# ---------------------------------------------------------------- generators


def unit_sql(seed: int, *keys: str) -> str:
    """The generators' uniform number in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(keys)})), 1, 8))::ubigint / 4294967296.0::double)"


def gauss_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {unit_sql(seed, *keys)})) * cos(2 * pi() * {unit_sql(seed + 1, *keys)}))"


ELEMENTS = "e as (select vec_id as id, label, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as x from {embeddings})"


@query(
    "gen_resample_users",
    f"""with s as (select row_number() over (order by vec_id) as i, embedding from {{embeddings}}),
      d as (select u::int as user_id, k::int as id from range(20) a(u), range((select count(*) from s)) b(k))
    select user_id, id, len(embedding)::int as dim, {SUM} as total
    from d join s on i = floor({unit_sql(42, 'user_id', 'id')} * (select count(*) from s)) + 1""",
)
def gen_resample_users(t):
    """Per user as many draws as the source has vectors."""
    return generate.resample(t.user_vectors, 20, t.user_vectors.count()).select(
        "user_id", "id", *stats("embedding"))


@query(
    "gen_expand_ids",
    "select user_id, id + b * 1000000 as id, category from {user_vectors}, range(10) r(b)",
)
def gen_expand_ids(t):
    return generate.expand_ids(t.user_vectors.drop("embedding"), 10, 1_000_000)


@query(
    "gen_uniform_vectors",
    f"""with {ELEMENTS} select id, floor({unit_sql(43, 'id')} * 9)::int + 1 as category, count(*)::int as dim,
      round(sum(x + 1.0 + {unit_sql(42, 'id', 'j')} * 99.0), 4) as total from e group by id""",
)
def gen_uniform_vectors(t):
    """The vectors of the table moved by uniform noise."""
    return generate.uniform_vectors(t.user_vectors).select("id", "category", *stats("embedding"))


@query(
    "gen_normal_unit",
    f"""with {ELEMENTS}, g as (select id, x + 0.1 * {gauss_sql(42, 'id', 'j')} as y from e)
    select id, count(*)::int as dim, round(sum(y) / sqrt(sum(y * y)), 4) + 0.0 as total from g group by id""",
)
def gen_normal_unit(t):
    """The vectors of the table moved by Gaussian noise, of length one."""
    return generate.normal_unit(t.user_vectors).select("id", *stats("embedding"))


@query(
    "gen_clustered",
    f"""with {ELEMENTS}, c as (select dense_rank() over (order by label) - 1 as cluster, j, avg(x) as c from e group by label, j),
      r as (select distinct id, id % (select count(distinct cluster) from c) as cluster from e)
    select id, r.cluster::int as cluster, count(*)::int as dim, round(sum(c + 0.8 * {gauss_sql(42, 'id', 'j')}), 4) + 0.0 as total
    from r join c on c.cluster = r.cluster group by id, r.cluster""",
)
def gen_clustered(t):
    """Rows around the label means of the table."""
    means = mean_vector(t.embeddings, "label").withColumnRenamed("label", "list_id")
    return generate.clustered(t.user_vectors, means).select("id", "cluster", *stats("embedding"))


@query(
    "gen_typed_rows",
    f"""select c_custkey as id, floor({unit_sql(42, 'c_custkey')} * 1000001)::bigint as c_custkey,
      substr(md5(concat('43:', c_custkey)), 1, 12) as c_name, floor({unit_sql(44, 'c_custkey')} * 25)::int as c_nationkey,
      round({unit_sql(45, 'c_custkey')} * 1000000, 6) as c_acctbal, substr(md5(concat('46:', c_custkey)), 1, 12) as c_mktsegment
    from {{customer}}""",
)
def gen_typed_rows(t):
    """A random row of the customer table's types for every customer."""
    out = generate.typed_rows(t.customer, "c_custkey", t.customer.schema, ranges={"c_nationkey": (0, 24)})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(
    "src_profile_text",
    """select 'p' || (event_id // 200) as file, 11 + sum(case when event_type = 'error' then 2 else 10 end)::bigint as lines
    from {events} group by 1""",
)
def src_profile_text(t):
    """Profile files written from the event log, read back as numbered lines."""
    from tessera.plans.profiling import profile_files
    from tessera.sources.texts import read_lines

    name = F.regexp_extract("file", "file=([^/]+)/", 1).alias("file")
    return read_lines(t.spark, profile_files(t)).groupBy(name).agg(F.count("*").alias("lines"))


