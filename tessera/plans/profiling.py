"""Registered queries: logs, profiles and plan text, derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import profiles as P
from tessera.plans.registry import query
from tessera.session import work_path

# a profile covers this many consecutive events, so no profile grows with the table
PER_FILE = 200

SCAN_TEXT = """concat('      OLAP_SCAN_OPERATOR (id=', event_id, '. table name = t', user_id, '(t', user_id, ')):\n',
  '        - BlockSize: ', value, ' MB\n        - ColumnCount: ', event_id % 10 + 1, '\n',
  '        - SerializedBinarySize: ', event_id % 900, '.00 KB\n        VScanner:\n',
  '          - RowsRead: ', case when event_id * 3 % 5000 >= 1000
     then concat(event_id * 3 % 5000 div 1000, '.0K (', event_id * 3 % 5000, ')')
     else cast(event_id * 3 % 5000 as string) end, '\n',
  '          - ScanNodeDeserializationBlockTime: ', event_id % 50, '.25ms\n',
  '          - ScannerSerializationBlockTime: ', event_id % 3, 'sec', event_id % 700, 'ms\n',
  '      VNewOlapScanNode(t', user_id % 4, ')\n        -  RowsReturned:  ', event_id % 3, '\n')"""

EXCHANGE_TEXT = "concat('      EXCHANGE_OPERATOR (id=', event_id, '):\n        - RowsProduced: 5\n')"


def profile_texts(t) -> DataFrame:
    """One profile per run of events: header, then a scan or exchange operator per event."""
    body = F.expr(f"case when event_type = 'error' then {EXCHANGE_TEXT} else {SCAN_TEXT} end")
    parts = t.events.select(F.expr(f"event_id div {PER_FILE}").alias("p"), "event_id", body.alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "s")))  # at most PER_FILE rows
    joined = parts.groupBy("p").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("body"))
    head = F.expr(
        "concat('Summary:\n   - Profile ID: q', p, '\n   - Total: ', p % 7, 'sec456ms\n',"
        "'   - Sql Statement: select ', p, ' from t\nMergedProfile\n  merged of ', p, '\n  end of merged\n',"
        "'Execution Profile q', p, ':\n  Fragments:\n')"
    )
    return joined.select(F.concat(F.lit("p"), F.col("p")).alias("file"), F.concat(head, "body").alias("text"))


def profile_files(t) -> str:
    """The profiles written as one text file each; returns the folder."""
    path = work_path(t.spark, "profiles")
    profile_texts(t).repartition("file").write.partitionBy("file").text(path)
    return path


SCANS = f"""s as (select 'q' || (event_id // {PER_FILE}) as query_id,
    (event_id // {PER_FILE}) % 7 * 1000 + 456.0::double as total_ms, event_id * 3 % 5000 as rows_read,
    event_id % 10 + 1 as column_count, value as block_mb, (event_id % 900) / 1024.0::double as serialized_mb,
    (event_id % 3) * 1000.0::double + event_id % 700 as ser_ms, event_id % 50 + 0.25::double as deser_ms
  from {{events}} where event_type <> 'error' and event_id * 3 % 5000 >= 100)"""


@query(
    "profile_scan_rows",
    f"""with {SCANS} select query_id, total_ms, rows_read, column_count, block_mb,
      round(serialized_mb, 6) as serialized_mb, ser_ms, deser_ms from s""",
)
def profile_scan_rows(t):
    out = P.scan_rows(profile_texts(t))
    return out.withColumn("serialized_mb", F.round("serialized_mb", 6)).drop("file", "sql")


@query(
    "profile_summary",
    f"""with {SCANS} select query_id, total_ms, count(*) as scan_cnt,
      round(min(ser_ms + deser_ms), 4) as min_ser_ms, round(max(ser_ms + deser_ms), 4) as max_ser_ms,
      round(quantile_cont(ser_ms + deser_ms, 0.5), 4) as p50_ser_ms, min(rows_read) as min_rows_read,
      max(rows_read) as max_rows_read, sum(rows_read)::bigint as sum_rows_read,
      quantile_cont(rows_read, 0.5) as p50_rows_read, round(min(block_mb), 4) as min_block_mb,
      round(max(block_mb), 4) as max_block_mb, round(sum(block_mb), 4) as sum_block_mb,
      round(quantile_cont(block_mb, 0.5), 4) as p50_block_mb from s group by all""",
)
def profile_summary(t):
    return P.summarize_scans(P.scan_rows(profile_texts(t)), digits=4)


@query(
    "profile_nonzero_scans",
    f"""select 'p' || (event_id // {PER_FILE}) as file, event_id % 3 as rows_returned, count(*) as n
    from {{events}} where event_type <> 'error' and user_id % 4 = 2 and event_id % 3 > 0 group by all""",
)
def profile_nonzero_scans(t):
    hits = P.nonzero_scans(profile_texts(t), "t2")
    return hits.groupBy("file", "rows_returned").agg(F.count("*").alias("n"))


# every event is a plan fragment; fragment i of a file sends to fragment (i - 1) div 2
def plan_texts(t) -> DataFrame:
    i = f"(event_id % {PER_FILE})"
    sink = f"case when {i} = 0 then 'RESULT_SINK_OPERATOR (id=-9)' else concat('DATA_STREAM_SINK_OPERATOR (dest_id=', ({i} - 1) div 2, ')') end"
    body = F.expr(
        f"concat('  Fragment ', {i}, ':\n    Pipeline : 0(instance_num=4):\n       - WaitTime: avg 1ms\n      ', {sink},"
        f"':\n        - ExecTime: avg 5us\n      LOCAL_EXCHANGE_OPERATOR (PASSTHROUGH) (id=-5):\n"
        f"    Pipeline : 1(instance_num=4):\n      EXCHANGE_OPERATOR (id=', {i}, ' , ref=7):\n')"
    )
    parts = t.events.select(F.expr(f"event_id div {PER_FILE}").alias("p"), "event_id", body.alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "s")))  # at most PER_FILE rows
    text = F.concat(F.lit("MergedProfile \nFragments:\n"), F.array_join(F.transform(ordered, lambda x: x["s"]), ""))
    return parts.groupBy("p").agg(text.alias("text")).select(F.concat(F.lit("p"), F.col("p")).alias("file"), "text")


@query(
    "plan_operators",
    f"""with i as (select 'p' || (event_id // {PER_FILE}) as file, (event_id % {PER_FILE})::int as f from {{events}})
    select file, f as fragment, 0 as pipeline, 0 as op_no,
      case when f = 0 then 'RESULT_SINK_OPERATOR' else 'DATA_STREAM_SINK_OPERATOR' end as name,
      case when f = 0 then -9 end as id, case when f > 0 then ((f - 1) // 2)::string else '' end as dests from i
    union all select file, f, 0, 1, 'LOCAL_EXCHANGE_OPERATOR (PASSTHROUGH)', -5, '' from i
    union all select file, f, 1, 0, 'EXCHANGE_OPERATOR', f, '' from i""",
)
def plan_operators(t):
    ops = P.plan_operators(plan_texts(t))
    dests = F.coalesce(F.array_join(F.transform("dest_ids", lambda d: d.cast("string")), ","), F.lit(""))
    return ops.withColumn("dests", dests).drop("dest_ids")


@query(
    "plan_edges",
    f"""with i as (select 'p' || (event_id // {PER_FILE}) as file, (event_id % {PER_FILE})::int as f from {{events}})
    select file, f as fragment, case when f > 0 then ((f - 1) // 2)::int end as parent,
      floor(log2(f + 1) + 1e-9)::int as depth from i""",
)
def plan_edges(t):
    return P.plan_edges(P.plan_operators(plan_texts(t)))


@query(
    "section_extract",
    f"""with p as (select distinct event_id // {PER_FILE} as p from {{events}})
    select 'p' || p as file, 1 as line_no, '  merged of ' || p as line from p
    union all select 'p' || p, 2, '  end of merged' from p""",
)
def section_extract(t):
    return P.section(profile_texts(t), "MergedProfile", "Execution Profile")


@query(
    "histogram_topn",
    """with h as (select count(*) as instances, sum(event_id)::bigint as size,
      'app.' || event_type || '.User' || user_id as class from {events} group by 3)
    (select 'top' as part, * from h order by size desc, class limit 20)
    union all select 'prefix', * from h where class like 'app.click.%'""",
)
def histogram_topn(t):
    """The largest classes of all, and every class of one package."""
    rows = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    line = F.expr("concat('  ', user_id, ':   ', n, '    ', s, '  app.', event_type, '.User', user_id)")
    lines = rows.select(line.alias("line")).union(t.region.select(F.col("r_name")))
    top = P.histogram_topn(lines, 20).select(F.lit("top").alias("part"), "*")
    return top.unionByName(P.histogram_prefix(lines, "app.click.").select(F.lit("prefix").alias("part"), "*"))


LOG = """select concat('q', cast(event_id as string)) as query_id, ts as begin_at,
    ts + interval '1' second as end_at, concat('db', cast(user_id % 3 as string)) as db,
    case event_id when cast(floor(n * 0.1) as bigint) then 'select ''run-begin-77''' 
      when cast(floor(n * 0.9) as bigint) then 'select ''run-end-77''' else props end as sql
  from {events} cross join (select count(*) as n from {events}) s"""


@query(
    "log_between_markers",
    f"""with l as ({LOG}) select query_id, begin_at, end_at from l where db = 'db1'
      and begin_at >= (select begin_at from l where sql like '%run-begin-77%')
      and end_at <= (select begin_at from l where sql like '%run-end-77%')""",
)
def log_between_markers(t):
    hit = P.log_between_markers(t.sql(LOG), "run-begin-77", "run-end-77", "db1")
    return hit.select("query_id", "begin_at", "end_at")


