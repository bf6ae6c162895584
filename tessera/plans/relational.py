"""Registered queries: filters, projections, scalar functions, joins, aggregates, subqueries,
sorts and data checks, one per inventory line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera import scale
from tessera.functions import scalars as SC
from tessera.operators import checks, relational as R
from tessera.plans.registry import query
from tessera.plans.tpch import REVENUE, day, rev


def n_and(df, *keys, **aggs):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[a.alias(k) for k, a in aggs.items()])


# ---------------------------------------------------------------- filters


@query(
    "flt_compare",
    """select count(*) filter (where l_quantity = 10) as eq, count(*) filter (where l_quantity <> 10) as ne,
      count(*) filter (where l_quantity < 10) as lt, count(*) filter (where l_quantity <= 10) as le,
      count(*) filter (where l_commitdate > l_receiptdate) as gt,
      count(*) filter (where l_commitdate >= l_receiptdate) as ge from {lineitem_x}""",
)
def flt_compare(t):
    c = F.col
    conds = {
        "eq": c("l_quantity") == 10, "ne": c("l_quantity") != 10, "lt": c("l_quantity") < 10,
        "le": c("l_quantity") <= 10, "gt": c("l_commitdate") > c("l_receiptdate"),
        "ge": c("l_commitdate") >= c("l_receiptdate"),
    }
    return t.lineitem_x.agg(*[F.count_if(x).alias(k) for k, x in conds.items()])


@query(
    "flt_between",
    """select l_orderkey, l_linenumber, l_quantity, l_shipdate from {lineitem}
    where l_quantity between 10 and 12 and l_shipdate between date '1996-01-01' and date '1996-03-31'""",
)
def flt_between(t):
    return t.lineitem.where(
        F.col("l_quantity").between(10, 12)
        & F.col("l_shipdate").between(day(1996, 1, 1), day(1996, 3, 31))
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query(
    "flt_in_list",
    """select l_shipmode, l_linenumber, count(*) as n from {lineitem_x}
    where l_shipmode in ('MAIL', 'SHIP') and l_linenumber in (1, 3, -1) group by all""",
)
def flt_in_list(t):
    kept = t.lineitem_x.where(
        F.col("l_shipmode").isin("MAIL", "SHIP") & F.col("l_linenumber").isin(1, 3, -1)
    )
    return n_and(kept, "l_shipmode", "l_linenumber")


LIKES = {
    "prefix": "p_type like 'PROMO%'", "suffix": "p_type like '%BRASS'",
    "infix": "p_name like '%red%'", "two": "p_type like '%ANOD%STEEL%'",
    "not_prefix": "p_type not like 'MEDIUM POLISHED%'",
}


@query(
    "flt_like",
    "select " + ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in LIKES.items())
    + " from {part_x}",
)
def flt_like(t):
    p, n = F.col("p_type"), F.col("p_name")
    conds = {
        "prefix": p.like("PROMO%"), "suffix": p.like("%BRASS"), "infix": n.like("%red%"),
        "two": p.like("%ANOD%STEEL%"), "not_prefix": ~p.like("MEDIUM POLISHED%"),
    }
    return t.part_x.agg(*[F.count_if(x).alias(k) for k, x in conds.items()])


@query(
    "flt_bool_dnf",
    """select p_brand, count(*) as n from {lineitem_x} join {part_x} on l_partkey = p_partkey
    where (p_brand = 'Brand#12' and l_quantity between 1 and 11)
      or (p_brand = 'Brand#23' and l_quantity between 10 and 20) group by p_brand""",
)
def flt_bool_dnf(t):
    """The join key sits inside both alternatives; the optimizer pulls it out."""
    key = F.col("l_partkey") == F.col("p_partkey")
    either = (
        key & (F.col("p_brand") == "Brand#12") & F.col("l_quantity").between(1, 11)
    ) | (key & (F.col("p_brand") == "Brand#23") & F.col("l_quantity").between(10, 20))
    return n_and(t.lineitem_x.join(t.part_x, either), "p_brand")


@query("flt_point", "select * from {customer} where c_custkey = 77")
def flt_point(t):
    return t.customer.where(F.col("c_custkey") == 77)


# ---------------------------------------------------------------- projections


@query(
    "prj_arith",
    f"""select l_orderkey, l_linenumber, l_quantity + l_tax as a, l_extendedprice - l_tax as s,
      round({REVENUE} * (1 + l_tax), 6) as m, round(l_extendedprice / l_quantity, 8) as d
    from {{lineitem_x}}""",
)
def prj_arith(t):
    c = F.col
    return t.lineitem_x.select(
        "l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("a"),
        (c("l_extendedprice") - c("l_tax")).alias("s"), F.round(rev() * (1 + c("l_tax")), 6).alias("m"),
        F.round(c("l_extendedprice") / c("l_quantity"), 8).alias("d"),
    )


@query(
    "prj_many_exprs",
    "select " + ", ".join(f"cast(sum(p_size + {i}) as bigint) as s{i}" for i in range(90)) + " from {part}",
)
def prj_many_exprs(t):
    return t.part.agg(*[F.sum(F.col("p_size") + i).alias(f"s{i}") for i in range(90)])


@query(
    "prj_case",
    """select case when o_totalprice < 100000 then 'low' when o_totalprice < 300000 then 'mid'
        else 'high' end as band,
      count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as finished
    from {orders} group by 1""",
)
def prj_case(t):
    price = F.col("o_totalprice")
    band = F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high")
    done = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return n_and(t.orders, band.alias("band"), finished=done)


@query(
    "prj_alias_reuse",
    """select 1 as one, l_linenumber - 1 as prev, count(*) as n from {lineitem}
    group by 1, 2 order by prev""",
)
def prj_alias_reuse(t):
    """Group and order by a select alias and by a constant column."""
    named = t.lineitem.select(F.lit(1).alias("one"), (F.col("l_linenumber") - 1).alias("prev"))
    return n_and(named, "one", "prev").orderBy("prev")


# ---------------------------------------------------------------- scalar functions


@query(
    "fn_extract",
    """select extract(year from ts)::bigint as y, extract(month from ts)::bigint as mon,
      extract(day from ts)::bigint as d, extract(minute from ts)::bigint as mi, count(*) as n
    from {events} group by all""",
)
def fn_extract(t):
    parts = {"y": "YEAR", "mon": "MONTH", "d": "DAY", "mi": "MINUTE"}
    return n_and(
        t.events, *[F.extract(F.lit(p), "ts").cast("long").alias(a) for a, p in parts.items()]
    )


@query(
    "fn_date_interval",
    """select o_orderkey, cast(o_orderdate + interval '45' day as date) as d45,
      cast(o_orderdate - interval '45' day as date) as m45,
      cast(o_orderdate + interval '3' month as date) as m3,
      cast(o_orderdate + interval '1' year as date) as y1 from {orders}""",
)
def fn_date_interval(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", F.date_add(d, 45).alias("d45"), F.date_sub(d, 45).alias("m45"),
        F.add_months(d, 3).alias("m3"), F.add_months(d, 12).alias("y1"),
    )


@query(
    "fn_date_trunc_fmt",
    "select strftime(ts, '%Y-%m-%d %H:%M:00') as m, count(*) as n from {events} group by 1",
)
def fn_date_trunc_fmt(t):
    return n_and(t.events, F.date_format("ts", "yyyy-MM-dd HH:mm:00").alias("m"))


@query("fn_substring", "select c_custkey, substring(c_phone, 1, 2) as code from {customer_x}")
def fn_substring(t):
    return t.customer_x.select("c_custkey", F.substring("c_phone", 1, 2).alias("code"))


@query(
    "fn_length",
    """select lang, round(avg(length(text)), 6) as mean_len, max(length(text))::int as max_len
    from {documents} group by lang""",
)
def fn_length(t):
    n = F.length("text")
    return t.documents.groupBy("lang").agg(
        F.round(F.avg(n), 6).alias("mean_len"), F.max(n).alias("max_len")
    )


@query(
    "fn_regexp_replace",
    r"""select page_id, regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') as host
    from {pages}""",
)
def fn_regexp_replace(t):
    host = F.regexp_replace("url", r"^https?://(?:www\.)?([^/]+)/.*$", "$1")
    return t.pages.select("page_id", host.alias("host"))


@query(
    "fn_split",
    """select doc_id, generate_subscripts(parts, 1)::int as pos, unnest(parts) as part
    from (select doc_id, string_split(text, ',') as parts from {documents})""",
)
def fn_split(t):
    """Split on a literal separator (the pattern is quoted)."""
    parts = t.documents.select(
        "doc_id", F.posexplode(R.split_by_string("text", ",")).alias("pos", "part")
    )
    return parts.withColumn("pos", F.col("pos") + 1)


SIZE_TEXT = """case event_id % 6 when 0 then concat(cast(event_id as string), ' B')
  when 1 then concat(cast(event_id as string), '.5 KB') when 2 then concat(cast(event_id as string), 'MB')
  when 3 then concat(cast(event_id as string), '.25 GB') when 4 then concat(cast(event_id as string), ' TB')
  else event_type end"""


@query(
    "fn_bytes_to_mb",
    """select event_id, round(case event_id % 6 when 0 then event_id / 1048576.0::double
      when 1 then (event_id + 0.5::double) / 1024 when 2 then event_id::double
      when 3 then (event_id + 0.25::double) * 1024 when 4 then event_id::double * 1048576 end, 6) as mb
    from {events}""",
)
def fn_bytes_to_mb(t):
    """Size text in five units; other text gives NULL."""
    text = t.events.select("event_id", F.expr(SIZE_TEXT).alias("s"))
    return text.select("event_id", F.round(SC.size_to_mb("s"), 6).alias("mb"))


DURATION_TEXT = """case event_id % 5 when 0 then concat(cast(event_id as string), 'sec456ms')
  when 1 then concat('2hour', cast(event_id % 60 as string), 'min') when 2 then concat(cast(event_id as string), '.5us')
  when 3 then concat(cast(event_id as string), 'ns') else event_type end"""


@query(
    "fn_duration_ms",
    """select event_id, round(case event_id % 5 when 0 then event_id * 1000.0::double + 456
      when 1 then 7200000.0::double + (event_id % 60) * 60000 when 2 then (event_id + 0.5::double) / 1000
      when 3 then event_id / 1000000.0::double end, 6) as ms from {events}""",
)
def fn_duration_ms(t):
    """Duration text; other text gives NULL."""
    text = t.events.select("event_id", F.expr(DURATION_TEXT).alias("s"))
    return text.select("event_id", F.round(SC.duration_to_ms("s"), 6).alias("ms"))


@query(
    "fn_shift",
    """select event_id, event_id << 3 as lft, event_id >> 2 as rgt,
      right('00000000' || bin(event_id), 8) as low_bits from {events}""",
)
def fn_shift(t):
    e = "event_id"
    return t.events.select(
        e, F.shiftleft(e, 3).alias("lft"), F.shiftrightunsigned(e, 2).alias("rgt"),
        SC.bits(e, 8).alias("low_bits"),
    )


# ---------------------------------------------------------------- joins


@query(
    "join_inner_equi",
    """select n_name, r_name, count(*) as n, round(sum(o_totalprice), 2) as total
    from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
      join {region} on n_regionkey = r_regionkey group by all""",
)
def join_inner_equi(t):
    joined = (
        t.orders.join(t.customer, F.expr("o_custkey = c_custkey"))
        .join(t.nation, F.expr("c_nationkey = n_nationkey"))
        .join(t.region, F.expr("n_regionkey = r_regionkey"))
    )
    return n_and(joined, "n_name", "r_name", total=F.round(F.sum("o_totalprice"), 2))


@query(
    "join_hash_build_probe",
    """select s_nationkey as k, s_suppkey, c_custkey from {supplier} join {customer}
    on s_nationkey = c_nationkey""",
)
def join_hash_build_probe(t):
    """Duplicate keys on both sides keep every pair."""
    build, probe = t.supplier.select("s_nationkey", "s_suppkey"), t.customer.select("c_nationkey", "c_custkey")
    return R.hash_join(build, probe, "s_nationkey", "c_nationkey").select(
        F.col("s_nationkey").alias("k"), "s_suppkey", "c_custkey"
    )


@query(
    "join_composite",
    """select l_orderkey, l_linenumber, ps_availqty from {lineitem} join {partsupp}
    on l_partkey = ps_partkey and l_suppkey = ps_suppkey""",
)
def join_composite(t):
    on = ["partkey", "suppkey"]
    left = t.lineitem.withColumnsRenamed({f"l_{k}": k for k in on})
    right = t.partsupp.withColumnsRenamed({f"ps_{k}": k for k in on})
    return left.join(right, on).select("l_orderkey", "l_linenumber", "ps_availqty")


@query(
    "join_self_alias",
    """select a.n_name as seller, b.n_name as buyer, count(*) as n from {supplier}
      join {customer} on s_suppkey = c_custkey join {nation} a on s_nationkey = a.n_nationkey
      join {nation} b on c_nationkey = b.n_nationkey where a.n_name <> b.n_name group by all""",
)
def join_self_alias(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    pairs = (
        t.supplier.join(t.customer, F.expr("s_suppkey = c_custkey"))
        .join(a, F.expr("s_nationkey = a.n_nationkey"))
        .join(b, F.expr("c_nationkey = b.n_nationkey")).where("a.n_name <> b.n_name")
    )
    return n_and(pairs, F.col("a.n_name").alias("seller"), F.col("b.n_name").alias("buyer"))


@query(
    "join_left_outer_cond",
    """select c_custkey, o_orderkey from {customer} left join {orders}
    on c_custkey = o_custkey and o_totalprice > 400000""",
)
def join_left_outer_cond(t):
    on = F.expr("c_custkey = o_custkey and o_totalprice > 400000")
    return t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey")


@query(
    "join_semi_exists",
    """select o_orderkey from {orders} where exists (from {lineitem} where l_orderkey = o_orderkey
      and l_returnflag = 'R')""",
)
def join_semi_exists(t):
    returned = t.lineitem.where("l_returnflag = 'R'")
    return t.orders.join(returned, F.expr("l_orderkey = o_orderkey"), "left_semi").select("o_orderkey")


@query(
    "join_semi_in",
    """select c_custkey from {customer} where c_custkey in (select o_custkey from {orders}
      where o_orderkey in (select l_orderkey from {lineitem} group by 1 having sum(l_quantity) > 250))""",
)
def join_semi_in(t):
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 250")
    owners = t.orders.join(big, F.expr("l_orderkey = o_orderkey"), "left_semi")
    return t.customer.join(owners, F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey")


@query(
    "join_anti_not_exists",
    "select c_custkey from {customer} where not exists (from {orders_x} where o_custkey = c_custkey)",
)
def join_anti_not_exists(t):
    return t.customer.join(t.orders_x, F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey")


@query(
    "join_anti_not_in",
    """select 'clean' as list, count(*) as n from {supplier_x}
      where s_suppkey not in (select s_suppkey from {supplier_x} where s_comment like '%Complaints%')
    union all select 'with_null', count(*) from {supplier_x} where s_suppkey not in
      (select case when s_comment = 'ok' then null else s_suppkey end from {supplier_x})""",
)
def join_anti_not_in(t):
    """Null-aware NOT IN: one NULL in the list empties the result."""
    listed = t.supplier_x.where(F.col("s_comment").like("%Complaints%")).select("s_suppkey")
    nulls = t.supplier_x.select(
        F.when(F.col("s_comment") != "ok", F.col("s_suppkey")).alias("s_suppkey")
    )
    out = [
        R.not_in(t.supplier_x, "s_suppkey", lst, "s_suppkey")
        .agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "n")
        for name, lst in (("clean", listed), ("with_null", nulls))
    ]
    return out[0].union(out[1])


@query(
    "join_semi_theta",
    """select l_orderkey, l_suppkey, l_linenumber from {lineitem_x} l
    where exists (from {lineitem_x} x where x.l_orderkey = l.l_orderkey and x.l_suppkey <> l.l_suppkey)
      and not exists (from {lineitem_x} x where x.l_orderkey = l.l_orderkey
        and x.l_suppkey <> l.l_suppkey and x.l_receiptdate > x.l_commitdate)""",
)
def join_semi_theta(t):
    """Equality plus inequality against the same table, answered from per-key extremes."""
    late = F.expr("l_receiptdate > l_commitdate")
    other = R.key_extremes(t.lineitem_x, "l_orderkey", "l_suppkey", {"all": F.lit(True), "late": late})
    own = F.col("l_suppkey")
    exists = (F.col("all_lo") != own) | (F.col("all_hi") != own)
    none_late = F.col("late_lo").isNull() | ((F.col("late_lo") == own) & (F.col("late_hi") == own))
    return t.lineitem_x.join(other, "l_orderkey").where(exists & none_late).select(
        "l_orderkey", "l_suppkey", "l_linenumber"
    )


@query(
    "join_theta_scalar",
    """select o_orderkey, o_custkey from {orders} o where o_totalprice >
      (select 1.2::double * avg(o_totalprice) from {orders} i where i.o_custkey = o.o_custkey)""",
)
def join_theta_scalar(t):
    mean = t.orders.groupBy("o_custkey").agg((1.2 * F.avg("o_totalprice")).alias("floor"))
    return t.orders.join(mean, "o_custkey").where("o_totalprice > floor").select(
        "o_orderkey", "o_custkey"
    )


@query("join_cross", "select n_name, r_name from {nation}, {region}")
def join_cross(t):
    """A product without predicate of two dimension tables."""
    return R.cross_dimensions(t.nation, t.region).select("n_name", "r_name")


# ---------------------------------------------------------------- aggregation


@query(
    "agg_global",
    """select count(*) as n, sum(event_id)::bigint as s, round(avg(value), 6) as a, min(value) as lo,
      max(value) as hi, min(ts::date) as d0, max(ts::date) as d1 from {events}""",
)
def agg_global(t):
    d = F.col("ts").cast("date")
    return t.events.agg(
        F.count("*").alias("n"), F.sum("event_id").alias("s"), F.round(F.avg("value"), 6).alias("a"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(d).alias("d0"),
        F.max(d).alias("d1"),
    )


@query(
    "agg_group",
    """select l_returnflag, l_linestatus, l_shipmode, count(*) as n, sum(l_quantity) as q,
      round(avg(l_extendedprice), 4) as p, min(l_shipdate) as d0, max(l_shipdate) as d1
    from {lineitem_x} group by all""",
)
def agg_group(t):
    return n_and(
        t.lineitem_x, "l_returnflag", "l_linestatus", "l_shipmode", q=F.sum("l_quantity"),
        p=F.round(F.avg("l_extendedprice"), 4), d0=F.min("l_shipdate"), d1=F.max("l_shipdate"),
    )


@query(
    "agg_count_col",
    """select n_rows, n_toxic, n_quality from (select count(*) as n_rows, count(toxic) as n_toxic,
      count(case when quality = 1 then 1 end) as n_quality
    from {documents} left join {labels} using (doc_id))""",
)
def agg_count_col(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.agg(
        F.count("*").alias("n_rows"), F.count("toxic").alias("n_toxic"),
        F.count(F.when(F.col("quality") == 1, 1)).alias("n_quality"),
    )


@query(
    "agg_count_distinct",
    """select event_type, count(distinct user_id) as u, count(distinct ts::date) as d, count(*) as n,
      round(avg(value), 6) as v from {events} group by 1""",
)
def agg_count_distinct(t):
    return n_and(
        t.events, "event_type", u=F.count_distinct("user_id"),
        d=F.count_distinct(F.col("ts").cast("date")), v=F.round(F.avg("value"), 6),
    )


@query("agg_min_string", "select lang, min(text) as first_text from {documents} group by lang")
def agg_min_string(t):
    return t.documents.groupBy("lang").agg(F.min("text").alias("first_text"))


@query(
    "agg_having",
    """select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from {orders}
    group by 1 having count(*) > 12 and sum(o_totalprice) > 1000000""",
)
def agg_having(t):
    g = n_and(t.orders, "o_custkey", total=F.sum("o_totalprice"))
    return g.where("n > 12 and total > 1000000").withColumn("total", F.round("total", 2))


@query(
    "agg_having_scalar",
    """select user_id, round(sum(value), 2) as total from {events} group by 1
    having sum(value) > (select sum(value) * 0.008::double from {events})""",
)
def agg_having_scalar(t):
    g = t.events.groupBy("user_id").agg(F.sum("value").alias("total"))
    floor = g.agg((F.sum("total") * 0.008).alias("floor"))  # one row
    return g.join(F.broadcast(floor), F.expr("total > floor")).select(
        "user_id", F.round("total", 2).alias("total")
    )


@query(
    "agg_ratio",
    """select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end)
      / sum(o_totalprice), 6) as share from {orders} group by 1""",
)
def agg_ratio(t):
    part = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0))
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(part / F.sum("o_totalprice"), 6).alias("share")
    )


@query(
    "agg_two_level",
    "select n, count(*) as users from (select count(*) as n from {events} group by user_id) group by n",
)
def agg_two_level(t):
    per_user = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("n").agg(F.count("*").alias("users"))


@query(
    "agg_group_expr",
    """select user_id % 10 as k, user_id % 10 - 1 as k1, upper(event_type) as e, count(*) as n
    from {events} group by all""",
)
def agg_group_expr(t):
    k = F.col("user_id") % 10
    return n_and(t.events, k.alias("k"), (k - 1).alias("k1"), F.upper("event_type").alias("e"))


@query(
    "agg_percentile",
    """select event_type, round(quantile_cont(value, 0.5), 6) as p50,
      round(quantile_cont(value, 0.9), 6) as p90 from {events} group by 1""",
)
def agg_percentile(t):
    p = scale.percentiles(t.events, ["event_type"], "value", (0.5, 0.9))
    pick = lambda q: F.round(F.max(F.when(F.col("p") == q, F.col("value"))), 6)
    return p.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.9).alias("p90"))


@query(
    "agg_bitmap_build",
    """select event_type, (user_id * 700) // 32768 + 1 as bucket,
      count(distinct user_id) as bits from {events} where user_id > 0 group by all""".replace(
        "(user_id * 700) // 32768 + 1", "(user_id * 700 - 1) // 32768 + 1"
    ),
)
def agg_bitmap_build(t):
    """Bitmaps per key and bucket, with the number of bits set in each."""
    src = t.events.where("user_id > 0").select("event_type", (F.col("user_id") * 700).alias("v"))
    maps = R.bitmap_table(src, "event_type", "v")
    return maps.select("event_type", "bucket", F.bitmap_count("bm").alias("bits"))


@query(
    "agg_bitmap_union_count",
    """select count(distinct user_id * 700) as users from {events}
    where user_id > 0 and event_type in ('click', 'view')""",
)
def agg_bitmap_union_count(t):
    src = t.events.where("user_id > 0").select("event_type", (F.col("user_id") * 700).alias("v"))
    maps = R.bitmap_table(src, "event_type", "v")
    chosen = maps.where(F.col("event_type").isin("click", "view"))
    return R.bitmap_union_count(chosen, out="users")


# ---------------------------------------------------------------- subqueries and views


@query(
    "sub_scalar",
    "select c_custkey from {customer} where c_acctbal > (select avg(c_acctbal) from {customer})",
)
def sub_scalar(t):
    return t.sql(
        "select c_custkey from {customer} where c_acctbal > (select avg(c_acctbal) from {customer})"
    )


CORRELATED = """select p_partkey, l_quantity from {lineitem} l join {part} on p_partkey = l_partkey
    where l_quantity < (select 0.3 * avg(i.l_quantity) from {lineitem} i where i.l_partkey = p_partkey)"""


@query("sub_scalar_corr", CORRELATED.replace("0.3", "0.3::double"))
def sub_scalar_corr(t):
    return t.sql(CORRELATED.replace("0.3", "0.3D"))


@query(
    "sub_derived",
    """select y, count(*) as n, round(avg(o_totalprice), 4) as mean from
      (select year(o_orderdate)::int as y, o_totalprice from {orders}) as dated group by y""",
)
def sub_derived(t):
    dated = t.orders.select(F.year("o_orderdate").alias("y"), "o_totalprice")
    return n_and(dated, "y", mean=F.round(F.avg("o_totalprice"), 4))


TWICE = """with spend as (select o_custkey, sum(o_totalprice) as total from {orders} group by o_custkey)
    select o_custkey, round(total, 2) as total from spend
    where total > (select avg(total) * 2 from spend)"""


@query("sub_cte", TWICE)
def sub_cte(t):
    """A common table used twice; the shared aggregation is one reused exchange."""
    return t.sql(TWICE)


# ---------------------------------------------------------------- sorts


@query(
    "srt_multi",
    "select s_suppkey, s_acctbal, s_nationkey from {supplier} order by s_nationkey, s_acctbal desc",
)
def srt_multi(t):
    return t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey").orderBy(
        "s_nationkey", F.desc("s_acctbal"), "s_suppkey"
    )


@query(
    "srt_topk",
    "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25",
)
def srt_topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    ).limit(25)


@query(
    "srt_limit_offset",
    "select event_id, value from {events} order by value desc, event_id limit 10 offset 900",
)
def srt_limit_offset(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").offset(900).limit(10)


@query(
    "srt_limit_only",
    """select least(count(*), 10) as returned, least(count(*), 10) as in_full
    from (select distinct user_id, event_type from {events})""",
)
def srt_limit_only(t):
    """Any ten groups: how many came, and how many of them are groups of the full result."""
    full = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.limited_in_full(full, 10)


@query("srt_full", "select user_id, count(*) as n from {events} group by user_id")
def srt_full(t):
    """A total order over all groups: range-partitioned sort."""
    return n_and(t.events, "user_id").orderBy(F.desc("n"), "user_id")


@query(
    "win_fixed_bins",
    """with r as (select value, row_number() over (partition by event_type order by event_id) as i,
      event_type from {events})
    select event_type, (i - 1) // 5 as bin, min(i) as first_i, max(i) as last_i,
      round(avg(value), 6) as mean, min(value) as lo, max(value) as hi
    from r group by all""",
)
def win_fixed_bins(t):
    return R.fixed_bins(t.events, "event_type", "event_id", "value", 5).select(
        "event_type", "bin", "first_i", "last_i", F.round("mean", 6).alias("mean"), "lo", "hi"
    )


# ---------------------------------------------------------------- data checks


@query(
    "dup_exists",
    """select 'event_id' as col, count(*) > count(distinct event_id) as dup from {events}
    union all select 'user_id', count(*) > count(distinct user_id) from {events}
    union all select 'text', count(*) > count(distinct text) from {documents}""",
)
def dup_exists(t):
    out = [
        checks.has_duplicates(df, c)
        for df, c in ((t.events, "event_id"), (t.events, "user_id"), (t.documents, "text"))
    ]
    return reduce(lambda a, b: a.union(b), out)


@query(
    "dup_within_k",
    """with p as (select event_id, user_id,
      lag(event_id) over (partition by user_id order by event_id) as prev from {events})
    select user_id, prev as first_pos, event_id as second_pos from p where event_id - prev <= 3""",
)
def dup_within_k(t):
    return checks.duplicates_within(t.events, "user_id", "event_id", 3)
