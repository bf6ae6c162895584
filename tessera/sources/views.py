"""Test tables and the derived views built on them.

``{name}`` marks a table: a DataFrame on Spark, a plain table name in oracle SQL.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "nation_x": """
select n_nationkey, n_regionkey,
  case n_nationkey when 0 then 'FRANCE' when 1 then 'GERMANY' when 2 then 'BRAZIL'
    when 3 then 'CANADA' when 4 then 'SAUDI ARABIA' else n_name end as n_name
from {nation}""",
    "part_x": """
select p_partkey, p_name, p_brand, p_size, p_retailprice,
  concat('Manufacturer#', cast(p_partkey % 5 + 1 as string)) as p_mfgr,
  concat(p_type, ' ',
    case p_partkey % 3 when 0 then 'ANODIZED' when 1 then 'POLISHED' else 'BURNISHED' end, ' ',
    case p_partkey % 5 when 0 then 'STEEL' when 1 then 'BRASS' when 2 then 'TIN'
      when 3 then 'COPPER' else 'NICKEL' end) as p_type,
  case p_partkey % 4 when 0 then 'SM BOX' when 1 then 'MED BOX' when 2 then 'LG BOX'
    else 'MED BAG' end as p_container
from {part}""",
    "supplier_x": """
select s_suppkey, s_name, s_nationkey, s_acctbal,
  concat('addr ', cast(s_suppkey as string)) as s_address,
  concat(cast(10 + s_nationkey as string), '-', cast(s_suppkey as string)) as s_phone,
  case when s_suppkey % 10 = 3 then 'x Customer y Complaints z' else 'ok' end as s_comment
from {supplier}""",
    "customer_x": """
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  concat('addr ', cast(c_custkey as string)) as c_address,
  concat(cast(10 + c_nationkey as string), '-', cast(c_custkey as string)) as c_phone,
  concat('note ', cast(c_custkey % 7 as string)) as c_comment
from {customer}""",
    # a third of the customers has no orders: their neighbours have them
    "orders_x": """
select o_orderkey, o_custkey - case when o_custkey % 3 = 2 then 1 else 0 end as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  0 as o_shippriority,
  case when o_orderkey % 9 = 0 then 'a special b requests c' else 'plain' end as o_comment
from {orders}""",
    "lineitem_x": """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount + cast(0 as double) as l_discount, l_tax + cast(0 as double) as l_tax,
  l_returnflag, l_linestatus, l_shipdate,
  case l_partkey % 3 when 0 then l_shipdate + interval '5' day
    when 1 then l_shipdate + interval '15' day
    else l_shipdate - interval '5' day end as l_commitdate,
  l_shipdate + interval '10' day as l_receiptdate,
  case l_orderkey % 5 when 0 then 'MAIL' when 1 then 'SHIP' when 2 then 'AIR'
    when 3 then 'AIR REG' else 'RAIL' end as l_shipmode,
  case l_linenumber % 2 when 0 then 'DELIVER IN PERSON' else 'NONE' end as l_shipinstruct
from {lineitem}""",
    "partsupp": """
select l_partkey as ps_partkey, l_suppkey as ps_suppkey, sum(l_quantity) * 10 as ps_availqty,
  cast(floor(min(l_extendedprice / l_quantity) * 60) as double) / 100 as ps_supplycost
from {lineitem} group by l_partkey, l_suppkey""",
    "hits": """
select e.event_id as WatchID, e.user_id as UserID, e.ts as EventTime,
  cast(e.ts as date) as EventDate, 60 + e.user_id % 5 as CounterID, e.user_id % 25 as RegionID,
  case when e.event_type = 'purchase' then 1 + e.event_id % 7 else 0 end as AdvEngineID,
  e.event_id % 4 as SearchEngineID, e.event_id % 8 - 1 as TraficSourceID,
  1024 + (e.event_id % 9) * 128 as ResolutionWidth,
  800 + (e.event_id % 6) * 100 as WindowClientWidth,
  600 + (e.event_id % 4) * 100 as WindowClientHeight, e.event_id % 6 as MobilePhone,
  case when e.event_id % 3 = 0 then ''
    else concat('model ', cast(e.event_id % 11 as string)) end as MobilePhoneModel,
  case when e.event_type = 'view' then ''
    else concat(e.event_type, ' ', cast(e.user_id % 40 as string)) end as SearchPhrase,
  (e.user_id * 7919) % 65536 as ClientIP, e.event_id % 2 as IsRefresh, e.event_id % 5 as IsLink,
  case when e.event_id % 17 = 0 then 1 else 0 end as IsDownload,
  case when e.event_id % 13 = 0 then 1 else 0 end as DontCountHits, p.url as URL,
  concat(case when e.event_id % 4 = 0 then 'Google ' else '' end, 'page ',
    cast(p.page_id % 20 as string)) as Title,
  r.url as Referer, p.page_id as URLHash, r.page_id as RefererHash
from {events} e cross join (select count(*) as n from {pages}) s
  join {pages} p on p.page_id = e.event_id % s.n join {pages} r on r.page_id = (e.event_id * 3 + 1) % s.n""",
    "user_vectors": """
select cast(vec_id % 10 as int) as user_id, vec_id as id, label as category, embedding
from {embeddings}""",
    "video_frame_vectors": """
select concat('video_', cast(vec_id % 20 as string)) as video_id, vec_id as frame_id, embedding
from {embeddings}""",
    "video_meta": """
select concat('video_', cast(n_nationkey as string)) as video_id, n_name as video_source,
  case when n_regionkey < 2 then 'short' else 'long' end as video_type
from {nation} where n_nationkey < 15""",
    # one search log row per event: scale and concurrency stand for the tested setting
    "search_log": """
select event_id, user_id % 4 as scale, event_id % 5 as concurrency, event_type as query_type, ts,
  value as latency_ms, case when event_type = 'error' then 0 else 1 end as ok,
  event_id % 21 as n_results
from {events}""",
}


# Forms for Spark that give the same rows. The number of pages is part of the events before any join: otherwise a
# filter on a column of both events and pages counts as their join condition, and every event meets every page.
SPARK_VIEWS = {
    "hits": VIEWS["hits"].replace(
        "from {events} e cross join (select count(*) as n from {pages}) s",
        """from (select *, event_id % nullif(n, 0) as _url, (event_id * 3 + 1) % nullif(n, 0) as _referer
    from {events} cross join (select count(*) as n from {pages})) e""",
    ).replace("e.event_id % s.n", "e._url").replace("(e.event_id * 3 + 1) % s.n", "e._referer"),
}

_schemas: dict[tuple[str, int], StructType] = {}


class Tables:
    """Tables and views of one data folder as DataFrames: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self._base(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            df = self.sql(SPARK_VIEWS.get(name, VIEWS[name]))
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

    def _base(self, path: str) -> DataFrame:
        """A Parquet table; its schema is inferred once per process and state of the file or folder."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        changed = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()
        if (path, changed) not in _schemas:
            _schemas[path, changed] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path, changed]).parquet(path)

    def version(self, name: str) -> str:
        """A digest of the paths, sizes and times of the files of a base table, as Spark has listed them."""
        leaf = getattr(self, name)._jdf.queryExecution().analyzed().collectLeaves().head()
        return hashlib.md5(leaf.relation().location().allFiles().mkString("\n").encode()).hexdigest()

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL whose ``{name}`` marks are tables, views or the given DataFrames."""
        for name in set(re.findall(r"\{(\w+)\}", text)) - set(frames):
            frames[name] = getattr(self, name)
        return self.spark.sql(text, **frames)


def oracle_text(sql: str) -> str:
    """Plain SQL: ``{name}`` becomes a table name, used views become CTEs."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in used:
                visit(VIEWS[name])
                used.append(name)

    visit(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t).strip()
    body = plain(sql)
    ctes = [f"{v} as ({plain(VIEWS[v])})" for v in used]
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body
