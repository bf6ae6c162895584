"""Query logs, execution profiles and plan text.

A profile is one text row ``(file, text)``. Its scans, fragments and operators are cut out with
split and regular expressions inside the row, so parsing needs no shuffle and no window, and any
number of profiles runs in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scale
from tessera.functions.scalars import duration_to_ms, size_to_mb

# fixed values: marks of the profile format, and the row count below which a scan is dropped
EXECUTION_MARK = r"Execution[^\n]*Profile[^\n]*|Profile[^\n]*Execution[^\n]*"
SCAN_MARK = r"(?=OLAP_SCAN_OPERATOR \(id=)"
MIN_SCAN_ROWS = 100


def after(text, mark: str) -> Column:
    """Text from the first match of ``mark`` on; NULL without one."""
    parts = F.split(text, mark, 2)
    return F.when(F.size(parts) > 1, parts[1])


COUNTER = r"-\s+(\w+):\s*([^\n]*\S)"


def counters(text) -> Column:
    """All ``- name: value`` lines, last first, as ``struct(names, values)``."""
    part = lambda i: F.reverse(F.regexp_extract_all(text, F.lit(COUNTER), F.lit(i)))
    return F.struct(part(1).alias("names"), part(2).alias("values"))


def counter(found: str, name: str) -> Column:
    """Value of a counter column's last line of that name; empty when there is none."""
    at = F.array_position(F.col(found)["names"], name)
    return F.when(at > 0, F.get(F.col(found)["values"], (at - 1).cast("int"))).otherwise(F.lit(""))


def whole_number(text) -> Column:
    """``12.3K (12345)`` or ``12345`` as a bigint."""
    inner = F.regexp_extract(text, r"\((\d+)\)", 1)
    plain = F.regexp_extract(text, r"^\s*(\d+)\s*$", 1)
    value = F.when(inner != "", inner).when(plain != "", plain)
    return value.cast("bigint")


def scan_rows(texts: DataFrame, min_rows: int = MIN_SCAN_ROWS) -> DataFrame:
    """One row per scan operator of the execution part, scans under ``min_rows`` left out.

    A scan whose sizes cannot be read is left out too.
    """
    head = texts.select(
        "file",
        F.regexp_extract("text", r"- Profile ID:\s*(\S+)", 1).alias("query_id"),
        F.regexp_extract("text", r"- Sql Statement:\s*([^\n]*)", 1).alias("sql"),
        duration_to_ms(F.regexp_extract("text", r"- Total:\s*(\S+)", 1)).alias("total_ms"),
        after("text", EXECUTION_MARK).alias("body"),
    )
    pieces = F.split("body", SCAN_MARK)
    # the piece before the first mark is no scan
    scans = head.select(
        "file", "query_id", "sql", "total_ms", F.explode(F.slice(pieces, 2, F.size(pieces) - 1)).alias("s")
    )
    scans = scans.select("file", "query_id", "sql", "total_ms", counters("s").alias("s"))
    fields = {
        "rows": "RowsRead", "cols": "ColumnCount", "block": "BlockSize", "packed": "SerializedBinarySize",
        "ser": "ScannerSerializationBlockTime", "deser": "ScanNodeDeserializationBlockTime",
    }
    # inline() keeps the extracted texts as columns: the filter below cannot repeat the regexes
    texts_of = F.inline(F.array(F.struct(*[counter("s", f).alias(n) for n, f in fields.items()])))
    raw = scans.select("file", "query_id", "sql", "total_ms", texts_of)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    size = lambda c: F.when(F.col(c) == "", 0.0).otherwise(size_to_mb(c))
    numbers = (
        F.coalesce(whole_number("rows"), F.lit(0)).alias("rows_read"),
        F.coalesce(whole_number("cols"), F.lit(0)).alias("column_count"),
        size("block").alias("block_mb"), size("packed").alias("serialized_mb"),
        F.col("ser"), F.col("deser"),
    )
    read = raw.select("file", "query_id", "sql", "total_ms", F.inline(F.array(F.struct(*numbers)))).where(
        (F.col("rows_read") >= min_rows) & F.expr("block_mb is not null and serialized_mb is not null"))
    return read.withColumns({
        "ser_ms": zero(duration_to_ms("ser")), "deser_ms": zero(duration_to_ms("deser"))
    }).drop("ser", "deser")


def summarize_scans(scans: DataFrame, digits: int = 2) -> DataFrame:
    """Per query: number of scans and min / max / median / sum of time, rows and megabytes."""
    by = ["query_id", "total_ms"]
    # the texts are parsed once, for the aggregates and the medians
    s = scale.cut_lineage(scans.withColumn("time_ms", F.col("ser_ms") + F.col("deser_ms")))
    aggs = [F.count("*").alias("scan_cnt")]
    measures = (("time_ms", "ser_ms"), ("rows_read", "rows_read"), ("block_mb", "block_mb"))
    for col, name in measures:
        aggs += [F.round(F.min(col), digits).alias(f"min_{name}"), F.round(F.max(col), digits).alias(f"max_{name}")]
        if col != "time_ms":
            aggs.append(F.round(F.sum(col), digits).alias(f"sum_{name}"))
    out = s.groupBy(*by).agg(*aggs)
    long = s.select(*by, F.explode(F.array(
        *[F.struct(F.lit(n).alias("m"), F.col(c).cast("double").alias("v")) for c, n in measures]
    )).alias("z")).select(*by, "z.m", "z.v")
    half = scale.percentiles(long, [*by, "m"], "v", [0.5])
    medians = [F.round(F.max(F.when(F.col("m") == n, F.col("v"))), digits).alias(f"p50_{n}") for _, n in measures]
    return out.join(half.groupBy(*by).agg(*medians), by)


def nonzero_scans(texts: DataFrame, table: str, node: str = "VNewOlapScanNode") -> DataFrame:
    """Scans of a table that returned rows: ``(file, scan_no, rows_returned)``.

    Each scan's own lines are read, up to the next scan of any table.
    """
    pieces = F.split("text", rf"(?={node}\()")
    scans = texts.select("file", F.posexplode(pieces).alias("scan_no", "s"))
    mine = scans.where(F.col("s").startswith(f"{node}({table})"))
    rows = F.regexp_extract("s", r"-\s+RowsReturned:\s+(\d+)", 1)
    return (
        mine.select("file", "scan_no", F.when(rows != "", rows).cast("bigint").alias("rows_returned"))
        .where("rows_returned > 0")
    )


OPERATOR = r"(\w+_OPERATOR)(?:\s*\(([^()=]*)\))?\s*\((dest_id|id)=([^)]*)"


def plan_operators(texts: DataFrame) -> DataFrame:
    """Operators of plan text: ``(file, fragment, pipeline, op_no, name, id, dest_ids)``."""
    numbered = lambda c, mark: F.split(c, rf"(?m)(?=^\s*{mark})")
    fragments = texts.select("file", F.explode(numbered("text", r"Fragment\s+\d+:")).alias("f")).select(
        "file", "f", F.regexp_extract("f", r"^\s*Fragment\s+(\d+):", 1).alias("fragment")
    ).where("fragment <> ''")
    pipes = fragments.select(
        "file", F.col("fragment").cast("int").alias("fragment"),
        F.explode(numbered("f", r"Pipeline\s*:\s*\d+")).alias("p"),
    ).select("file", "fragment", "p", F.regexp_extract("p", r"^\s*Pipeline\s*:\s*(\d+)", 1).alias("pipeline"))
    pipes = pipes.where("pipeline <> ''")
    starts = F.regexp_extract_all("p", F.lit(r"(?m)^\s*(\w+_OPERATOR\s*\([^\n]*)"), F.lit(1))
    ops = pipes.select(
        "file", "fragment", F.col("pipeline").cast("int").alias("pipeline"),
        F.posexplode(starts).alias("op_no", "line"),
    )
    part = lambda i: F.regexp_extract("line", OPERATOR, i)
    extra, kind, value = part(2), part(3), part(4)
    number = F.regexp_extract(value, r"^(-?\d+)", 1)
    dests = F.split(F.regexp_extract(value, r"^([\d,]+)", 1), ",")
    return ops.where(part(1) != "").select(
        "file", "fragment", "pipeline", "op_no",
        F.when(extra != "", F.concat(part(1), F.lit(" ("), extra, F.lit(")"))).otherwise(part(1)).alias("name"),
        F.when((kind == "id") & (number != ""), number).cast("int").alias("id"),
        F.when(kind == "dest_id", F.transform(dests, lambda d: d.cast("int"))).alias("dest_ids"),
    )


STREAM_SINK = "DATA_STREAM_SINK_OPERATOR"  # fixed value


def plan_edges(operators: DataFrame) -> DataFrame:
    """``(file, fragment, parent, depth)``: which fragment a fragment's stream sink feeds.

    Depth is the number of steps to the root. Ancestors double their distance every round, until
    none is left. A fragment that feeds itself, directly or over others, is an error.
    """
    sinks = operators.where(F.col("name") == STREAM_SINK).select(
        "file", "fragment", F.explode("dest_ids").alias("id")
    )
    targets = operators.where((F.col("name") != STREAM_SINK) & F.col("id").isNotNull()).groupBy(
        "file", "id"
    ).agg(F.min("fragment").alias("parent"))
    links = sinks.join(targets, ["file", "id"]).groupBy("file", "fragment").agg(F.max("parent").alias("parent"))
    every = operators.select("file", "fragment").distinct().join(links, ["file", "fragment"], "left")
    state = scale.cut_lineage(every.select(
        "file", "fragment", "parent", F.col("parent").alias("up"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
    ))
    # no path is longer than a file's number of fragments
    longest = state.groupBy("file").count().agg(F.max("count").alias("n")).head()["n"] or 0
    reach = 1
    while not state.where("up is not null").isEmpty():
        if reach > longest:
            raise ValueError("a plan fragment feeds itself")
        reach *= 2
        above = state.select("file", F.col("fragment").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = scale.cut_lineage(
            state.join(above, ["file", "up"], "left").select(
                "file", "fragment", "parent", F.col("up2").alias("up"),
                (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            )
        )
    return state.select("file", "fragment", "parent", "depth")


def section(texts: DataFrame, start: str, end: str) -> DataFrame:
    """Lines between two headings: ``(file, line_no, line)``.

    ``start`` must be a whole line, ``end`` the beginning of a line; without an end the rest of
    the text belongs to the section.
    """
    body = F.split("text", rf"(?m)^[ \t]*\Q{start}\E[ \t]*\n", 2)
    cut = F.split(body[1], rf"(?m)^[ \t]*\Q{end}\E", 2)[0]
    found = texts.where(F.size(body) > 1).select("file", F.regexp_replace(cut, r"\n$", "").alias("t"))
    lines = found.select("file", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    return lines.select("file", (F.col("n") + 1).alias("line_no"), "line")


def class_histogram(lines: DataFrame) -> DataFrame:
    """``(instances, size, class)`` of class histogram lines; other lines are skipped."""
    pattern = r"^\s*\d+:\s+(\d+)\s+(\d+)\s+(.+)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.where(F.col("line").rlike(pattern)).select(
        part(1).cast("bigint").alias("instances"), part(2).cast("bigint").alias("size"), part(3).alias("class")
    )


def histogram_topn(lines: DataFrame, n: int = 20) -> DataFrame:
    """The n largest classes by size."""
    return class_histogram(lines).orderBy(F.desc("size"), "class").limit(n)


def histogram_prefix(lines: DataFrame, prefix: str) -> DataFrame:
    """All classes whose name starts with ``prefix``, however many."""
    return class_histogram(lines).where(F.col("class").startswith(prefix))


def log_between_markers(log: DataFrame, begin: str, end: str, db: str) -> DataFrame:
    """Queries of one database between two marker statements: from the start of the first marker
    to the start of the second."""
    is_marker = F.col("sql").contains(begin) | F.col("sql").contains(end)
    marks = log.where(is_marker).select("begin_at", "end_at").orderBy("end_at", "begin_at").limit(2)
    span = marks.agg(
        F.min_by("begin_at", F.struct("end_at", "begin_at")).alias("lo"),
        F.max_by("begin_at", F.struct("end_at", "begin_at")).alias("hi"), F.count("*").alias("n"),
    ).where("n = 2")  # one row, or none without both markers
    inside = F.expr("begin_at >= lo and end_at <= hi")
    return log.where(F.col("db") == db).join(F.broadcast(span), inside).select(*log.columns)
