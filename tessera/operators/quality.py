"""Search quality and cost: recall, precision, latency, throughput, configuration tables.

Result lists are ``(qid, id, dist, rank)`` as the search operators return them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scale


def _share(hits: Column, total: Column) -> Column:
    """hits / total, and 0 for an empty total."""
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def recall_at_k(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Id overlap over the size of the exact list, per query: ``(qid, recall)``."""
    hit = found.select("qid", "id").distinct().withColumn("_hit", F.lit(1))
    joined = truth.select("qid", "id").distinct().join(hit, ["qid", "id"], "left")
    return joined.groupBy("qid").agg((F.count("_hit") / F.count("*")).alias("recall"))


def recall_prefix(truth: DataFrame, found: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean overlap of the first k of both lists for each k: ``(k, recall)``."""
    each_k = F.explode(F.lit([int(k) for k in ks])).alias("k")
    t = truth.select("qid", "id", F.col("rank").alias("tr"), each_k).where("tr <= k")
    f = found.select("qid", "id", F.col("rank").alias("fr"))
    joined = t.join(f, ["qid", "id"], "left")
    per = joined.groupBy("k", "qid").agg(
        (F.count_if(F.col("fr") <= F.col("k")) / F.count("*")).alias("recall")
    )
    return per.groupBy("k").agg(F.avg("recall").alias("recall"))


def recall_1nn_at_k(truth: DataFrame, found: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Share of queries whose true nearest is among the first k found: ``(k, recall)``."""
    first = truth.where("rank = 1").select("qid", "id")
    f = found.select("qid", "id", F.col("rank").alias("fr"))
    each_k = F.explode(F.lit([int(k) for k in ks])).alias("k")
    joined = first.join(f, ["qid", "id"], "left").select("fr", each_k)
    return joined.groupBy("k").agg((F.count_if(F.col("fr") <= F.col("k")) / F.count("*")).alias("recall"))


def match_by_distance(
    queries: DataFrame, truth: DataFrame, found: DataFrame, tol: float = 1e-3
) -> DataFrame:
    """Precision, recall and overlap per query, matching on id and distance within ``tol``.

    Every query of ``queries`` gets a row; empty lists give 0.
    """
    t = truth.select("qid", "id", F.col("dist").alias("td"))
    f = found.select("qid", "id", F.col("dist").alias("fd"))
    both = t.join(f, ["qid", "id"]).where(F.abs(F.col("td") - F.col("fd")) <= tol)
    count = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    out = queries.select("qid").distinct()
    for df, name in ((t, "nt"), (f, "nf"), (both, "nm")):
        out = out.join(count(df, name), "qid", "left")
    out = out.na.fill(0, ["nt", "nf", "nm"])
    m, nt, nf = F.col("nm"), F.col("nt"), F.col("nf")
    return out.select(
        "qid", _share(m, nf).alias("precision"), _share(m, nt).alias("recall"),
        _share(m, nt).alias("overlap"),
    )


def _percentile_columns(
    df: DataFrame, by: Sequence[str], value: str, named: dict[str, float]
) -> DataFrame:
    p = scale.percentiles(df, by, value, list(named.values()))
    picks = [F.max(F.when(F.col("p") == q, F.col(value))).alias(n) for n, q in named.items()]
    return p.groupBy(*by).agg(*picks)


def _with_percentiles(base: DataFrame, pct: DataFrame, by: Sequence[str]) -> DataFrame:
    return base.join(pct, list(by)) if by else base.crossJoin(F.broadcast(pct))  # one row


def recall_summary(recalls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes, population deviation and p10 / p90 over queries, 4 decimals."""
    base = recalls.groupBy(*by).agg(
        F.avg("recall").alias("avg_recall"), F.min("recall").alias("min_recall"),
        F.max("recall").alias("max_recall"), F.stddev_pop("recall").alias("std_recall"),
    )
    pct = _percentile_columns(recalls, by, "recall", {"p10_recall": 0.1, "p90_recall": 0.9})
    out = _with_percentiles(base, pct, by)
    return out.select(*by, *[F.round(c, 4).alias(c) for c in out.columns if c not in by])


LATENCY_PERCENTILES = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}


def latency_stats(
    log: DataFrame, by: Sequence[str], ms: str = "latency_ms", digits: int = 2
) -> DataFrame:
    """Mean, percentiles, extremes and deviation of a latency log."""
    base = log.groupBy(*by).agg(
        F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
        F.stddev_pop(ms).alias("std_ms"),
    )
    out = _with_percentiles(base, _percentile_columns(log, by, ms, LATENCY_PERCENTILES), by)
    return out.select(*by, *[F.round(c, digits).alias(c) for c in out.columns if c not in by])


def throughput_stats(
    log: DataFrame, by: Sequence[str], start: str = "ts", ms: str = "latency_ms", digits: int = 2
) -> DataFrame:
    """Queries, wall time, queries per second and percentiles per setting."""
    micros = F.unix_micros(F.col(start).cast("timestamp"))
    wall = (F.max(micros + F.col(ms) * 1000.0) - F.min(micros)) / 1e6
    base = log.groupBy(*by).agg(
        F.count("*").alias("total_queries"), wall.alias("wall_s"), F.avg(ms).alias("avg_ms")
    ).withColumn("qps", F.when(F.col("wall_s") > 0, F.col("total_queries") / F.col("wall_s")).otherwise(0.0))
    out = _with_percentiles(base, _percentile_columns(log, by, ms, LATENCY_PERCENTILES), by)
    reals = [c for c in out.columns if c not in by and c != "total_queries"]
    return out.select(*by, "total_queries", *[F.round(c, digits).alias(c) for c in reals])


def success_stats(
    log: DataFrame, kind: str = "query_type", ok: str = "ok", ms: str = "latency_ms",
    n_results: str = "n_results",
) -> DataFrame:
    """Success rate in percent, times and result counts of the successful runs by query type."""
    good = F.col(ok) == 1
    over = lambda f, c: F.coalesce(f(F.when(good, F.col(c))).cast("double"), F.lit(0.0))
    return log.groupBy(kind).agg(
        F.count("*").alias("n"), (F.count_if(good) * 100.0 / F.count("*")).alias("success_rate"),
        over(F.avg, ms).alias("avg_ms"), over(F.min, ms).alias("min_ms"),
        over(F.max, ms).alias("max_ms"), over(F.avg, n_results).alias("avg_results"),
    )


def with_average_row(timings: DataFrame, label: str, measures: Sequence[str]) -> DataFrame:
    """The table plus an ``Average`` row; missing values do not count."""
    mean = timings.agg(*[F.avg(m).alias(m) for m in measures])
    both = timings.select(label, *[F.col(m).cast("double").alias(m) for m in measures])
    return both.unionByName(mean.select(F.lit("Average").alias(label), *measures))


def best_config(
    results: DataFrame, config: str, goals: dict[str, tuple[str, bool]]
) -> DataFrame:
    """The winning configuration per goal: ``{goal: (column, larger is better)}``.

    Ties go to the first configuration by name.
    """
    picks = []
    for goal, (col, larger) in goals.items():
        signed = F.col(col) if larger else -F.col(col)
        best = F.min_by(F.struct(config, col), F.struct((-signed).alias("s"), F.col(config)))
        picks.append(F.struct(F.lit(goal).alias("goal"), best.alias("b")).alias(goal))
    one = results.where(F.col(config).isNotNull()).agg(*picks)
    parts = [
        one.select(F.col(f"{g}.goal"), F.col(f"{g}.b.{config}"), F.col(f"{g}.b.{c}").alias("value"))
        for g, (c, _) in goals.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def result_pivot(
    results: DataFrame, row: str, column: str, names: Sequence[str], measure: str
) -> DataFrame:
    """Mean of a measure with one column per name (listed, so no extra pass finds them)."""
    return results.groupBy(row).pivot(column, list(names)).agg(F.avg(measure))


# fixed values: bytes per dimension of each storage form
BYTES_PER_DIM = {"Flat": 4.0, "SQ8": 1.0, "SQ4": 0.5, "FP16": 2.0}


def code_size(vectors: DataFrame, pq: Sequence[tuple[int, int]] = (), vec: str = "embedding") -> DataFrame:
    """Bytes per vector and compression against Flat: ``(dim, n, method, bytes, ratio)``.

    ``pq`` lists (sub-vectors, bits); one that does not divide the dimension is left out.
    """
    sizes = vectors.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("dim")).agg(
        F.count("*").alias("n")
    )
    plain = [F.struct(F.lit(m).alias("method"), (F.col("dim") * b).alias("bytes"))
             for m, b in BYTES_PER_DIM.items()]
    coded = [F.when(F.col("dim") % m == 0, F.struct(F.lit(f"PQ{m}x{b}").alias("method"),
                                                    F.lit(m * b / 8.0).alias("bytes")))
             for m, b in pq]
    z = F.explode(F.array(*plain, *coded)).alias("z")
    out = sizes.select("dim", "n", z).where("z is not null")
    return out.select("dim", "n", "z.method", "z.bytes", (F.col("dim") * 4.0 / F.col("z.bytes")).alias("ratio"))


def approx_vs_exact(exact: DataFrame, approx: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall summary of an approximate against an exact run for each k.

    ``exact`` and ``approx`` are the longest lists; shorter ones are their prefixes.
    """
    out = None
    for k in ks:
        r = recall_at_k(exact.where(F.col("rank") <= k), approx.where(F.col("rank") <= k))
        s = recall_summary(r).select(F.lit(int(k)).alias("k"), "*")
        out = s if out is None else out.union(s)
    return out
