"""Benchmark result files: append, read back, repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: scenarios without a global function, the scenario with a limit and its default
UNTOUCHED_SCENARIOS = ("distfn", "cache_raw")
LIMIT_SCENARIO, DEFAULT_LIMIT = "concscale", 10


def result_text(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A fixed field list as text: six decimals for reals, blank for NULL or a missing field."""
    types = dict(df.dtypes)

    def cell(name: str) -> Column:
        if name not in types:
            return F.lit("").alias(name)
        c = F.col(name)
        text = F.format_string("%.6f", c) if types[name] in ("double", "float") else c.cast("string")
        return F.when(c.isNull(), "").otherwise(text).alias(name)

    return df.select(*[cell(f) for f in fields])


def append_results(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Append result rows as CSV with a header."""
    result_text(df, fields).write.mode("append").options(header=True, emptyValue="").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append result rows as JSON lines."""
    df.write.mode("append").json(path)


# fixed value: scenarios of raw measurements, which the combined summary leaves out
NOT_IN_SUMMARY = ("cache_raw",)


def write_summary(scenarios: Mapping[str, DataFrame], path: str) -> None:
    """The combined JSON summary: the records of every scenario below its name, as JSON lines.

    A record has the fields of its scenario that are not NULL. A summary is one folder; a scenario written
    again replaces its records.
    """
    for name, rows in scenarios.items():
        if name not in NOT_IN_SUMMARY:
            rows.write.mode("overwrite").json(f"{path}/scenario={name}")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """All records with their ``scenario`` and the fields of all scenarios, NULL where a record has none."""
    return spark.read.option("basePath", path).json(path)


def read_results(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Result rows as text; blanks are empty strings."""
    schema = ", ".join(f"{f} string" for f in fields)
    raw = spark.read.schema(schema).options(header=True).csv(path)
    return raw.na.fill("")


def repair_results(
    results: DataFrame, dist_fn: str, search_mode: str, scenario: str = "scenario"
) -> DataFrame:
    """Add or correct ``dist_fn``, ``search_mode`` and ``limit`` of old result rows.

    Two scenarios stay as they are; one gets a default limit where it has none.
    """
    have = set(results.columns)
    touch = ~F.col(scenario).isin(*UNTOUCHED_SCENARIOS)
    old = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    limit = old("limit", "bigint")
    default = F.when(F.col(scenario) == LIMIT_SCENARIO, F.lit(DEFAULT_LIMIT).cast("bigint"))
    return results.withColumns({
        "dist_fn": F.when(touch, F.lit(dist_fn)).otherwise(old("dist_fn", "string")),
        "search_mode": F.when(touch, F.lit(search_mode)).otherwise(old("search_mode", "string")),
        "limit": F.coalesce(limit, default),
    })
