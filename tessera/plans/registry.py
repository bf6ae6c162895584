"""Names of runnable queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.views import Tables, oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its checking SQL if any."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql:
            ORACLE[name] = oracle_text(sql)
        return fn

    return wrap


_kept: dict[tuple, object] = {}


def kept(t: Tables, form: str, make: Callable[[], object], table: str = "embeddings"):
    """What ``make`` gives, once per session and state of the table's files: an index, a layout, a code book."""
    key = (t.spark.sparkContext.applicationId, t.version(table), form)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
