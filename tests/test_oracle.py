"""Every registered query against its SQL on DuckDB."""

import pytest

from tests.conftest import SF
from tests.oracle_check import compare, connect

from tessera.plans import catalog


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    ok, message, rows, _ = compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLE.get(name), SF)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
