"""Rows by place: exact, without moving the table, whatever the number of places."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import rows as R
from tests.llm import odd


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(70_000).selectExpr("id as doc_id", "concat('text ', id % 50) as text", "id as `a.b`", "'x' as _place_kind").repartition(3).write.parquet(path)
    return R.located(spark.read.parquet(path))


@pytest.mark.parametrize("share", ["false", "doc_id = 5", "doc_id % 3 = 0", "true"])
@pytest.mark.parametrize("room", [None, 5_000])
def test_chosen_rows(docs, share, room):
    places = docs.where(share).select(R.FILE, R.ROW)
    want = {r[0] for r in docs.where(share).select("doc_id").collect()}
    inside, outside = R.only(docs, places, room), R.without(docs, places, room)
    assert {r[0] for r in inside.select("doc_id").collect()} == want and inside.count() == len(want)
    assert outside.count() == 70_000 - len(want) and inside.columns == docs.columns
    assert outside.columns == [c for c in docs.columns if c not in (R.FILE, R.ROW)]
    assert not want & {r[0] for r in outside.select("doc_id").collect()}


def test_no_text_is_shuffled(docs):
    places = docs.where("doc_id % 3 = 0").select(R.FILE, R.ROW)
    for room in (None, 5_000):
        plan = R.without(docs, places, room)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_places_of_odd_rows(spark):
    rows = R.located(odd.table(spark))
    gone = rows.where(F.col("doc_id").isNull()).select(R.FILE, R.ROW)
    assert R.without(rows, gone).count() == sum(r[0] is not None for r in odd.rows())
    assert R.without(R.located(odd.empty(spark)), gone).count() == 0
