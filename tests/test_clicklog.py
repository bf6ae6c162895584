"""Reports of the click log in plain Python: the checking SQL comes from the same description as the plan."""

import datetime as dt
import re
from collections import defaultdict

import pytest

from tests.conftest import SF

from tessera.plans import catalog
from tessera.plans.clickbench import ALL_COLUMNS


@pytest.fixture(scope="module")
def hits(tables):
    return [r.asDict() for r in tables.hits.select(*ALL_COLUMNS).collect()]


def run(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    return [tuple(r) for r in df.collect()]


def grouped(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def mean(rows, f):
    return round(sum(map(f, rows)) / len(rows), 6)


def test_regions_by_users(spark, hits):
    users = {k[0]: len({r["UserID"] for r in rs}) for k, rs in grouped(hits, "RegionID").items()}
    want = sorted(users.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert run(spark, "cb8") == want


def test_region_measures(spark, hits):
    rows = [
        (k[0], sum(r["AdvEngineID"] for r in rs), len(rs), mean(rs, lambda r: r["ResolutionWidth"]), len({r["UserID"] for r in rs}))
        for k, rs in grouped(hits, "RegionID").items()
    ]
    assert run(spark, "cb9") == sorted(rows, key=lambda x: (-x[2], x[0]))[:10]


def test_phrases_of_some_urls(spark, hits):
    mine = [r for r in hits if "example" in r["URL"] and r["SearchPhrase"]]
    rows = [(k[0], min(r["URL"] for r in rs), len(rs)) for k, rs in grouped(mine, "SearchPhrase").items()]
    assert run(spark, "cb21") == sorted(rows, key=lambda x: (-x[2], x[0]))[:10]


def test_referring_hosts(spark, hits):
    by = defaultdict(list)
    for r in hits:
        if r["Referer"]:
            by[re.sub(r"^https?://(?:www\.)?([^/]+)/.*$", r"\1", r["Referer"])].append(r["Referer"])
    rows = [(k, round(sum(map(len, rs)) / len(rs), 6), len(rs), min(rs)) for k, rs in by.items() if len(rs) > 5]
    assert run(spark, "cb28") == sorted(rows, key=lambda x: (-x[1], x[0]))[:25]


def january(hits):
    lo, hi = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
    return [r for r in hits if r["CounterID"] == 62 and lo <= r["EventDate"] <= hi and r["IsRefresh"] == 0]


def test_visits_by_source(spark, hits):
    by = defaultdict(int)
    for r in january(hits):
        src = r["Referer"] if r["SearchEngineID"] == 0 and r["AdvEngineID"] == 0 else ""
        by[r["TraficSourceID"], r["SearchEngineID"], r["AdvEngineID"], src, r["URL"]] += 1
    want = sorted(((*k, n) for k, n in by.items()), key=lambda x: (-x[-1], x[:-1]))[5:15]
    assert run(spark, "cb39") == want


def test_views_by_minute(spark, hits):
    by = defaultdict(int)
    for r in january(hits):
        if r["DontCountHits"] == 0 and dt.date(2024, 1, 14) <= r["EventDate"] <= dt.date(2024, 1, 15):
            by[r["EventTime"].strftime("%Y-%m-%d %H:%M:00")] += 1
    assert run(spark, "cb42") == sorted(by.items())[5:15]


def test_shifted_addresses_and_widths(spark, hits):
    by = grouped(hits, "ClientIP")
    want = sorted(((k[0], k[0] - 1, k[0] - 2, k[0] - 3, len(rs)) for k, rs in by.items()), key=lambda x: (-x[-1], x[:-1]))[:10]
    assert run(spark, "cb35") == want
    widths = [sum(r["ResolutionWidth"] + i for r in hits) for i in range(90)]
    assert run(spark, "cb29") == [tuple(widths)]


def test_filter_on_a_column_of_both_tables_keeps_the_equal_join(spark, tmp_path):
    """A title comes from events and pages; its filter must not become the only condition of their join."""
    ids = range(40)
    rows = [(i, dt.datetime(2024, 1, 5), 2 + 5 * (i % 3), "click", 1.0, "") for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    pages = spark.createDataFrame([(i, f"http://a.example.com/{i}", "") for i in range(4)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("cb22", "cb37"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Join" in x and "_url" not in x and "_referer" not in x and "Cross" not in x], plan
        found = df.collect()
        if name == "cb22":
            assert sum(r["c"] for r in found) == 10  # every fourth event
        else:
            visits = [i for i in ids if i % 2 == 0 and i % 13]
            assert sorted(r["views"] for r in found) == sorted(sum(i % 4 == k for i in visits) for k in (0, 2))
