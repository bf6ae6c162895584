import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tessera.sources.views import Tables

    return Tables(spark, SF)


def matrix(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d))


def frame(spark, x, name="embedding"):
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, {name} array<float>").repartition(4)


def asked(spark, x):
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "qid long, qvec array<double>")


def as_float32(x):
    return x.astype(np.float32).astype(np.float64)


def brute(x, q, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return order.tolist()


def ranked(df):
    """{qid: [ids in rank order]}"""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["id"])
    return out
