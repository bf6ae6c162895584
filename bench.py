"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores.
Every query runs once to warm up and is timed on the next run, results written to nowhere. Indexes, tenant
layouts and postings are kept while the files of their table stay the same, so the time of a search leaves out
building them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import build_session  # noqa: E402

HEADLINE = [
    # exact and approximate vector search
    "knn_tenant", "knn_topk", "knn_prefilter", "knn_batch", "knn_by_metric", "knn_param_query",
    "range_search", "compound_search", "join_vec_meta", "pq_adc_search", "sq_lut_distance",
    "ivf_assign", "ivf_search_flat", "ivf_search_sq", "ivf_search_pq", "ivf_search_rabitq",
    "ivf_refine", "knn_approx", "knn_approx_range", "knn_approx_ip", "ivf_search_pq_residual", "recall_at_k", "latency_stats", "bm25_rank", "rrf_fuse", "knn_graph_cells",
    # decision support
    *[f"tpch_q{i}" for i in range(1, 23)],
    # click log
    "cb2", "cb4", "cb9", "cb12", "cb16", "cb18", "cb21", "cb28", "cb29", "cb33", "cb39",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    from tessera.plans import catalog

    spark = build_session(
        "bench", f"local[{cpus}]", spark__driver__memory="16g",
        spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        try:
            for _ in range(2):
                t0 = time.perf_counter()
                catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - t0
            times[name] = round(took, 4)
        except Exception as e:  # noqa: BLE001  a failed query is reported and left out
            print(f"{name} failed: {e}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
