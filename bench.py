"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [--repeat N]

Each query is executed completely into Spark's ``noop`` sink (every row is
produced, nothing is collected to the driver) and timed; the best of
``--repeat`` runs counts.  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kiln.plans.registry import QUERIES, load_all  # noqa: E402
from kiln.session import get_session  # noqa: E402

HEADLINE = [
    "join_parent_child",  # flagship: runs left-joined to pre-aggregated steps
    "agg_run_rollup",
    "agg_suite_summary",
    "agg_system_metrics",
    "join_prev_row",
    "join_polymorphic",
    "join_regex",
    "join_gaps",
    "win_active_dataset",
    "cal_attach",
    "dq_fk",
    "dq_checks",
    "set_suggestions",
    "prj_infer_types",
    "feed_fx_swaps",
    "feed_guide_sheets",
    "feed_soma",
    "mkt_ohlc_daily",
    "art_labels",
    "art_provenance",
    "src_pages",
    "src_html_cards",
    "snk_upsert",
    "snk_archive_names",
    "top_logs",
]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--all", action="store_true", help="run every registered query")
    ap.add_argument("--repeat", type=int, default=1)
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", app="kiln-bench", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus))),
        "spark.driver.memory": "16g",
    })
    load_all()
    keys = sorted(QUERIES) if a.all else HEADLINE
    if a.keys:
        keys = [k for k in sorted(QUERIES) if any(re.search(p, k) for p in a.keys)]
    # warm-up (not counted): JVM class loading / JIT of the scan, join,
    # aggregate and JSON paths, which would otherwise be charged to the
    # first queries
    for k in ("top_logs", "join_parent_child", "feed_soma"):
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for k in keys:
        best = None
        for _ in range(a.repeat):
            t0 = time.perf_counter()
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[k] = round(best, 3)
        print(f"{k}: {times[k]:.3f}s", file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
