"""Seconds per headline query: median of three runs after a warm-up.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES a
comma-separated selection (`all` for every query). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from query_catalog import QUERIES  # noqa: E402
from recurring_metrics.session import local_session  # noqa: E402

HEADLINE = (
    "monthly_summary", "mrr_snapshot", "customer_status", "revenue_by_type", "filtered_star",
    "monthly_series", "revenue_by_product", "dq_orphans", "feature_table", "walk_forward_window",
    "leaderboard_window", "revenue_forecast_window",
)


def seconds(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    repeats = 1 if chosen == "all" else 3
    spark = local_session(cores)

    def run(name: str) -> None:
        """The whole result, without moving it to the driver."""
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    run("monthly_summary")
    timings = {
        name: round(statistics.median(seconds(lambda n=name: run(n)) for _ in range(repeats)), 3)
        for name in names
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cores),
                "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
