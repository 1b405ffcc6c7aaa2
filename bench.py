"""Times the headline queries and prints one JSON line.

Every query is built and run to the end (all rows, all columns) once to warm
up and then BENCH_RUNS times; its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from catalog.queries import QUERIES, flagship
from scanledger.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = [
    "usage_extract",
    "user_daily_base",
    "table_costs",
    "dataset_costs_direct",
    "main_cost_table",
    "dataset_summary",
    "account_summary",
    "user_dataset_attribution",
    "top_spenders",
    "query_history",
    "dataset_ranking",
    "table_rebuild_report",
    "cost_by_team",
    "alert_daily_cost",
    "alert_failures",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {"user_day_mart": flagship, **{name: QUERIES[name] for name in HEADLINES}}
    wanted = os.environ.get("BENCH_QUERIES")
    if wanted:
        queries = {name: queries[name] for name in wanted.split(",")}
    seconds = {}
    for name, build in queries.items():
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
