"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_RUNS the
timed runs after one warm-up.  BENCH_DUCKDB=1 adds the times of the same SQL on
DuckDB with as many threads.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from checks.catalog import ORACLE, QUERIES
from checks.compare import duck
from quitanda.session import build_session

HEADLINE = (
    "funnel_status",
    "funnel_conversion",
    "delivery_time_buckets",
    "rfm_scores",
    "rfm_segments",
    "cohort_retention",
    "cohort_repurchase",
    "geo_state_metrics",
    "geo_top_categories",
    "monthly_series",
    "weekday_pattern",
    "hourly_pattern",
    "review_distribution",
    "nps",
    "category_review_scores",
    "delay_vs_score",
    "review_comment_share",
)


def median_time(run: Callable[[], object], runs: int) -> float:
    run()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def on_spark(name: str) -> float:
        return median_time(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save(), runs)

    times = {name: on_spark(name) for name in names}
    record = {
        "metric": "total_wall_time",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
    }
    if os.environ.get("BENCH_DUCKDB"):
        connection = duck(folder)
        connection.execute(f"SET threads = {cpus}")
        record["duckdb"] = {
            name: median_time(lambda sql=ORACLE[name]: connection.sql(sql).fetchall(), runs)
            for name in names
            if name in ORACLE
        }
    spark.stop()
    print(json.dumps(record))


if __name__ == "__main__":
    main()
