"""Seconds per query: ``python bench.py`` prints one JSON line.

Runs on ``local[$BENCH_CPUS]`` over the tables in ``$BENCH_SF_DIR``. Every query
writes its whole result to the ``noop`` sink, so no column is optimised away and
nothing is collected. The first run of a query is its time; ``warm`` holds the
median of ``$BENCH_WARM_RUNS`` further runs.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from queuelens.plans.queries import all_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_RUNS = int(os.environ.get("BENCH_WARM_RUNS", "3"))

HEADLINE = [
    "log_query",
    "queue_depth",
    "message_state",
    "depth_series",
    "empty_poll_streak",
    "replica_recommendation",
    "ack_join",
    "pending_messages",
    "dead_letters",
    "dead_letter_alarm",
    "batch_assignment",
    "retain_latest",
    "change_detection",
    "normalize_messages",
    "process_messages",
    "process_messages_python",
    "body_size",
    "consumer_rounds",
]


def timed(spark, name) -> float:
    start = time.perf_counter()
    all_queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("queuelens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="queuelens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    first, warm = {}, {}
    for name in names:
        first[name] = round(timed(spark, name), 3)
        if WARM_RUNS:
            warm[name] = round(statistics.median(timed(spark, name) for _ in range(WARM_RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds, first run of each query",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "warm": warm,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
