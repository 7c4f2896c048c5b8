"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into the no-op sink; the median counts. A run that is told to stop
(SIGTERM, SIGINT) prints the line for the queries that have ended, with `"complete": false`.
"""

import json
import os
import signal
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultframe.plans.registry import registered
from faultframe.session import local_session

HEADLINE = (
    "p1_resample",
    "p3_normalise",
    "p5_sliding_windows",
    "t8_time_features",
    "f5_freq_features",
    "f6_all_features",
    "x3_channel_profile",
    "x13_correlation_matrix",
    "m1_stratified_split",
    "m10_knn_neighbours",
    "e9_model_comparison",
    "g4_cumulative_status",
    "g5_nearest_window",
    "g9_score_flights",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(build, spark, folder) -> float:
    began = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def line(folder: str, times: dict, wanted) -> str:
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    found = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}
    return json.dumps(found if len(times) == len(wanted) else found | {"complete": False})


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}

    def stopped(*_):
        print(line(folder, times, wanted), flush=True)
        os._exit(1)

    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, stopped)
    for name in wanted:
        build = registered()[name]
        run(build, spark, folder)
        times[name] = round(statistics.median(run(build, spark, folder) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(line(folder, times, wanted))
    spark.stop()


if __name__ == "__main__":
    main()
