"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query is executed completely (``write.format("noop")``) RUNS times and its median counts; one
untimed query warms the JVM first. ``value`` is the sum of the medians, plan construction
included; ``build`` has the median time of plan construction alone. Queries that share inputs reuse
the same DataFrame objects within the session (``per_session``), as a program running several
reports would; every timed run still executes its whole plan.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = 3
HEADLINE = [
    "stream_summary",
    "tick_metrics",
    "last_n_interval_stats",
    "resettable_throughput",
    "top_n_per_sample",
    "process_stats",
    "parse_kv",
    "decode_system_vector",
    "cumulative_checkpoints",
    "minmax_downsample",
    "align_asof",
    "log_pattern_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tickflow.plans import load_all
    from tickflow.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), app="tickflow-bench")
    queries, _ = load_all()
    names = [n for n in HEADLINE if n in queries]
    # warm-up on an untimed query: JVM start, class loading, parquet footers
    queries["message_size"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, build = {}, {}
    for n in names:
        runs = []
        for _ in range(RUNS):
            t0 = time.time()
            df = queries[n](spark, sf_dir)
            t1 = time.time()
            df.write.format("noop").mode("overwrite").save()
            runs.append((time.time() - t0, t1 - t0))
        times[n], build[n] = (round(median(x), 3) for x in zip(*runs))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": build,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
