"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3; one warm-up run is not counted).  Each query is executed
in full with the ``noop`` sink (nothing is collected to the driver); the value
reported per query is the median wall time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil import catalog  # noqa: E402
from vigil.session import checkpoint_dir, get_session  # noqa: E402

HEADLINE = ["policy_report", "policy_eligibility", "activity_snapshot", "alert_throttle",
            "xe_events", "perf_rollup", "backup_retention", "file_plan", "dq_unique"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))
    spark = get_session(f"local[{cpus}]", app="vigil-bench", shuffle_partitions=parts)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    times: dict[str, float] = {}
    for name in names:
        q = catalog.QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t = time.time()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # first run warms code generation and Python workers
                samples.append(time.time() - t)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
