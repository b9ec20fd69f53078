"""Time all registered queries of the library and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores; names given
as arguments restrict the run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from gapspark.plans.registry import load_all
from gapspark.session import build_session

def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gapspark-"),
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()
    names = sys.argv[1:] or list(registered)
    registered["load_stats"](spark, folder).collect()  # starts the engine, not timed
    seconds = {}
    for name in names:
        began = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "registered_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
