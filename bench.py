"""Time the headline queries and print one JSON line.

Every query is run to the end and its rows are written to the no-op sink, so no column is
pruned away and nothing travels to the driver.  The first run of a query warms up the JVM;
the better of two further runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries import CATALOG  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "gen_rules",
    "gen_equal_width",
    "gen_dates_adaptive",
    "gen_category_typed_many",
    "class_statistics",
    "class_share_distance",
    "sample_exact",
    "k_partial",
    "k_partial_wide",
    "k_strict",
    "k_full_domain",
    "l_partial",
    "l_strict",
    "t_partial",
    "km_partial",
    "dp_layered",
    "dp_budget_rebin",
    "dp_randomized_response",
    "class_report",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = [n for n in sys.argv[1:] if n in CATALOG] or list(HEADLINE)
    seconds: dict[str, float] = {}
    for name in chosen:
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            CATALOG[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i > 0 or runs == 0:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
