"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. A query's time covers building
its plan and computing every row (written to Spark's no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterload.plans.queries import QUERIES  # noqa: E402
from meterload.session import build_session  # noqa: E402

HEADLINE = (
    "city_load_flagship", "household_profile", "year_aligned_readings", "community_assignment", "spine_fill",
    "row_zscore_outliers", "levels_grouping_sets", "zscore_sensors", "output_windows", "training_pairs",
    "lag_regression_entity", "candidate_search", "bottomup_appliance", "level_report", "std_load_appliance",
    "training_curve", "lag_regression_multi", "kfold_scores", "candidate_halving", "window_statistics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="meterload-"),
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(HEADLINE[0])  # JVM warm-up
    times = {name: run(name) for name in HEADLINE}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": scale, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
