"""

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up run, then ``$BENCH_REPS`` timed runs (median).
Every run materialises all result columns through the ``noop`` sink, so no
column or row is pruned away.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gymlake.plans import catalog  # noqa: E402
from gymlake.session import get_spark  # noqa: E402
from gymlake.sources.tables import Tables  # noqa: E402

HEADLINE = {
    "B1_coach_analytics": "coach_analytics",
    "B2_coach_overview": "coach_overview",
    "B3_streaks": "streaks",
    "B4_latest_sessions": "latest_sessions",
    "B5_nutrition_analytics": "nutrition_analytics_all",
    "B6_daily_nutrition": "daily_nutrition",
    "B7_match_slots": "match_slots",
    "B8_validate_bookings": "validate_bookings",
    "B9_bulk_availability": "bulk_availability",
    "B10_gym_report": "gym_report_summary",
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=shuffle, app_name="gymlake-bench")
    catalog.queries()  # load registry
    times = {}
    for label, name in HEADLINE.items():
        build = catalog.REGISTRY[name].build
        runs = []
        for i in range(reps + 1):
            t0 = time.perf_counter()
            build(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        times[label] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
