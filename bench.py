"""Headline queries, timed: median of three runs after one warm-up.

Prints one JSON line.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

import functools
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from stationlab import adapters
from stationlab.catalogue import QUERIES
from stationlab.plans import jobs
from stationlab.session import CHECKPOINT_CONF, local_session
from stationlab.sinks.files import write_csv

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "A1_X8_daily_summary",
    "A2_X9_Q23_monthly_stats",
    "A3_X10_Q7_daily_extremes",
    "A12_thresholds",
    "A17_box_stats",
    "A22_baseline_prediction",
    "J4_X6_X7_anomalies",
    "J5_event_association",
    "K5_J3_insert_or_ignore",
    "Q1_J2_F8_current",
    "Q18_O1_general",
    "Q21_W6_latest_per_station",
    "W1_W5_rolling_rows",
    "W7_W9_rolling_time",
    "X18_X19_route_documents",
)


def measure(action) -> float:
    times = []
    for _ in range(RUNS):
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times), 4)


def main() -> None:
    spark = local_session("stationlab-bench", cores=CPUS)
    if not spark.conf.get(CHECKPOINT_CONF, None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stationlab-bench-"))
    work = tempfile.mkdtemp(prefix="stationlab-bench-")
    readings = adapters.readings(spark, FOLDER)
    write_csv(readings.select(*jobs.READINGS.names), f"{work}/in")

    def run(query) -> int:
        # The sink takes every column of every row; the observed count rides along.
        seen = Observation()
        counted = query(spark, FOLDER).observe(seen, F.count("*").alias("n"))
        counted.write.format("noop").mode("overwrite").save()
        return seen.get["n"]

    actions = {name: functools.partial(run, QUERIES[name]) for name in HEADLINE}
    actions["E1_batch_csv_to_csv"] = lambda: jobs.run_batch(spark, f"{work}/in", f"{work}/out").count()
    # All warm-ups come first, so that no query pays for the start of the session.
    rows = {name: action() for name, action in actions.items()}
    times = {}
    for name, action in actions.items():
        times[name] = measure(action)
        print(name, times[name], rows[name], file=sys.stderr)

    total = round(sum(times.values()), 4)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
