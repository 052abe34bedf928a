"""Headline benchmarks; prints one JSON line.

``BENCH_SF_DIR`` names the data (default ``/root/testdata/sf0.1``), ``BENCH_CPUS``
the number of local cores (default 8).  Each query runs once to warm up and then
three times (once when it takes long); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from canopyflow import workload
from canopyflow.session import local_session

LONG_SECONDS = 8.0
# query -> table whose rows it reads
HEADLINES = {
    "f6_class_decision": "lineitem",
    "f11_parcel_verdict": "lineitem",
    "w6_curve_ranking": "lineitem",
    "w5_smoothed_series": "lineitem",
    "a6_monthly_composite": "lineitem",
    "a21_audit_per_user": "events",
    "a23_audit_per_day": "events",
    "a25_audit_per_target": "events",
    "a26_dashboard_totals": "events",
    "j1_cells_in_parcels": "lineitem",
    "j11_attributed_events": "events",
    "a18_photo_statistics": "lineitem",
    "r1_kmeans_one_step": "lineitem",
    "r3_connected_regions": "lineitem",
    "r4_sieve": "lineitem",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in sorted(set(HEADLINES.values()))}
    seconds, rates = {}, {}
    for name, source in HEADLINES.items():
        warm = run(name)
        seconds[name] = round(statistics.median([run(name) for _ in range(1 if warm > LONG_SECONDS else 3)]), 3)
        rates[name] = round(rows[source] / seconds[name])
    print(json.dumps({
        "metric": "total_seconds_of_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "input_rows_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
