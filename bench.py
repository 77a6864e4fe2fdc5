"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once cold, then BENCH_RUNS times; the median of the warm runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from trackspark import plans
from trackspark.plans import registry
from trackspark.session import local_session

HEADLINE = [
    "flagship_object_owners", "u02_pooled_dedup", "j02_duplicate_pairs", "j01_pair_candidates", "w01_stationarity", "w05_ever_and_running_max", "f07_min_interval_throttle",
    "t14_sessions", "j17_temporal_match", "a05_scenario_metrics", "a18_stage_latency", "j11_closest_record", "t13_event_clusters", "t06_scripted_scenes", "t12_tier_ladder",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    spark = local_session(cpus, int(cpus))
    plans.load()

    def timed(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    cold, warm, spread = {}, {}, {}
    for name in HEADLINE:
        cold[name] = round(timed(name), 3)
        times = [timed(name) for _ in range(runs)]
        warm[name], spread[name] = round(statistics.median(times), 3), round(max(times) - min(times), 3)
    videos = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    ticks = videos * 130 / 7
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "spread": spread, "sf": os.path.basename(sf_dir), "cpus": int(cpus),
        "machine_ticks_per_sec": round(ticks / warm["t06_scripted_scenes"]), "ladder_tick_configs_per_sec": round(3 * ticks / warm["t12_tier_ladder"])}))


if __name__ == "__main__":
    main()
