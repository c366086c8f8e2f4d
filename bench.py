"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rampwise.bindings import catalog  # noqa: E402
from rampwise.session import local_session  # noqa: E402

HEADLINE = [
    "wn1_occupancy", "wn2_occupancy_at", "wn3_trailing_counts", "wn4_trailing_means", "wn5_nowcast", "wn6_centred_count",
    "wn8_rolling", "wn9_last_when", "wn12_segments", "wn16_motion", "jn3_asof_left", "jn7_within_reach", "jn8_match_bucketed",
    "wn10_accept", "jn16_reoccupied", "ag1_group_median", "ag3_winsorised_sweep", "ag12_exact_quantiles", "ml1_median_baseline",
    "ml2_choose_strategy", "ml5_matched_mixture", "ml21_composition_rmse", "dg1_tail_calibration", "dg5_target_encoding", "dg8_auc",
    "fb1_departure_features", "fb2_turnaround", "fb3_weather_features", "fb4_match_traces", "fb6_trace_features", "fb7_ground_segments",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    for name in ("wn3_trailing_counts", "ml2_choose_strategy"):  # start the engine before the clock
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
