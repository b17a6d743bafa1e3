"""Time headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wattframe import catalog
from wattframe.plans.session import session

HEADLINE = [
    "spike_rate_by_server", "r2_pivot_signals", "r10_asof_tolerance", "r15_resample_uniform",
    "c1_wrapped_delta", "c3_stall_safe_power", "w10_hawkes_intensity", "w11_ewma_z", "w14_horizon_label",
    "w37_feature_matrix", "e2_true_transitions", "e8_busy_runs", "e11_alert_episodes", "e17_pulse_cooldown",
    "j1_first_alert", "j2_episode_overlap", "g1_trace_energy", "g2_ramp_risk", "g9_two_level",
    "g22_describe_run", "g24_group_screen", "g28_pr_auc", "g31_event_score", "g41_top_periods",
    "g42_power_cdf", "f4_ups_low_pass",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the engine
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
