"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run in full three times with an empty cache; the best time counts.
"""

from __future__ import annotations

import json
import os
import re
import time

HEADLINE = [
    "population_cube",
    "aggregate_growth",
    "lag_change",
    "cohort_table",
    "measure_panel",
    "append_rebased_member",
    "share_of_group",
    "max_with_ties",
    "group_sum_strict",
    "append_total_member",
    "corr_test",
    "corr_table",
    "centred_moving_mean",
    "normal_scores",
    "normal_scores_global",
    "numerator_denominator_ratio",
    "apportion_by_share",
    "scenario_long",
    "project_cohorts",
    "projection_by_age",
    "outlier_repair",
    "ols_tidy",
    "ols_glance",
    "ols_augment_resid",
    "fitted_band",
    "residual_scores",
    "member_sum_projection",
    "kfold_cv",
]


def main() -> None:
    from panelwright.plans.catalog import QUERIES
    from panelwright.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": os.environ.get("CHECKPOINT_DIR", "/tmp/panelwright-checkpoints"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(3):
            spark.catalog.clearCache()
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
