"""Wall seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaarlens.queries import QUERIES  # noqa: E402

HEADLINE = [
    "month_panel", "revenue_factors", "revenue_factor_intervals", "structure_by_category", "structure_intervals_category",
    "aov_effects", "aov_effect_window", "trend_by_state", "change_points_by_category", "dose_response", "score_difference",
    "bottleneck_table", "stage_durations", "survival_input", "survival_curves", "repeat_rate_table", "rfm_segments",
    "order_features", "gain_table", "strategy_roi", "matched_effects", "cluster_evaluation",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bazaarlens-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(base.rstrip("/"))}))


if __name__ == "__main__":
    main()
