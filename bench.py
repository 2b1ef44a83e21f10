"""Wall time of the headline queries: one JSON line.  BENCH_SF_DIR, BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelcast.queries import QUERIES  # noqa: E402
from panelcast.session import drop_scratch, local_session  # noqa: E402

HEADLINE = (
    "district_month_panel",
    "model_dataset",
    "flagship_growth",
    "region_summary",
    "describe_lineitem",
    "clean_series_default",
    "clean_series_iqr_clip_linear",
    "missing_summary",
    "baseline_features",
    "fold_features_past_rows",
    "fold_group_aggregates",
    "daily_context_features",
    "log_context_features",
    "positional_split",
    "expanding_fold_rows",
    "global_positions",
    "error_tables",
    "weak_segments",
    "safety_report",
    "drift_flags",
    "alerts",
    "blend_grid",
    "over_capacity_districts",
    "what_if_scenarios",
    "autocorrelations",
    "recommended_lags",
    "message_triage",
    "incremental_monthly_events",
    "booster_forecast",
    "training_run_decision",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "panelcast-bench", checkpoints=tempfile.mkdtemp(prefix="panelcast-bench-"))
    QUERIES["enrolment_by_month"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
