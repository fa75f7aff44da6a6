"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventwarden.catalog.queries import all_queries
from eventwarden.session import build_session

HEADLINE = (
    "normalized_events", "stored_events", "tags_exploded", "monitor_records", "log_level_from_text",
    "user_rolling_counts", "user_rolling_distinct", "ip_rolling", "hot_user_rolling", "feature_rows",
    "reasons", "forest_scores", "forest_scores_lineitem", "sequence_window_sums", "noisy_throttle",
    "fingerprint_dedup", "training_score_stats", "psi_drift", "auc_roc", "chronological_split",
    "behaviour_profile", "digest_24h", "verb_over_time", "uc_read_bursts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    jobs = all_queries()
    # One small query first, so that the session is up before the clock runs.
    jobs["risk_levels"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
