"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion with a noop write (no collect), after
one untimed warm-up query that starts the JVM and Python workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from taskwatch import catalog as C  # noqa: E402
from taskwatch import models_catalog as MC  # noqa: E402
from taskwatch.session import local_session  # noqa: E402

HEADLINE = [
    "task_view", "context_features", "rolling_task", "rolling_module", "rolling_tech",
    "feature_matrix", "scaled_features", "time_split", "ensemble", "rank_metrics", "roc_curve",
    "kpi_rolling",
]
MODEL_HEADLINE = ["hybrid_scores", "explanations", "evaluation_metrics"]

# frame per key, rolling mean/std/min/max, and separately the rolling median.
PROBE_KEYS = {"tech": "tech_id", "module": "module_id", "task": "task_name"}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), "taskwatch-bench")
    run(C.q_dataset_profile(spark, sf_dir))  # warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        run(C.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    from taskwatch.operators.rolling import with_rolling_features
    rows = C.rows(spark, sf_dir)
    for short, key in PROBE_KEYS.items():
        for label, aggs in (("stats4", ["mean", "std", "min", "max"]), ("median", ["median"])):
            t0 = time.time()
            out = with_rolling_features(rows.select("task_id", key, "planned_start_ts", "actual_minutes"),
                                        specs={short: (key, [("actual_minutes", aggs)])})
            run(out)
            times[f"probe_{label}_{short}"] = round(time.time() - t0, 3)
    t0 = time.time()
    MC.fitted(spark, sf_dir)
    times["model_fit"] = round(time.time() - t0, 3)
    for name in MODEL_HEADLINE:
        t0 = time.time()
        run(MC.MODEL_QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
