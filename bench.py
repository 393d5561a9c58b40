"""Times the headline queries and prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_RUNS (runs per
query; the fastest counts), BENCH_ONLY (comma-separated query names).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splitlane.plans import queries  # noqa: E402
from splitlane.plans.queries import QUERIES  # noqa: E402
from splitlane.session import local_session  # noqa: E402

HEADLINE = (
    "scan_tolerant",
    "decode_start_json",
    "identity_enrich",
    "geo_range_join",
    "feature_hash",
    "count_events",
    "app_status",
    "retrain_eligible",
    "session_sample",
    "session_pair_join",
    "latest_n",
    "labelled_sample",
    "feature_vector",
    "infer_supports",
    "category_mapping",
    "remap_sample",
    "unseen_fallback",
    "random_assign",
    "argmax_variation",
    "evaluate_baseline",
    "registry_update",
    "apply_commands",
    "append_start",
    "stream_session_sample",
    "dump_sample",
    "stream_predict",
    "train_and_evaluate",
    "predict_and_log",
    "predict_and_log_as_data",
)
# Queries that train models run once: their time is in the fits, not in warming up.
ONCE = ("train_and_evaluate", "predict_and_log", "predict_and_log_as_data")


def decisions(spark, sf_dir: str):
    """Fitting, deciding and logging, without the checks that the query of that name adds."""
    return queries.decide_and_log(spark, sf_dir, *queries._trained_registry(spark, sf_dir))


def decisions_as_data(spark, sf_dir: str):
    """The same, with the models saved and read as node tables in one plan."""
    apps, _ = queries._saved_registry(spark, sf_dir)
    return queries.decide_and_log(spark, sf_dir, apps, None)


JOBS = {"predict_and_log": decisions, "predict_and_log_as_data": decisions_as_data}


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    JOBS.get(name, QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    spark = local_session(cpus, "bench")
    seconds = {
        name: round(min(timed(spark, name, sf_dir) for _ in range(1 if name in ONCE else runs)), 3)
        for name in names
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
