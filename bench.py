"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data set, BENCH_CPUS the local cores. Each query is built
and run to the last row; derived tables that reports read are written once
before the clock starts, as a stored batch would be.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.catalog import registry  # noqa: E402
from plumbline.catalog.fusion_queries import stored_assessments, stored_detections  # noqa: E402
from plumbline.catalog.report_queries import assessed_batches, batch_profiles  # noqa: E402
from plumbline.catalog.views import survey  # noqa: E402
from plumbline.plans.session import session  # noqa: E402

HEADLINE = (
    "rule_violations_detail", "rule_reference_miss", "standardize_numeric_inference",
    "profile_numeric", "profile_categorical_topn", "profile_cluster", "record_percentile_rank",
    "stat_evidence", "stat_mad", "detector_run", "enum_similarity", "temporal_ewma_cusum",
    "distribution_shift_full", "forest_scores", "fusion_assessments", "fusion_repeated_ids",
    "group_rollup_cluster", "anomaly_queue_page", "report_anomalies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("plumbline-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.load()[0]
    began = time.perf_counter()
    for prepare in (survey, stored_detections, stored_assessments, assessed_batches,
                    batch_profiles):
        prepare(spark, sf_dir)
    prepared = round(time.perf_counter() - began, 3)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "prepare_sec": prepared, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
