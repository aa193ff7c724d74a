"""Registered queries against their SQL on the smallest data set."""

import os

import pytest

from plumbline.catalog import registry, views
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.load()
# One query per operator group; the whole list is run by tests/oracle_check.py.
CHECKED = (
    "rule_violations_detail", "rule_reference_miss", "standardize_numeric_inference",
    "profile_numeric", "record_percentile_rank", "stat_evidence", "detector_run",
    "temporal_ewma_cusum", "distribution_shift_full", "fusion_with_detections",
    "fusion_repeated_ids", "group_rollup_cluster", "case_audit", "form_record_warnings",
    "ingest_csv_extract",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck.execute(SQL[name]).df()) is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_no_plan_multiplies_rows(spark):
    """No cartesian product and no join without a key."""
    for name in ("fusion_with_detections", "group_rollup_enumerator", "stat_evidence"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_survey_queries_ask_for_functions_the_jvm_compiles(spark, monkeypatch):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    monkeypatch.setitem(views.QUERIES, "probe", None)
    views.query("probe")(lambda s, d: s.conf.get(limit))
    try:
        spark.conf.set(limit, "65535")
        assert int(views.QUERIES["probe"](spark, "")) <= 8000
    finally:
        spark.conf.set(limit, before)


def test_assessments_and_bundles_share_one_evaluation(spark, tmp_path, monkeypatch):
    from plumbline.catalog import fusion_queries, record_queries
    calls = []

    def counted(name):
        run = getattr(fusion_queries, name)

        def wrapped(*rest, **named):
            calls.append(name)
            return run(*rest, **named)
        monkeypatch.setattr(fusion_queries, name, wrapped)

    counted("evaluate_rules")
    counted("record_evidence")
    rows = [(i, "2024-01-0%d 10:00:00" % (1 + i % 9), i % 40, "view" if i % 3 else "purchase", float(i % 17), "{}")
            for i in range(400)]
    (spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
     .selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props")
     .write.parquet(str(tmp_path / "events.parquet")))
    made = record_queries._bundles(spark, str(tmp_path))
    found = {r.record_id: r.rule_evidence_n for r in made.collect()}
    assert sorted(calls) == ["evaluate_rules", "record_evidence"]
    broken = fusion_queries.rules_found(spark, str(tmp_path)).groupBy("record_id").count().collect()
    assert broken and all(found[r["record_id"]] == r["count"] for r in broken) and len(found) == 400
