import pytest
from pyspark.sql import functions as F

from plumbline.config import FusionSettings
from plumbline.functions import scoring
from plumbline.operators.evaluate import confusion, evaluation_report
from plumbline.operators.fusion import (
    classification_trace, dataset_context, fuse, fusion_summary, record_ids,
)

IDS = "record_id string, enumerator_id string, cluster_id string, district_id string, "


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("scores, expected", [
    ([80], 80), ([80, 80], 96), ([80] * 20, 100), ([50, 30], 56), ([], 0)])
def test_scores_of_one_source_are_capped(spark, scores, expected):
    rows = spark.createDataFrame([(float(s),) for s in scores], "s double").agg(
        scoring.capped_total(F.max("s"), F.sum("s"), 0.2).alias("v"))
    assert rows.first()["v"] == pytest.approx(expected)


def test_weights_are_shared_out_again(spark):
    two = scoring.weighted_risk({"rules": F.lit(80.0), "statistics": F.lit(60.0)},
                                FusionSettings())
    assert value(spark, two) == pytest.approx(80 * .4 / .75 + 60 * .35 / .75)


@pytest.mark.parametrize("risk, level", [(0, "LOW"), (24, "LOW"), (25, "MEDIUM"), (50, "HIGH"),
                                         (75, "CRITICAL")])
def test_risk_levels(spark, risk, level):
    assert value(spark, scoring.risk_severity(F.lit(float(risk)), FusionSettings())) == level


def evidence(spark):
    records = spark.createDataFrame(
        [(r, "E1" if r != "R3" else "E2", "C1", "D1") for r in ("R1", "R2", "R3", "R4", "R5")],
        IDS.rstrip(", "))
    rules = spark.createDataFrame(
        [("R1", "E1", "C1", "D1", "WORKING_HOURS_MAX", "CRITICAL"),
         ("R1", "E1", "C1", "D1", "CLUSTER_IN_REFERENCE", "MEDIUM"),
         ("R3", "E2", "C1", "D1", "CLUSTER_IN_REFERENCE", "MEDIUM"),
         ("R4", "E1", "C1", "D1", "MY_RULE", "CRITICAL"),
         (None, "E1", "C1", "D1", "AGE_MIN", "HIGH")],
        IDS + "rule_code string, severity string")
    statistics = spark.createDataFrame(
        [("R1", "E1", "C1", "D1", "hours", "HIGH"), ("R2", "E1", "C1", "D1", "hours", "MEDIUM"),
         (None, None, None, None, "hours", "HIGH")],
        IDS + "variable string, severity string")
    ml = spark.createDataFrame(
        [("R2", "E1", "C1", "D1", 70.0, "MEDIUM")], IDS + "anomaly_score double, severity string")
    return records, rules, statistics, ml


def test_assessments(spark):
    records, rules, statistics, ml = evidence(spark)
    fused = fuse(records, rules, statistics, ml)
    rows = {r["record_id"]: r for r in fused.collect()}
    assert set(rows) == {"R1", "R2", "R3", "R4", "R5"}
    one = rows["R1"]
    assert one["source_scores"] == {"rules": 100.0, "statistics": 90.0, "ml": 0.0}
    assert one["risk_score"] == 71.5 and one["severity"] == "HIGH" and one["escalation_applied"]
    assert (one["agreement"], one["confidence"]) == ("strong", 96.0)
    assert (one["anomaly_status"], one["classification_reason"]) == (
        "CONFIRMED", "hard_rule_violation")
    assert (one["primary_detector"], one["detector_count"]) == ("HARD_RULE", 1)
    assert one["evidence_refs"]["high_stat_variables"] == ["hours"]
    reasons = {k: (r["anomaly_status"], r["classification_reason"]) for k, r in rows.items()}
    assert reasons["R2"] == ("REVIEW", "unusual_without_validity_violation")
    assert reasons["R3"] == ("NORMAL", "demo_reference_list_miss")
    # A severe rule outside the hard list never confirms.
    assert reasons["R4"] == ("NORMAL", "none") and rows["R4"]["risk_score"] == 40.0
    clean = rows["R5"]
    assert (clean["risk_score"], clean["agreement"], clean["severity"]) == (0.0, "strong", "LOW")
    assert clean["source_severities"] == {"rules": "NONE", "statistics": "NONE", "ml": "NONE"}
    summary = fusion_summary(fused).first()
    assert (summary["records_assessed"], summary["confirmed_anomalies"],
            summary["review_signals"]) == (5, 1, 1)
    assert classification_trace(fused).where("rule_signal").count() == 3


def test_sources_that_did_not_run(spark):
    records, rules, statistics, _ = evidence(spark)
    rows = {r["record_id"]: r for r in fuse(records, None, statistics, history=True).collect()}
    assert rows["R2"]["risk_score"] == 60.0 and rows["R2"]["agreement"] == "single_source"
    assert rows["R2"]["missing_sources"] == ["rules", "ml"] and rows["R2"]["confidence"] == 49.0
    nothing = fuse(records).first()
    assert (nothing["agreement"], nothing["confidence"]) == ("insufficient", 10.0)


def test_context_of_the_whole_batch(spark):
    _, _, statistics, _ = evidence(spark)
    row = dataset_context(statistics).first()
    assert (row["context_score"], row["severity"], row["confidence"]) == (90.0, "HIGH", 45.0)
    assert dataset_context(statistics.where("record_id is not null")).isEmpty()


def detections(spark):
    rows = [("R2", "E1", "C1", "REL_A", 0, 0, "R2", 1), (None, "E1", None, "ENUM", 1, 0, "E1", 0),
            (None, None, "C1", "GEO", 3, 1, "C1", 0), ("R4", "E9", "C9", "REL_A", 0, 0, "R4", 1),
            ("R4", "E9", "C9", "REL_B", 0, 0, "R4", 2)]
    df = spark.createDataFrame(
        rows, "record_id string, enumerator_id string, cluster_id string, detector_type string, "
              "family int, step int, position string, number int")
    return df.withColumn("seq", F.struct("family", "step", "position", "number"))


@pytest.mark.parametrize("wide", [False, True])
def test_detections_reach_records_by_three_ways(spark, monkeypatch, wide):
    from plumbline.plans import lookup

    if wide:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    records, rules, statistics, _ = evidence(spark)
    fused = fuse(records, rules, statistics, detections=detections(spark))
    rows = {r["record_id"]: r for r in fused.collect()}
    assert rows["R2"]["evidence_refs"]["detectors"] == ["REL_A", "ENUM", "GEO"]
    # A record's own detection also reaches the rest of its cluster.
    assert rows["R3"]["evidence_refs"]["detectors"] == ["REL_A", "GEO"]
    assert rows["R4"]["evidence_refs"]["detectors"] == ["REL_A", "REL_B", "ENUM", "GEO"]
    assert rows["R2"]["intelligence_classification"] == "INVESTIGATION_REQUIRED"
    assert rows["R1"]["detector_count"] == 4
    assert (rows["R3"]["primary_detector"], rows["R3"]["review_required"]) == (
        "REL_A", False)


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([("R1", "E1"), ("R1", "E2"), (None, "E1"), (" ", "E1")],
                               "record_id string, enumerator_id string")
    rules = spark.createDataFrame([("R1", "E2", None, None, "AGE_MIN", "HIGH")] * 3,
                                  IDS + "rule_code string, severity string")
    rows = fuse(record_ids(df), rules).collect()
    assert [(r["record_id"], r["enumerator_id"], r["risk_score"]) for r in rows] == [
        ("R1", "E2", 100.0)]
    assert rows[0]["evidence_refs"]["rule_codes"] == ["AGE_MIN"]
    assert rows[0]["evidence_refs"]["rule_violations"] == 3


def test_confusion(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "record_id string")
    row = confusion(ids("a", "b", "c", "c"), ids("b", "c", "d")).first()
    assert tuple(row) == (2, 1, 1, 2 / 3, 2 / 3)
    empty = confusion(ids("a").limit(0), ids("a").limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0)


def test_evaluation_report(spark):
    records, rules, statistics, ml = evidence(spark)
    labels = spark.createDataFrame([("R1", True), ("R2", False)],
                                   "record_id string, expect_rule boolean")
    row = evaluation_report(fuse(records, rules, statistics, ml), labels).first()
    assert (row["recall"], row["precision"], row["flagged_by_ml"], row["labelled"],
            row["intentionally_clean"]) == (1.0, 1.0, 1, 2, 3)


def queue_rows(spark, n=900):
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", None]
    rows = [(f"R{(i * 37) % n:04d}", levels[i % 5], None if i % 31 == 0 else float((i * i) % 90) + (0.25 if i % 2 else 0.0),
             f"E{i % 7}", f"C{i % 40}") for i in range(n)]
    return spark.createDataFrame(rows, "record_id string, severity string, risk_score double, enumerator_id string, "
                                       "cluster_id string").repartition(6)


def test_any_page_of_the_queue_by_counts(spark):
    from plumbline.operators import reports

    rows = queue_rows(spark)
    every = [r.record_id for r in rows.orderBy(*reports.queue_order()).collect()]
    for number, size in ((1, 25), (2, 200), (36, 25), (5, 200), (18, 50)):
        got = reports.queue_page(rows, number, size)
        assert [r.record_id for r in got.collect()] == every[(number - 1) * size:number * size]
        assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert not reports.queue_page(rows, 37, 25).count() and not reports.queue_page(rows.limit(0)).count()
    assert reports.queue_page(rows, 5, 200).columns == rows.columns
    for number, size in ((0, 25), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            reports.queue_page(rows, number, size)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_rows_with_a_baseline_by_three_ids(spark, monkeypatch, limit):
    from plumbline.operators import reports
    from plumbline.plans import lookup

    monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    rows = queue_rows(spark).withColumn("evidence_refs", F.lit(None).cast("string"))
    found = spark.createDataFrame([("R0001", None, None), (None, "E3", None), (None, None, "C8"), ("none", "E99", None)],
                                  "record_id string, enumerator_id string, cluster_id string")
    got = reports._with_baseline(rows, found)
    want = rows.where("record_id = 'R0001' or enumerator_id = 'E3' or cluster_id = 'C8'")
    assert sorted(got.columns) == sorted(rows.columns)
    assert sorted(r.record_id for r in got.collect()) == sorted(r.record_id for r in want.collect())
    assert not reports._with_baseline(rows, found.limit(0)).count()


def test_detectors_run_once(spark, tmp_path, monkeypatch):
    """Assessments and reports share the stored detections."""
    from plumbline.catalog import fusion_queries
    from plumbline.operators.detectors.common import no_detections
    from plumbline.operators.detectors.run import DetectorRun

    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id % 7 AS user_id, 'view' AS event_type, "
              "double(id) AS value, '' AS props FROM range(40)").write.parquet(f"{tmp_path}/events.parquet")
    runs = []

    def counted(df):
        runs.append(df)
        return DetectorRun(no_detections(spark), [], {})

    monkeypatch.setattr(fusion_queries, "run_detectors", counted)
    assert fusion_queries.stored_assessments(spark, str(tmp_path)).count() == 40
    assert fusion_queries.stored_detections(spark, str(tmp_path)).count() == 0
    assert len(runs) == 1
