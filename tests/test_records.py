import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cases, context
from plumbline.operators.form_lines import import_frame, preview, read_forms
from plumbline.operators.fusion import fuse, record_ids
from plumbline.operators.profile import (
    dataset_profile, entity_profiles, record_zscores, variable_profiles,
)
from plumbline.operators.rules import evaluate_rules
from plumbline.operators.statistics import evaluate_statistics

LINES = """Household survey form
Record ID: 7
Name : Asha
District
Chennai
INCOME
:
25,000
Age 41
Gender: robot
Marital Status: Married
age 99
Signature
Record No 7
Age
:
Income
many
District:
Identity: 8
Occupation
-
Farmer:""".split("\n")


def lines(spark, per_page=12):
    rows = [("d", i, 1 + i // per_page, t, 0.95 if i != 4 else 0.5) for i, t in enumerate(LINES)]
    return spark.createDataFrame(
        rows, "doc_id string, line_no bigint, page int, text string, score double")


@pytest.mark.parametrize("per_block", [10_000, 3])
def test_forms(spark, monkeypatch, per_block):
    from plumbline.operators import form_lines

    monkeypatch.setattr(form_lines, "LINES_PER_BLOCK", per_block)
    records = read_forms(lines(spark))
    first, second, third = records.orderBy("block").collect()
    assert (first["record_id"], first["name"], first["district"], first["income"], first["age"],
            first["page"]) == ("7", "Asha", "Chennai", 25000.0, 41, 1)
    assert first["field_confidence"]["district"] == pytest.approx((0.95 + 0.5) / 2)
    assert first["field_confidence_band"]["district"] == "medium"
    assert first["field_confidence_band"]["remarks"] == "unknown"
    assert first["warnings"] == ["Unrecognized gender value: 'robot'.",
                                 "Duplicate Record ID '7' within this upload."]
    # "Age" is followed by a separator and another label: no value, no error.
    assert second["age"] is None and second["issues"] == [
        "Income could not be interpreted as a number."]
    assert second["warnings"][:2] == ["District was not detected.", "Age was not detected."]
    # A label has no word boundary: "Identity" starts with "id".
    assert third["record_id"] == "entity: 8" and third["occupation"] == "Farmer"
    assert [r["needs_review"] for r in (first, second, third)] == [True, True, False]
    seen = preview(lines(spark), records).first()
    assert (seen["pages"], seen["records_detected"], seen["records_needing_review"]) == (2, 3, 2)
    assert "page" not in import_frame(records).columns


def log(spark):
    rows = [
        (1, "B", "R1", "2024-01-01", "CREATE", None, None), (2, "B", "R1", "2024-01-02",
                                                            "MARK_VALID", None, None),
        (3, "B", "R1", "2024-01-03", "ADD_NOTE", None, "n"), (4, "B", "R1", "2024-01-04",
                                                             "MARK_INVALID", None, None),
        (5, "B", "R2", "2024-01-01", "CREATE", None, None), (6, "B", "R2", "2024-01-02",
                                                            "MARK_VALID", None, None),
        (7, "B", "R2", "2024-01-03", "UPDATE", "OPEN", None), (8, "B", "R2", "2024-01-03",
                                                              "CREATE", None, None)]
    df = spark.createDataFrame(rows, "action_id int, batch_id string, record_id string, d string, "
                                     "action string, status string, note string")
    return df.select(
        "*", F.to_timestamp("d").alias("ts"), F.lit("ann").alias("user"),
        F.lit(None).cast("string").alias("priority"), F.lit("ann").alias("assigned_to"))


def test_cases(spark):
    assessed = spark.createDataFrame(
        [("B", "R1", 1, 70.0, "HIGH", "REVIEW", "E1", "D1"),
         ("B", "R1", 2, 80.0, "CRITICAL", "CONFIRMED", "E1", "D1")],
        "batch_id string, record_id string, run_id int, risk_score double, severity string, "
        "anomaly_status string, enumerator_id string, district_id string")
    found = cases.current_cases(log(spark), assessed.where("run_id = 2"))
    rows = {r["record_id"]: r for r in found.collect()}
    one, two = rows["R1"], rows["R2"]
    assert (one["status"], str(one["resolved_at"])[:10], one["priority"], one["actions"]) == (
        "RESOLVED_INVALID", "2024-01-02", "CRITICAL", 4)
    assert (two["status"], two["resolved_at"], two["priority"]) == ("OPEN", None, "MEDIUM")
    assert one["supervisor_notes"] == "n" and one["action"] == "MARK_INVALID"
    counts = {r["status"]: r["cases"] for r in cases.status_counts(found).collect()}
    assert counts["OPEN"] == 1 and counts["resolved"] == 1 and counts["ESCALATED"] == 0
    assert [r["record_id"] for r in cases.filter_cases(found, status="OPEN").collect()] == ["R2"]
    latest = cases.with_latest_assessment(found, assessed).where("record_id = 'R1'").first()
    assert latest["risk_score"] == 80.0


def test_audit_trail(spark):
    trail = cases.audit_trail(log(spark)).orderBy("action_id").collect()
    assert [(r["action_id"], r["previous_status"], r["new_status"]) for r in trail] == [
        (1, None, "OPEN"), (2, "OPEN", "RESOLVED_VALID"),
        (3, "RESOLVED_VALID", "RESOLVED_VALID"), (4, "RESOLVED_VALID", "RESOLVED_INVALID"),
        (5, None, "OPEN"), (6, "OPEN", "RESOLVED_VALID"), (7, "RESOLVED_VALID", "OPEN")]
    quiet = cases.audit_trail(log(spark).where("action <> 'ADD_NOTE'"))
    assert quiet.count() == 6


def test_entries_without_keys_or_times_stay_in_the_trail(spark):
    full = log(spark)
    odd = full.where("action_id in (1, 2, 3)").selectExpr(*[
        "cast(null as string) AS record_id" if c == "record_id" else
        "if(action_id = 2, null, ts) AS ts" if c == "ts" else
        "action_id + 100 AS action_id" if c == "action_id" else c for c in full.columns])
    trail = cases.audit_trail(full.unionByName(odd.select(
        *[odd[c].cast(full.schema[c].dataType).alias(c) for c in full.columns])))
    assert {r["action_id"] for r in trail.collect()} == {1, 2, 3, 4, 5, 6, 7, 101, 102, 103}


def small_survey(people):
    rows = [(f"R{i:02d}", f"E{i % 2}", "C1", "D1", 30 + i % 5, 100.0 * (i % 7),
             "employed" if i % 3 else "unemployed", 40) for i in range(40)]
    rows[7] = ("R07", "E1", "C1", "D1", 130, 99999.0, "employed", 190)
    return people(rows)


def test_bundles_fit_their_budget(spark, people):
    df = small_survey(people)
    rules, statistics = evaluate_rules(df).violations, evaluate_statistics(df)
    fused = fuse(record_ids(df), rules, statistics)
    stored = variable_profiles(df), entity_profiles(df, distributions=False)
    rows = {r["record_id"]: r for r in context.evidence_bundles(
        fused, rules, statistics, variables=stored[0], entities=stored[1]).collect()}
    body = json.loads(rows["R07"]["bundle"])
    assert body["unified_assessment"]["anomaly_status"] == "CONFIRMED"
    assert len(body["rule_evidence"]) == rows["R07"]["rule_evidence_n"] == 5
    assert {v["name"] for v in body["profile_context"]["variables"]} >= {"age", "income"}
    assert body["profile_context"]["enumerator"]["record_count"] == 20
    sizes = {}
    for budget in (5000, 3200, 1600, 300):
        row = context.evidence_bundles(
            fused, rules, statistics, variables=stored[0], entities=stored[1], max_bytes=budget
        ).where("record_id = 'R07'").first()
        sizes[budget] = row["trimmed"]
        assert row["bytes"] <= budget or row["trimmed"] == 3
        lists = json.loads(row["bundle"])
        if row["trimmed"] == 2:
            assert len(lists["rule_evidence"]) == 4 and len(lists["statistical_evidence"]) == 3
    assert sizes[300] == 3 and sorted(sizes.values()) == [
        sizes[b] for b in (5000, 3200, 1600, 300)]


def test_only_changed_bundles_come_back(spark):
    bundles = spark.createDataFrame(
        [(f"R{i}", f"b{i}", f"h{i}") for i in range(5)],
        "record_id string, bundle string, context_hash string")
    stored = spark.createDataFrame(
        [("R0", "available", "h0", 2), ("R1", "available", "old", 2),
         ("R2", "unavailable", "h2", 2), ("R3", "available", "h3", 1)],
        "record_id string, status string, context_hash string, run_id int")
    changed = context.changed_bundles(bundles, stored, 2)
    assert sorted(r["record_id"] for r in changed.collect()) == ["R1", "R2", "R3", "R4"]


def test_subjects(spark):
    rows = spark.createDataFrame(
        [("R1", "HIGH", 60.0, "NORMAL"), ("R2", "LOW", 5.0, "REVIEW"),
         ("R3", "CRITICAL", 90.0, "CONFIRMED"), ("R4", "LOW", 0.0, "NORMAL")],
        "record_id string, severity string, risk_score double, anomaly_status string")

    def ids(**kw):
        chosen, skipped = context.choose_subjects(rows, **kw)
        return [r["record_id"] for r in chosen.collect()], skipped.first()["skipped"]

    assert ids() == (["R3", "R1"], 0)
    assert ids(scope="detected") == (["R3", "R2"], 0)
    assert ids(scope="all", limit=1) == (["R3"], 3)
    assert ids(min_risk=50.0) == (["R3"], 0)
    assert ids(severity="LOW") == (["R2", "R4"], 0)


def test_batch_summary(spark, people):
    df = small_survey(people)
    parts = (dataset_profile(df), variable_profiles(df),
             entity_profiles(df, distributions=False), record_zscores(df))
    full = context.batch_summary("B1", *parts).first()
    body = json.loads(full["context"])
    assert body["dataset_context"]["record_count"] == 40
    assert len(body["important_variables"]) == 8
    assert body["record_feature_highlights"][0]["record_id"] == "R07"
    less = context.batch_summary("B1", *parts, max_bytes=full["bytes"] - 1).first()
    body = json.loads(less["context"])
    assert "record_feature_highlights" not in body and body["enumerator_context"]
    least = context.batch_summary("B1", *parts, max_bytes=100).first()
    assert json.loads(least["context"])["historical_context"]["priors"] == []


def test_forms_shuffle_lines_once(spark, monkeypatch):
    """Documents of one block need one shuffle and no second reading; cut ones say the same."""
    from plumbline.operators import form_lines

    cells = ["Record ID: 7", "Age", ":", "41", "Record ID: 7", "Sex: robot", "Income", "-", "-", "x", "ID: 8", ":"]
    rows = [(doc, i * step, 1, cell, 0.5 + i / 64) for doc, step in (("a", 1), ("b", 3), (None, 1))
            for i, cell in enumerate(cells)]
    frame = spark.createDataFrame(rows, "doc_id string, line_no long, page long, text string, score double")

    def found():
        got = read_forms(frame).drop("field_confidence", "field_confidence_band")
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return plan.count("Exchange hashpartitioning"), sorted(map(str, got.drop("page").collect()))

    exchanges, whole = found()
    assert exchanges == 1
    assert sum("Duplicate Record ID" in r for r in whole) == 4
    monkeypatch.setattr(form_lines, "LINES_PER_BLOCK", 16)  # "b" is cut, the others are not
    assert form_lines.long_documents(frame).collect() == [("b",)]
    assert found()[1] == whole
    monkeypatch.setattr(form_lines, "BROADCAST_ROWS", 0)
    assert found()[1] == whole
