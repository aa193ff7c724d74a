"""Fused assessments over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.detector_queries import ALL, WEEKLY
from plumbline.catalog.profile_queries import LONG, MEASURES, rounded
from plumbline.catalog.rule_queries import RULES
from plumbline.catalog.statistic_queries import (
    EVIDENCE, GROUP, IQR, SENSITIVE, Z, baseline_log,
)
from plumbline.catalog.views import (
    REFERENCES, SV, SVB, query, stored, survey, survey_batch, with_,
)
from plumbline.operators.detectors.run import run_detectors
from plumbline.operators.forest import forest_summary, run_forest
from plumbline.operators.fusion import (
    classification_trace, dataset_context, fuse, fusion_summary, record_ids,
)
from plumbline.operators.rules import evaluate_rules
from plumbline.operators.statistics import (
    batch_baselines, historical_shift, latest_baselines, record_evidence,
)

_RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"
_NAME = "CASE {0} WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' " \
        "WHEN 1 THEN 'LOW' ELSE 'NONE' END"
_RULE_SCORE = "CASE severity WHEN 'LOW' THEN 25e0 WHEN 'MEDIUM' THEN 50e0 WHEN 'HIGH' THEN 80e0 " \
              "ELSE 100e0 END"
_STAT_SCORE = "CASE severity WHEN 'LOW' THEN 30e0 WHEN 'MEDIUM' THEN 60e0 WHEN 'HIGH' THEN 90e0 " \
              "ELSE 100e0 END"
_HARD = ("'AGE_MIN', 'AGE_MAX', 'WORKING_HOURS_MIN', 'WORKING_HOURS_MAX', "
         "'INCOME_NON_NEGATIVE', 'HOUSEHOLD_SIZE_MIN', 'EMPLOYED_HAS_HOURS', "
         "'UNEMPLOYED_ZERO_HOURS', 'RESPONDENT_ID_REQUIRED', 'ENUMERATOR_REQUIRED', "
         "'CLUSTER_REQUIRED', 'DISTRICT_REQUIRED'")
FUSED = f"""rr AS (SELECT record_id, count(*) AS n, max(sc) AS mx, sum(sc) AS sm, max(rk) AS lv,
   string_agg(rule_code, '|' ORDER BY rule_code) AS codes,
   bool_or(rule_code IN ({_HARD})) AS hard
   FROM (SELECT *, {_RULE_SCORE} AS sc, {_RANK} AS rk FROM rv) GROUP BY record_id),
 ss AS (SELECT record_id, count(*) AS n, max(sc) AS mx, sum(sc) AS sm, max(rk) AS lv
   FROM (SELECT *, {_STAT_SCORE} AS sc, {_RANK} AS rk FROM st) GROUP BY record_id),
 f0 AS (SELECT sv.record_id, sv.enumerator_id, sv.cluster_id, sv.district_code AS district_id,
   CASE WHEN rr.mx IS NULL THEN 0e0 ELSE least(100e0, rr.mx + 0.2e0 * (rr.sm - rr.mx)) END AS rs,
   CASE WHEN ss.mx IS NULL THEN 0e0 ELSE least(100e0, ss.mx + 0.2e0 * (ss.sm - ss.mx)) END AS s2,
   coalesce(rr.lv, 0) AS rl, coalesce(ss.lv, 0) AS sl, coalesce(rr.codes, '') AS rule_codes,
   coalesce(rr.hard, false) AS hard, coalesce(rr.n, 0) AS rule_n, coalesce(ss.n, 0) AS stat_n
   FROM sv LEFT JOIN rr USING (record_id) LEFT JOIN ss USING (record_id)),
 f1 AS (SELECT *, rs * (0.4e0 / 0.75e0) + s2 * (0.35e0 / 0.75e0) AS risk,
   CAST(rl >= 3 AS INT) + CAST(sl >= 3 AS INT) >= 2 AS escalation_applied FROM f0),
 f2 AS (SELECT *, CASE WHEN escalation_applied OR greatest(rs, s2) = 0 THEN 'strong'
    WHEN greatest(rs, s2) - least(rs, s2) > 40 THEN 'mixed' ELSE 'moderate' END AS agreement,
   CASE WHEN risk >= 75 THEN 'CRITICAL' WHEN risk >= 50 OR escalation_applied THEN 'HIGH'
    WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM f1),
 fused AS (SELECT record_id, enumerator_id, cluster_id, district_id,
   round_even(CASE WHEN escalation_applied THEN greatest(risk, 50e0) ELSE risk END, 2)
    AS risk_score, severity,
   CAST(70 + CASE agreement WHEN 'strong' THEN 8 WHEN 'mixed' THEN -22 ELSE 4 END AS DOUBLE)
    AS confidence, agreement, round_even(rs, 2) AS rules_score,
   round_even(s2, 2) AS statistics_score, {_NAME.format('rl')} AS rules_severity,
   {_NAME.format('sl')} AS statistics_severity, escalation_applied, rule_codes, rule_n, stat_n,
   CASE WHEN hard THEN 'CONFIRMED' WHEN stat_n > 0 THEN 'REVIEW' ELSE 'NORMAL' END
    AS anomaly_status,
   CASE WHEN hard THEN 'hard_rule_violation' WHEN stat_n > 0 THEN 'statistics_only_unusual'
    WHEN rule_codes LIKE '%IN_REFERENCE%' THEN 'demo_reference_list_miss' ELSE 'none' END
    AS classification_reason FROM f2)"""
_SEQ = "(family, step, position, number)"


def _types(role: str, name: str) -> str:
    return f"""{name} AS (SELECT {role}, list(detector_type ORDER BY q) AS types FROM (
   SELECT {role}, detector_type, min({_SEQ}) AS q FROM det WHERE {role} IS NOT NULL GROUP BY ALL)
   GROUP BY {role})"""


ATTACHED = ", ".join((
    _types("record_id", "t_rec"), _types("enumerator_id", "t_enum"),
    _types("cluster_id", "t_clus"))) + """,
 fd AS (SELECT fused.*, coalesce(t_rec.types, []) || coalesce(t_enum.types, [])
   || coalesce(t_clus.types, []) AS l FROM fused LEFT JOIN t_rec USING (record_id)
   LEFT JOIN t_enum USING (enumerator_id) LEFT JOIN t_clus USING (cluster_id)),
 fe AS (SELECT * EXCLUDE (l), list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM fd),
 fa AS (SELECT * EXCLUDE (d), array_to_string(d, '|') AS detectors,
   CASE WHEN anomaly_status = 'CONFIRMED' THEN 'VALIDATION_ERROR'
    WHEN anomaly_status = 'REVIEW' AND len(d) >= 2 THEN 'INVESTIGATION_REQUIRED'
    WHEN anomaly_status = 'REVIEW' THEN 'UNUSUAL_PATTERN' ELSE 'INFORMATIONAL' END
    AS intelligence_classification,
   CASE WHEN anomaly_status = 'CONFIRMED' THEN 'HARD_RULE'
    WHEN anomaly_status = 'REVIEW' THEN coalesce(d[1], 'STATISTICAL_OUTLIER') ELSE d[1] END
    AS primary_detector,
   CASE WHEN anomaly_status = 'CONFIRMED' THEN len(d) + 1
    WHEN anomaly_status = 'REVIEW' THEN greatest(len(d), 1) ELSE len(d) END AS detector_count,
   anomaly_status IN ('CONFIRMED', 'REVIEW') AS review_required FROM fe)"""
TWO = (SV, LONG, Z, IQR, GROUP, EVIDENCE, RULES, FUSED)
THREE = (*TWO, WEEKLY, ALL, ATTACHED)
BASE = ("record_id", "enumerator_id", "cluster_id", "district_id", "risk_score", "severity",
        "confidence", "agreement", "rules_score", "statistics_score", "rules_severity",
        "statistics_severity", "escalation_applied", "rule_codes", "anomaly_status",
        "classification_reason")
MORE = ("detectors", "intelligence_classification", "primary_detector", "detector_count",
        "review_required")


def flat(assessments):
    """Assessments with maps and lists as plain columns."""
    refs = F.col("evidence_refs")
    return assessments.select(
        "record_id", "enumerator_id", "cluster_id", "district_id", "risk_score", "severity",
        "confidence", "agreement",
        F.try_element_at("source_scores", F.lit("rules")).alias("rules_score"),
        F.try_element_at("source_scores", F.lit("statistics")).alias("statistics_score"),
        F.try_element_at("source_severities", F.lit("rules")).alias("rules_severity"),
        F.try_element_at("source_severities", F.lit("statistics")).alias("statistics_severity"),
        "escalation_applied", F.concat_ws("|", refs["rule_codes"]).alias("rule_codes"),
        "anomaly_status", "classification_reason",
        F.concat_ws("|", refs["detectors"]).alias("detectors"), "intelligence_classification",
        "primary_detector", "detector_count", "review_required")


def rules_found(spark, sf_dir):
    return evaluate_rules(survey(spark, sf_dir), references=REFERENCES).violations


def statistics_found(spark, sf_dir):
    return record_evidence(survey(spark, sf_dir))


def stored_rules(spark, sf_dir):
    """Broken rules as a run stores them: assessments and bundles read the same rows."""
    return stored(spark, sf_dir, "rule_violations", lambda: rules_found(spark, sf_dir))


def stored_statistics(spark, sf_dir):
    return stored(spark, sf_dir, "statistical_evidence", lambda: statistics_found(spark, sf_dir))


def two_sources(spark, sf_dir):
    return fuse(record_ids(survey(spark, sf_dir)), rules_found(spark, sf_dir),
                statistics_found(spark, sf_dir))


def assessed(spark, sf_dir):
    """Rules, statistics and detectors fused."""
    df = survey(spark, sf_dir)
    return fuse(record_ids(df), stored_rules(spark, sf_dir), stored_statistics(spark, sf_dir),
                detections=stored_detections(spark, sf_dir))


def stored_assessments(spark, sf_dir):
    return stored(spark, sf_dir, "assessments", lambda: assessed(spark, sf_dir))


def stored_detections(spark, sf_dir):
    return stored(spark, sf_dir, "detections",
                  lambda: run_detectors(survey(spark, sf_dir)).detections)


@query("fusion_assessments", with_(*TWO) + f" SELECT {', '.join(BASE)} FROM fused")
def _assessments(spark, sf_dir):
    return flat(two_sources(spark, sf_dir)).select(*BASE)


@query("fusion_with_detections", with_(*THREE) + f" SELECT {', '.join(BASE + MORE)} FROM fa")
def _with_detections(spark, sf_dir):
    return flat(assessed(spark, sf_dir))


@query("fusion_rules_only", with_(SV, RULES, f"""r AS (SELECT record_id, max(sc) AS mx,
   sum(sc) AS sm FROM (SELECT record_id, {_RULE_SCORE} AS sc FROM rv) GROUP BY record_id)""") + """
 SELECT record_id, round_even(CASE WHEN mx IS NULL THEN 0e0 ELSE least(100e0, mx + 0.2e0 * (sm - mx)) END, 2) AS risk_score,
  'single_source' AS agreement, CAST(45.0 AS DOUBLE) AS confidence
 FROM sv LEFT JOIN r USING (record_id)""")
def _rules_only(spark, sf_dir):
    fused = fuse(record_ids(survey(spark, sf_dir)), rules_found(spark, sf_dir))
    return fused.select("record_id", "risk_score", "agreement", "confidence")


@query("fusion_summary", with_(*TWO) + """
 SELECT count(*) AS records_assessed, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low,
  count(*) FILTER (anomaly_status = 'CONFIRMED') AS confirmed_anomalies,
  count(*) FILTER (anomaly_status = 'REVIEW') AS review_signals FROM fused""")
def _summary(spark, sf_dir):
    return fusion_summary(two_sources(spark, sf_dir))


@query("classification_matrix", with_(*THREE) + """
 SELECT anomaly_status, classification_reason, intelligence_classification, primary_detector,
  count(*) AS records FROM fa GROUP BY ALL""")
def _matrix(spark, sf_dir):
    return stored_assessments(spark, sf_dir).groupBy(
        "anomaly_status", "classification_reason", "intelligence_classification",
        "primary_detector").agg(F.count(F.lit(1)).alias("records"))


@query("classification_trace", with_(*TWO) + """
 SELECT record_id, risk_score, severity, rule_n > 0 AS rule_signal, stat_n > 0 AS statistics_signal,
  false AS ml_signal, agreement, anomaly_status, classification_reason AS anomaly_reason,
  rule_codes FROM fused""")
def _trace(spark, sf_dir):
    rows = classification_trace(stored_assessments(spark, sf_dir))
    return rows.withColumn("rule_codes", F.concat_ws("|", "rule_codes"))


@query("detections_attached", with_(*THREE)
       + " SELECT record_id, detectors, detector_count FROM fa WHERE detectors <> ''")
def _attached(spark, sf_dir):
    rows = flat(stored_assessments(spark, sf_dir))
    return rows.where(F.col("detectors") != "").select("record_id", "detectors", "detector_count")


# One label per order line: many lines share an order, so ids repeat.
_LINES = """SELECT CAST(l_orderkey AS {text}) AS record_id,
 concat('S', CAST(l_suppkey % 10 AS {text})) AS enumerator_id, l_quantity, l_discount
 FROM {lineitem}"""


@query("fusion_repeated_ids", f"""
 WITH l AS ({_LINES.format(text='VARCHAR', lineitem='lineitem')}),
 v AS (SELECT record_id, enumerator_id, 80e0 AS sc FROM l WHERE l_quantity > 45
   UNION ALL SELECT record_id, enumerator_id, 50e0 FROM l WHERE l_discount > 0.08),
 r AS (SELECT record_id, count(*) AS rule_n, max(sc) AS mx, sum(sc) AS sm,
   min(enumerator_id) AS e FROM v GROUP BY record_id),
 a AS (SELECT record_id, min(enumerator_id) AS e FROM l GROUP BY record_id)
 SELECT record_id, coalesce(r.e, a.e) AS enumerator_id, coalesce(rule_n, 0) AS rule_n,
  round_even(CASE WHEN mx IS NULL THEN 0e0 ELSE least(100e0, mx + 0.2e0 * (sm - mx)) END, 2) AS risk_score
 FROM a LEFT JOIN r USING (record_id)""")
def _repeated(spark, sf_dir):
    from plumbline.catalog.views import table
    from plumbline.operators.rules import Rule

    df = spark.sql(_LINES.format(text="STRING", lineitem="{lineitem}"),
                   lineitem=table(spark, sf_dir, "lineitem"))
    found = evaluate_rules(df, [
        Rule("QUANTITY", "l_quantity", "less_than_or_equal", 45, severity="HIGH"),
        Rule("DISCOUNT", "l_discount", "less_than_or_equal", 0.08, severity="MEDIUM")], {})
    fused = fuse(record_ids(df), found.violations)
    return fused.select("record_id", "enumerator_id",
                        F.col("evidence_refs.rule_violations").alias("rule_n"), "risk_score")


@query("fusion_dataset_context", with_(SVB, "l AS (" + " UNION ALL ".join(
    f"SELECT batch_id, '{m}' AS variable, CAST({m} AS DOUBLE) AS value FROM svb"
    for m in MEASURES) + """),
 s AS (SELECT batch_id, variable, avg(value) AS m, stddev_samp(value) AS sd FROM l GROUP BY ALL),
 d AS (SELECT CASE WHEN abs((c.m - p.m) / p.sd) >= 0.02 THEN 90e0 ELSE 60e0 END AS sc
   FROM s c JOIN s p USING (variable) WHERE c.batch_id = 'B3' AND p.batch_id = 'B2'
   AND abs((c.m - p.m) / p.sd) >= 0.001)""") + """
 SELECT 'dataset' AS scope,
  round_even(least(100e0, max(sc) + 0.2e0 * (sum(sc) - max(sc))), 2) AS context_score,
  CASE WHEN max(sc) >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CAST(49.0 AS DOUBLE) AS confidence, 'single_source' AS agreement, count(*) AS evidence
 FROM d HAVING count(*) > 0""")
def _context(spark, sf_dir):
    current = survey_batch(spark, sf_dir, "B3")
    shift = historical_shift(batch_baselines(current, list(MEASURES)),
                             latest_baselines(baseline_log(spark, sf_dir), "B3"), SENSITIVE)
    found = record_evidence(current).unionByName(shift)
    return dataset_context(found, history=True).select(
        "scope", "context_score", "severity", "confidence", "agreement", "evidence")


# --- forest: no SQL says it; tested by its properties --------------------------

@query("forest_scores")
def _forest_scores(spark, sf_dir):
    run = run_forest(survey(spark, sf_dir))
    return rounded(run.scores.select("record_id", "raw", "anomaly_score", "anomalous"))


@query("forest_summary")
def _forest_summary(spark, sf_dir):
    df = survey(spark, sf_dir)
    return forest_summary(df, run_forest(df))


@query("forest_from_history")
def _forest_history(spark, sf_dir):
    """B3 scored by a forest trained on the two earlier batches."""
    past = survey_batch(spark, sf_dir, "B1").unionByName(survey_batch(spark, sf_dir, "B2"))
    run = run_forest(survey_batch(spark, sf_dir, "B3"), past)
    return rounded(run.evidence.select(
        "record_id", "anomaly_score", "raw_model_score", "severity", "training_source",
        "training_records"))


@query("fusion_three_sources")
def _three(spark, sf_dir):
    df = survey(spark, sf_dir)
    fused = fuse(record_ids(df), rules_found(spark, sf_dir), statistics_found(spark, sf_dir),
                 run_forest(df).evidence)
    return flat(fused)
