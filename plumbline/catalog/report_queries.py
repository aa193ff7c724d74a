"""Roll-ups and reports over stored assessments.

The whole survey is assessed once; its records carry their batch (B1 to B3) and
run 2. B1 also has an older run 1 that every view must ignore.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.fusion_queries import THREE, stored_assessments, stored_detections
from plumbline.catalog.profile_queries import MISSING, WIDTH, rounded
from plumbline.catalog.detector_queries import EMPLOYED
from plumbline.catalog.views import (
    SVB, query, stored, survey_batch, survey_batches, with_,
)
from plumbline.operators import reports
from plumbline.operators.profile import entity_profiles

LABELLED = """, ab AS (SELECT fa.*, svb.batch_id FROM fa JOIN svb USING (record_id))"""
PARTS = (*THREE[:1], SVB, *THREE[1:])
CON = "anomaly_status = 'CONFIRMED'"


def sql(body: str, *extra: str) -> str:
    return with_(*PARTS) + LABELLED + "".join(f", {e}" for e in extra) + " " + body


def assessed_batches(spark, sf_dir):
    """Assessments with batch_id and run_id, older run included."""
    def build():
        batches = survey_batches(spark, sf_dir).select("record_id", "batch_id")
        current = stored_assessments(spark, sf_dir).join(batches, "record_id").withColumn(
            "run_id", F.lit(2))
        old = current.where("batch_id = 'B1'").withColumns({
            "run_id": F.lit(1), "severity": F.lit("CRITICAL"),
            "anomaly_status": F.lit("CONFIRMED")})
        return current.unionByName(old)

    return stored(spark, sf_dir, "assessed_batches", build)


def everything(spark, sf_dir):
    return reports.for_view(assessed_batches(spark, sf_dir), view="cumulative")


def batch_profiles(spark, sf_dir):
    """Entity profiles of every batch."""
    def build():
        parts = [entity_profiles(survey_batch(spark, sf_dir, b), distributions=False)
                 .withColumn("batch_id", F.lit(b)) for b in ("B1", "B2", "B3")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return stored(spark, sf_dir, "entity_profiles", build)


@query("overview_kpis", sql(f"""
 SELECT count(*) FILTER ({CON} AND severity = 'CRITICAL') AS critical,
  count(*) FILTER ({CON} AND severity = 'HIGH') AS high_risk,
  count(*) FILTER (anomaly_status = 'REVIEW') AS medium_risk, CAST(0 AS BIGINT) AS low_risk,
  count(*) FILTER (anomaly_status = 'REVIEW') AS review_signals,
  count(*) FILTER ({CON}) AS confirmed_anomalies, count(*) AS processed,
  count(*) - count(*) FILTER ({CON}) - count(*) FILTER (anomaly_status = 'REVIEW') AS clean,
  round(count(*) FILTER ({CON}) * 1.0 / count(*), 6) AS anomaly_rate,
  count(DISTINCT enumerator_id) AS enumerators,
  count(*) FILTER (intelligence_classification = 'VALIDATION_ERROR') AS validation_errors,
  count(*) FILTER (intelligence_classification = 'UNUSUAL_PATTERN') AS unusual_patterns,
  count(*) FILTER (intelligence_classification = 'INVESTIGATION_REQUIRED')
   AS investigation_required,
  (SELECT count(*) FROM det WHERE entity_type = 'enumerator') AS enumerator_alerts,
  (SELECT count(*) FROM det WHERE entity_type = 'cluster') AS cluster_alerts,
  (SELECT count(*) FROM det WHERE detector_type = 'TEMPORAL_CHANGE') AS temporal_alerts,
  (SELECT count(*) FROM det WHERE detector_type = 'GEOGRAPHIC_CLUSTER') AS geographic_alerts,
  (SELECT count(*) FROM det WHERE detector_type LIKE 'REL%') AS relationship_alerts FROM ab"""))
def _overview(spark, sf_dir):
    return rounded(reports.overview(everything(spark, sf_dir), stored_detections(spark, sf_dir)))


_QUEUE = """ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2
  ELSE 3 END, risk_score DESC, record_id"""
_ROW = ("batch_id", "record_id", "risk_score", "severity", "agreement", "anomaly_status",
        "enumerator_id", "cluster_id", "district_id", "primary_detector")


@query("anomaly_queue_page", sql(f"""SELECT {', '.join(_ROW)} FROM ab
 WHERE {CON} AND batch_id = 'B2' {_QUEUE} LIMIT 25 OFFSET 25"""))
def _queue(spark, sf_dir):
    rows = reports.for_view(assessed_batches(spark, sf_dir), "B2")
    return reports.queue_page(reports.filter_assessments(rows), 2).select(*_ROW)


@query("anomaly_queue_last_page", sql(f"""SELECT {', '.join(_ROW)} FROM (SELECT *,
  row_number() OVER ({_QUEUE}, batch_id) AS place, count(*) OVER () AS rows FROM ab WHERE batch_id = 'B2')
 WHERE place > (rows - 1) // 25 * 25"""))
def _last_page(spark, sf_dir):
    """The deepest page of a whole batch, clean records at equal risk included."""
    rows = reports.for_view(assessed_batches(spark, sf_dir), "B2")
    return reports.queue_page(rows, -(-rows.count() // reports.PAGE_SIZE)).select(*_ROW)


@query("anomaly_queue_filtered", sql(f"""SELECT {', '.join(_ROW)} FROM ab
 WHERE anomaly_status IN ('REVIEW', 'CONFIRMED') AND risk_score >= 20
  AND contains('|' || detectors || '|', '|REL_HOURS_EMPLOYMENT|')
  AND (contains(lower(record_id), 'r1') OR contains(lower(enumerator_id), 'r1')
   OR contains(lower(cluster_id), 'r1') OR contains(lower(district_id), 'r1'))"""))
def _filtered(spark, sf_dir):
    return reports.filter_assessments(
        everything(spark, sf_dir), scope="review_and_confirmed", min_risk_score=20, query="r1",
        detector_type="REL_HOURS_EMPLOYMENT", evidence_source="rules").select(*_ROW)


@query("anomaly_queue_baseline", sql(f"""SELECT {', '.join(_ROW)} FROM ab
 WHERE record_id IN (SELECT record_id FROM det WHERE baseline_type = 'district'
   AND record_id IS NOT NULL)
  OR enumerator_id IN (SELECT enumerator_id FROM det WHERE baseline_type = 'district'
   AND enumerator_id IS NOT NULL)
  OR cluster_id IN (SELECT cluster_id FROM det WHERE baseline_type = 'district'
   AND cluster_id IS NOT NULL)"""))
def _baseline(spark, sf_dir):
    return reports.filter_assessments(
        everything(spark, sf_dir), scope="all", baseline_type="district",
        detections=stored_detections(spark, sf_dir)).select(*_ROW)


@query("district_scope", sql(f"""SELECT {', '.join(_ROW)} FROM ab
 WHERE district_id IN ('D1', 'D3') AND anomaly_status = 'REVIEW'"""))
def _scope(spark, sf_dir):
    rows = reports.in_districts(everything(spark, sf_dir), ["D1", "D3"])
    return reports.filter_assessments(rows, scope="review").select(*_ROW)


def _profile_sql(scope: str, column: str) -> str:
    return f"""pr AS (SELECT id, sum(rate * n) / sum(n) AS missingness_rate FROM (
  SELECT batch_id, {column} AS id, count(*) AS n, sum({MISSING}) / (count(*) * {WIDTH}.0) AS rate
  FROM svb GROUP BY ALL) GROUP BY id)"""


def _rollup_sql(grain: str, column: str, where: str = "true") -> str:
    key = f"{grain}_id"
    cluster = ("CASE WHEN count(DISTINCT cluster_id) = 1 THEN min(cluster_id) END"
               if grain == "enumerator" else "CAST(NULL AS VARCHAR)")
    people = ("CAST(NULL AS BIGINT)" if grain == "enumerator"
              else "count(DISTINCT enumerator_id)")
    district = key if grain == "district" else "min_by(district_id, record_id)"
    return sql(f"""SELECT g.*, round(pr.missingness_rate, 6) AS missingness_rate FROM (
 SELECT {key} AS id, {district} AS district_id, {cluster} AS cluster_id, count(*) AS records,
  count(*) FILTER ({CON} AND severity = 'HIGH') AS high_risk,
  count(*) FILTER (anomaly_status = 'REVIEW') AS medium_risk,
  count(*) FILTER (anomaly_status = 'NORMAL') AS low_risk,
  count(*) FILTER ({CON} AND severity = 'CRITICAL') AS critical,
  round(count(*) FILTER ({CON} AND severity IN ('HIGH', 'CRITICAL')) * 1.0 / count(*), 6)
   AS anomaly_rate, {people} AS enumerators FROM ab WHERE {where} GROUP BY {key}) g
 LEFT JOIN pr USING (id)""", _profile_sql(grain, column))


def _rollup(grain):
    def run(spark, sf_dir):
        return rounded(reports.group_rows(
            everything(spark, sf_dir), grain, batch_profiles(spark, sf_dir)))
    return run


for _grain, _column in (("enumerator", "enumerator_id"), ("cluster", "cluster_id"),
                        ("district", "district_code")):
    query(f"group_rollup_{_grain}", _rollup_sql(_grain, _column))(_rollup(_grain))


@query("group_leaders", sql(f"""SELECT id, records FROM (
  SELECT *, rank() OVER (ORDER BY n DESC) AS place FROM (
  SELECT cluster_id AS id, count(*) AS records,
   count(*) FILTER (anomaly_status = 'REVIEW') AS n FROM ab GROUP BY cluster_id))
 WHERE place = 1"""))
def _leaders(spark, sf_dir):
    groups = reports.group_rows(everything(spark, sf_dir), "cluster")
    return reports.leaders(groups, "medium_risk").select("id", "records")


@query("group_parent_rollup", sql(f"""
 SELECT district_id, count(*) AS groups, CAST(sum(n) AS BIGINT) AS records,
  CAST(sum(h) AS BIGINT) AS high_risk, CAST(sum(c) AS BIGINT) AS critical,
  round(sum(h + c) * 1.0 / sum(n), 6) AS anomaly_rate FROM (
  SELECT cluster_id, min_by(district_id, record_id) AS district_id, count(*) AS n,
   count(*) FILTER ({CON} AND severity = 'HIGH') AS h,
   count(*) FILTER ({CON} AND severity = 'CRITICAL') AS c FROM ab GROUP BY cluster_id)
 GROUP BY district_id"""))
def _parent(spark, sf_dir):
    groups = reports.group_rows(everything(spark, sf_dir), "cluster")
    return rounded(reports.parent_rollup(groups).drop("missingness_rate"))


@query("cumulative_rollup", sql("""
 SELECT batch_id, count(*) AS records, count(*) FILTER (anomaly_status = 'CONFIRMED') AS confirmed,
  count(*) FILTER (anomaly_status = 'REVIEW') AS review FROM ab GROUP BY batch_id"""))
def _cumulative(spark, sf_dir):
    return everything(spark, sf_dir).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(reports.confirmed()).alias("confirmed"),
        F.count_if(reports.in_review()).alias("review"))


@query("batch_list", sql("""
 SELECT b.batch_id, records, confirmed, review FROM (
  SELECT batch_id, count(*) AS records FROM svb GROUP BY batch_id) b JOIN (
  SELECT batch_id, count(*) FILTER (anomaly_status = 'CONFIRMED') AS confirmed,
   count(*) FILTER (anomaly_status = 'REVIEW') AS review FROM ab GROUP BY batch_id) USING (batch_id)
 """))
def _batches(spark, sf_dir):
    batches = survey_batches(spark, sf_dir).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("records"), F.max("survey_round").alias("created_at"))
    rows = reports.batch_list(batches, assessed_batches(spark, sf_dir))
    return rows.select("batch_id", "records", "confirmed", "review")


@query("explorer_weighted_mean", with_(SVB) + f"""
 SELECT id, CAST(sum(n) AS BIGINT) AS record_count, round(sum(v * n) / sum(n), 6) AS value,
  round(sum(r * n) / sum(n), 6) AS employment_rate FROM (
  SELECT batch_id, district_code AS id, count(*) AS n, avg(income) AS v,
   avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END) AS r FROM svb GROUP BY ALL) GROUP BY id""")
def _explorer(spark, sf_dir):
    return rounded(reports.explorer(batch_profiles(spark, sf_dir), "income", "district"))


@query("explorer_national", with_(SVB) + """
 SELECT round(avg(v), 6) AS national FROM (
  SELECT id, sum(v * n) / sum(n) AS v FROM (
   SELECT batch_id, cluster_id AS id, count(*) AS n, avg(age) AS v FROM svb GROUP BY ALL)
  GROUP BY id)""")
def _national(spark, sf_dir):
    items = reports.explorer(batch_profiles(spark, sf_dir), "age", "cluster")
    return rounded(reports.national_value(items))


@query("enumerator_peers", with_(SVB) + f"""
 SELECT enumerator_id, round(avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END), 6) AS employment_rate,
  round(avg(income), 6) AS mean_income, count(*) AS record_count, enumerator_id = 'E3' AS highlight
 FROM svb WHERE batch_id = 'B2' GROUP BY enumerator_id""")
def _peers(spark, sf_dir):
    profiles = batch_profiles(spark, sf_dir).where("batch_id = 'B2'")
    return rounded(reports.enumerator_peers(profiles, "E3"))


@query("entity_page_detections", sql("""
 SELECT detector_type, count(*) AS detections FROM det
 WHERE enumerator_id = 'E3' OR (entity_type = 'enumerator' AND entity_id = 'E3')
 GROUP BY detector_type"""))
def _entity_page(spark, sf_dir):
    _, linked = reports.entity_page(batch_profiles(spark, sf_dir),
                                    stored_detections(spark, sf_dir), "enumerator", "E3")
    return linked.groupBy("detector_type").agg(F.count(F.lit(1)).alias("detections"))


def _page(grain: str, entity: str):
    def run(spark, sf_dir):
        profile, linked = reports.entity_page(batch_profiles(spark, sf_dir).where("batch_id = 'B2'"),
                                              stored_detections(spark, sf_dir), grain, entity)
        found = linked.groupBy("detector_type").agg(F.count(F.lit(1)).alias("detections"))
        return found.join(profile.select("id", "record_count"), F.lit(True), "left")
    return run


query("cluster_page_detections", sql("""SELECT detector_type, count(*) AS detections, 'C3' AS id,
  (SELECT count(*) FROM svb WHERE batch_id = 'B2' AND cluster_id = 'C3') AS record_count
 FROM det WHERE cluster_id = 'C3' OR (entity_type = 'cluster' AND entity_id = 'C3')
 GROUP BY detector_type"""))(_page("cluster", "C3"))


@query("detections_by_view", sql("""SELECT detector_type, record_id FROM det JOIN svb USING (record_id)
 WHERE batch_id = 'B1'"""))
def _detections_view(spark, sf_dir):
    """Detections of the newest run of a batch; an older run with all of them again is left out."""
    batches = survey_batches(spark, sf_dir).select("record_id", "batch_id")
    now = stored_detections(spark, sf_dir).select("detector_type", "record_id").join(batches, "record_id").withColumn(
        "run_id", F.lit(2))
    old = now.withColumns({"run_id": F.lit(1), "detector_type": F.lit("OLD")})
    return reports.for_view(now.unionByName(old), "B1").select("detector_type", "record_id")


@query("group_listing", sql(f"""SELECT cluster_id AS id, count(*) AS records, row_number() OVER (ORDER BY
  count(*) FILTER ({CON} AND severity IN ('HIGH', 'CRITICAL')) DESC, count(*) DESC, cluster_id) AS place
 FROM ab GROUP BY cluster_id"""))
def _listing(spark, sf_dir):
    """Groups in listing order; a group is a row of at most one per cluster."""
    from pyspark.sql import Window

    groups = reports.group_rows(everything(spark, sf_dir), "cluster")
    place = F.row_number().over(Window.orderBy(*reports.group_order()))
    return groups.select("id", "records", place.cast("bigint").alias("place"))


@query("group_detail_records", sql(f"""SELECT {', '.join(_ROW)} FROM ab
 WHERE {CON} AND cluster_id = 'C3'"""))
def _group_detail(spark, sf_dir):
    rows, _ = reports.group_detail(everything(spark, sf_dir), "cluster", "C3")
    return rows.select(*_ROW)


@query("group_common_sources", sql(f"""
 SELECT unnest(['rules', 'statistics']) AS source, records FROM (
  SELECT count(*) AS records FROM ab WHERE {CON})"""))
def _common(spark, sf_dir):
    return reports.common_sources(everything(spark, sf_dir))


def _report_row(where: str) -> str:
    return sql(f"""SELECT batch_id, record_id, risk_score, severity, anomaly_status,
  confidence AS evidence_confidence, agreement, enumerator_id, cluster_id, district_id,
  'rules|statistics' AS available_sources, CASE WHEN anomaly_status = 'NORMAL' THEN 'not_required'
  ELSE 'not_generated' END AS explanation_status FROM ab WHERE {where}""")


def _report(kind, *drop):
    def run(spark, sf_dir):
        table = reports.report(kind, everything(spark, sf_dir), "now", "v1",
                               batch_profiles(spark, sf_dir))
        return rounded(table.drop("report_type", "generated_at", "methodology_version", *drop))
    return run


query("report_anomalies", _report_row(CON))(_report("anomalies"))
query("report_batch", _report_row("true"))(_report("batch"))
query("report_enumerators", _rollup_sql("enumerator", "enumerator_id").replace(
    "SELECT g.*,", "SELECT g.id AS enumerator_id, district_id, records, high_risk, medium_risk, "
    "anomaly_rate,"))(_report("enumerators"))
query("report_districts", _rollup_sql("district", "district_code").replace(
    "SELECT g.*, round(pr.missingness_rate, 6) AS missingness_rate",
    "SELECT g.id AS district_id, records, high_risk, anomaly_rate, enumerators"))(
    _report("districts"))


@query("anomaly_summary", sql("""
 SELECT (SELECT count(*) FROM det) AS total,
  (SELECT count(*) FROM det WHERE severity = 'HIGH') AS high,
  (SELECT count(*) FROM det WHERE severity = 'MEDIUM') AS medium,
  (SELECT count(*) FROM det WHERE severity IN ('LOW', 'NONE')) AS low,
  count(*) FILTER (intelligence_classification = 'VALIDATION_ERROR') AS validation_errors,
  count(*) FILTER (intelligence_classification = 'UNUSUAL_PATTERN')
   + (SELECT count(*) FROM det) AS unusual_patterns,
  count(*) FILTER (intelligence_classification = 'INVESTIGATION_REQUIRED')
   AS investigation_required,
  count(*) FILTER (intelligence_classification = 'INFORMATIONAL') AS informational FROM ab"""))
def _anomaly_summary(spark, sf_dir):
    return reports.anomaly_summary(everything(spark, sf_dir), stored_detections(spark, sf_dir))


@query("detection_counts", sql("""
 SELECT 'detector' AS kind, detector_type AS value, count(*) AS detections FROM det GROUP BY ALL
 UNION ALL SELECT 'entity', entity_type, count(*) FROM det GROUP BY ALL
 UNION ALL SELECT 'severity', severity, count(*) FROM det GROUP BY ALL"""))
def _counts(spark, sf_dir):
    return reports.detection_counts(stored_detections(spark, sf_dir))


@query("detector_distributions", sql("""
 SELECT 'risk' AS kind, severity AS value, count(*) AS records FROM ab GROUP BY ALL
 UNION ALL SELECT 'classification', anomaly_status, count(*) FROM ab GROUP BY ALL"""))
def _spread(spark, sf_dir):
    return reports.detector_analytics(everything(spark, sf_dir),
                                      stored_detections(spark, sf_dir))[0]


@query("record_detail", sql("""
 SELECT source, code, level FROM (
  SELECT 'rules' AS source, rule_code AS code, severity AS level FROM rv WHERE record_id = 'R97'
  UNION ALL SELECT 'statistics', detector, severity FROM st WHERE record_id = 'R97'
  UNION ALL SELECT 'intelligence', detector_type, severity FROM det
   WHERE record_id = 'R97'
    OR enumerator_id = (SELECT enumerator_id FROM sv WHERE record_id = 'R97')
    OR cluster_id = (SELECT cluster_id FROM sv WHERE record_id = 'R97'))"""))
def _record_detail(spark, sf_dir):
    from plumbline.catalog.fusion_queries import rules_found, statistics_found
    from plumbline.operators.forest import EVIDENCE
    from plumbline.plans.lookup import empty_frame

    return reports.record_detail(
        stored_assessments(spark, sf_dir), "R97", rules_found(spark, sf_dir),
        statistics_found(spark, sf_dir), empty_frame(spark, EVIDENCE),
        stored_detections(spark, sf_dir)).select("source", "code", "level")
