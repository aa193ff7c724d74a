"""Context bundles, cases, form lines and label evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.fusion_queries import (
    THREE, TWO, stored_assessments, stored_rules, stored_statistics,
)
from plumbline.catalog.profile_queries import MEASURES, MISSING, WIDTH, rounded
from plumbline.catalog.views import SV, query, stored, survey, table, with_
from plumbline.operators import cases, context
from plumbline.operators.evaluate import confusion, evaluation_report
from plumbline.operators.form_lines import preview, read_forms
from plumbline.operators.profile import (
    dataset_profile, entity_profiles, record_zscores, variable_profiles,
)

# --- context bundles ----------------------------------------------------------


def bundles(spark, sf_dir, max_bytes=16384):
    df = survey(spark, sf_dir)
    return context.evidence_bundles(
        stored_assessments(spark, sf_dir), stored_rules(spark, sf_dir),
        stored_statistics(spark, sf_dir), variables=variable_profiles(df),
        entities=entity_profiles(df, distributions=False), max_bytes=max_bytes)


def stored_bundles(spark, sf_dir):
    return stored(spark, sf_dir, "bundles", lambda: bundles(spark, sf_dir))


@query("context_bundles", with_(*TWO) + """
 SELECT record_id, rule_n AS rule_evidence_n, stat_n AS statistical_evidence_n,
  0 AS trimmed, rule_n = 0 AND stat_n = 0 AS no_detected_evidence FROM fused""")
def _bundles(spark, sf_dir):
    return stored_bundles(spark, sf_dir).select(
        "record_id", "rule_evidence_n", "statistical_evidence_n", "trimmed",
        "no_detected_evidence")


@query("context_budget")
def _budget(spark, sf_dir):
    return bundles(spark, sf_dir, 1800).groupBy("trimmed").agg(
        F.count(F.lit(1)).alias("records"), F.max("bytes").alias("largest"))


@query("context_batch_summary")
def _batch_summary(spark, sf_dir):
    df = survey(spark, sf_dir)
    return context.batch_summary(
        "B0", dataset_profile(df), variable_profiles(df),
        entity_profiles(df, distributions=False), record_zscores(df))


@query("explanation_cache_changes", with_(SV) + """
 SELECT record_id FROM sv WHERE CAST(substr(record_id, 2) AS BIGINT) % 5 = 0
  OR CAST(substr(record_id, 2) AS BIGINT) % 7 = 0 OR CAST(substr(record_id, 2) AS BIGINT) % 9 = 0""")
def _cache(spark, sf_dir):
    """Stored explanations of which some are stale, failed or of an older run."""
    found = stored_bundles(spark, sf_dir)
    number = F.substring("record_id", 2, 20).cast("bigint")
    known = found.select(
        "record_id",
        F.when(number % 9 == 0, "unavailable").otherwise("available").alias("status"),
        F.when(number % 5 == 0, "stale").otherwise(F.col("context_hash")).alias("context_hash"),
        F.when(number % 7 == 0, 1).otherwise(2).alias("run_id"))
    return context.changed_bundles(found, known, 2).select("record_id")


_SUBJECT_ORDER = """CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2
  ELSE 3 END, risk_score DESC, record_id"""


@query("context_subjects", with_(*TWO) + f"""
 SELECT record_id, severity, risk_score FROM fused
 WHERE anomaly_status IN ('CONFIRMED', 'REVIEW') ORDER BY {_SUBJECT_ORDER} LIMIT 200""")
def _subjects(spark, sf_dir):
    chosen, _ = context.choose_subjects(stored_assessments(spark, sf_dir), "detected", limit=200)
    return chosen.select("record_id", "severity", "risk_score")


@query("context_subjects_skipped", with_(*TWO) + """
 SELECT greatest(0, count(*) - 20) AS skipped FROM fused WHERE severity IN ('HIGH', 'CRITICAL')""")
def _skipped(spark, sf_dir):
    return context.choose_subjects(stored_assessments(spark, sf_dir))[1]


@query("context_ranked_groups", with_(SV) + f"""
 SELECT cluster_id AS id, count(*) AS record_count,
  round(sum({MISSING}) / (count(*) * {WIDTH}.0), 6) AS missingness_rate FROM sv
 GROUP BY cluster_id ORDER BY sum({MISSING}) / (count(*) * {WIDTH}.0) DESC, 2 DESC, 1 LIMIT 10""")
def _ranked(spark, sf_dir):
    groups = entity_profiles(survey(spark, sf_dir), distributions=False)
    return rounded(context.ranked_groups(groups, "cluster").select(
        "id", "record_count", "missingness_rate"))


_ABS = ", ".join(f"abs(({m} - (SELECT avg({m}) FROM sv)) / (SELECT stddev_pop({m}) FROM sv))"
                 for m in MEASURES)


@query("context_record_highlights", with_(SV, f"""h AS (SELECT record_id, {MISSING} AS m,
  greatest({_ABS}) AS z FROM sv)""") + """
 SELECT record_id, round(z, 6) AS size, CAST(m AS BIGINT) AS missing_count FROM h
 ORDER BY coalesce(z, 0) DESC, m DESC, record_id LIMIT 5""")
def _highlights(spark, sf_dir):
    rows = context.record_highlights(record_zscores(survey(spark, sf_dir)))
    return rows.select("record_id", F.round(F.abs("z"), 6).alias("size"), "missing_count")


# --- cases: a log of actions on every order -----------------------------------

_ACTIONS = """
 SELECT o_orderkey * 4 AS action_id, 'B' AS batch_id, concat('O', CAST(o_orderkey AS {text}))
   AS record_id, o_orderdate AS ts, 'ann' AS user, 'CREATE' AS action,
   CAST(NULL AS {text}) AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' END AS priority,
   'ann' AS assigned_to, CAST(NULL AS {text}) AS note FROM {orders}
 UNION ALL SELECT o_orderkey * 4 + 1, 'B', concat('O', CAST(o_orderkey AS {text})),
   o_orderdate + INTERVAL 1 DAY, 'bob', CASE o_orderkey % 6 WHEN 0 THEN 'REVIEW'
    WHEN 1 THEN 'VERIFY_SOURCE' WHEN 2 THEN 'REQUEST_REENUMERATION' WHEN 3 THEN 'ESCALATE'
    WHEN 4 THEN 'MARK_VALID' ELSE 'MARK_INVALID' END, NULL, NULL, NULL, 'looked' FROM {orders}
 UNION ALL SELECT o_orderkey * 4 + 2, 'B', concat('O', CAST(o_orderkey AS {text})),
   o_orderdate + INTERVAL 2 DAY, 'cy', 'CREATE', NULL, 'LOW', 'cy', NULL FROM {orders}
   WHERE o_orderstatus = 'P'
 UNION ALL SELECT o_orderkey * 4 + 3, 'B', concat('O', CAST(o_orderkey AS {text})),
   o_orderdate + INTERVAL 3 DAY, 'bob', CASE o_orderkey % 4 WHEN 0 THEN 'MARK_VALID'
    WHEN 1 THEN 'ADD_NOTE' WHEN 2 THEN 'UPDATE' ELSE 'MARK_INVALID' END,
   CASE WHEN o_orderkey % 4 = 2 THEN 'OPEN' END, NULL, NULL,
   CASE WHEN o_orderkey % 4 = 1 THEN 'note' END FROM {orders}"""
CASES = f"""log0 AS ({_ACTIONS.format(text='VARCHAR', orders='orders')}),
 log AS (SELECT *, CASE WHEN action = 'CREATE' THEN 'OPEN'
   WHEN action IN ('REVIEW', 'VERIFY_SOURCE') THEN 'IN_REVIEW'
   WHEN action = 'REQUEST_REENUMERATION' THEN 'REQUIRES_REENUMERATION'
   WHEN action = 'ESCALATE' THEN 'ESCALATED' WHEN action = 'MARK_VALID' THEN 'RESOLVED_VALID'
   WHEN action = 'MARK_INVALID' THEN 'RESOLVED_INVALID' WHEN action = 'UPDATE' THEN status END
   AS ns FROM log0 WHERE NOT (action = 'CREATE' AND user = 'cy')),
 heads AS (SELECT record_id, arg_max(ns, ts) FILTER (ns IS NOT NULL) AS status,
   arg_max(priority, ts) FILTER (priority IS NOT NULL) AS asked, count(*) AS actions,
   arg_max(action, ts) FILTER (action NOT IN ('CREATE', 'UPDATE', 'ADD_NOTE')) AS action,
   max(ts) FILTER (ns IS NOT NULL AND ns NOT LIKE 'RESOLVED%') AS reopened FROM log
   GROUP BY record_id),
 done AS (SELECT record_id, min(ts) AS resolved_at FROM log JOIN heads USING (record_id)
   WHERE ns LIKE 'RESOLVED%' AND (reopened IS NULL OR ts > reopened) GROUP BY record_id),
 now AS (SELECT record_id, status, coalesce(asked, 'MEDIUM') AS priority, action, actions,
   strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at
   FROM heads LEFT JOIN done USING (record_id))"""


def case_log(spark, sf_dir):
    return spark.sql(_ACTIONS.format(text="STRING", orders="{orders}"),
                     orders=table(spark, sf_dir, "orders"))


def stored_cases(spark, sf_dir):
    return stored(spark, sf_dir, "cases",
                  lambda: cases.current_cases(case_log(spark, sf_dir)))


@query("case_current_state", with_(CASES) + " SELECT * FROM now")
def _cases(spark, sf_dir):
    return stored_cases(spark, sf_dir).select(
        "record_id", "status", "priority", "action", "actions",
        F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at"))


@query("case_status_counts", with_(CASES) + """
 , s AS (SELECT unnest(['OPEN', 'IN_REVIEW', 'REQUIRES_REENUMERATION', 'ESCALATED',
   'RESOLVED_VALID', 'RESOLVED_INVALID']) AS status)
 SELECT s.status, count(now.status) AS cases FROM s LEFT JOIN now USING (status) GROUP BY s.status
 UNION ALL SELECT 'resolved', count(*) FROM now WHERE status LIKE 'RESOLVED%'""")
def _case_counts(spark, sf_dir):
    return cases.status_counts(stored_cases(spark, sf_dir))


@query("case_list_filtered", with_(CASES) + """
 SELECT record_id, status, priority FROM now WHERE status = 'ESCALATED' AND priority = 'HIGH'""")
def _case_list(spark, sf_dir):
    return cases.filter_cases(stored_cases(spark, sf_dir), status="ESCALATED",
                              priority="HIGH").select("record_id", "status", "priority")


@query("case_latest_assessment", with_(CASES) + """
 SELECT record_id, status, o_orderkey % 97 AS risk_score, CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
  'CONFIRMED' AS anomaly_status FROM now JOIN orders ON record_id = concat('O', CAST(o_orderkey AS VARCHAR))""")
def _case_latest(spark, sf_dir):
    """Cases with the highest of two runs of their record."""
    held = stored_cases(spark, sf_dir)
    keys = [c for c in cases.CASE if c != "record_id"]
    runs = spark.sql("""SELECT concat('O', o_orderkey) AS record_id, r AS run_id, if(r = 2, o_orderkey % 97, 0) AS risk_score,
      if(r = 2 AND o_orderkey % 2 = 0, 'HIGH', 'LOW') AS severity, if(r = 2, 'CONFIRMED', 'NORMAL') AS anomaly_status
      FROM {orders} LATERAL VIEW explode(array(1, 2)) AS r""", orders=table(spark, sf_dir, "orders"))
    if keys:
        runs = runs.join(held.select("record_id", *keys).distinct(), "record_id")
    return cases.with_latest_assessment(held, runs).select("record_id", "status", "risk_score", "severity", "anomaly_status")


@query("case_audit", with_(CASES) + """
 , a AS (SELECT action_id, record_id, action, user, ns, last_value(ns IGNORE NULLS) OVER (
   PARTITION BY record_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   AS previous_status FROM log)
 SELECT action_id, record_id, action, user, previous_status,
  coalesce(ns, previous_status) AS new_status FROM a""")
def _audit(spark, sf_dir):
    return cases.audit_trail(case_log(spark, sf_dir)).select(
        "action_id", "record_id", "action", "user", "previous_status", "new_status")


@query("report_investigations", with_(CASES) + """
 SELECT n.record_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS risk_score,
  status AS investigation_status, action, priority FROM now n JOIN orders
  ON n.record_id = concat('O', CAST(o_orderkey AS VARCHAR))""")
def _investigations(spark, sf_dir):
    from plumbline.operators.reports import report

    scored = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(
        F.lit("B").alias("batch_id"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
        .alias("record_id"), F.col("o_totalprice").alias("risk_score"),
        F.lit("LOW").alias("severity"))
    rows = report("investigations", scored, "now", "v1", cases=stored_cases(spark, sf_dir))
    return rows.select("record_id", "risk_score", "investigation_status", "action", "priority")


# --- form lines: eight lines of text per order --------------------------------

_SCORE = "CAST((36 + (o_orderkey * 7 + {k} * 13) % 28) / 64.0 AS DOUBLE)"
_FORM = (
    "concat('Record ID: ', CAST(o_orderkey % 97 AS {text}))",
    "'District'",
    "o_orderpriority",
    "' INCOME '",
    "':'",
    "CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE concat('$', CAST(o_totalprice AS {text})) END",
    "concat('Age ', CAST(o_orderkey % 140 AS {text}))",
    "CASE o_orderkey % 3 WHEN 0 THEN 'Sex: Male' WHEN 1 THEN 'Gender : robot' "
    "ELSE 'Signature ____' END",
)
_LINES = " UNION ALL ".join(
    "SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS doc_id, "
    f"o_orderkey % 100 * 8 + {k} AS line_no, "
    "1 + CAST(floor(o_orderkey % 100 / 20) AS BIGINT) AS page, "
    f"{cell} AS text, {_SCORE.format(k=k)} AS score FROM {{orders}}"
    for k, cell in enumerate(_FORM, start=1))
_S = {k: _SCORE.format(k=k) for k in range(1, 9)}
FORMS = f"""o AS (SELECT *, CAST(floor(o_orderkey / 100) AS BIGINT) AS doc_id,
   CAST(o_orderkey % 97 AS VARCHAR) AS record_id,
   1 + CAST(floor(o_orderkey % 100 / 20) AS BIGINT) AS page, o_orderkey % 140 AS age,
   CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'robot' END AS gender,
   CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS income,
   {_S[1]} AS s1, ({_S[2]} + {_S[3]}) / 2 AS sd, ({_S[4]} + {_S[5]} + {_S[6]}) / 3 AS si,
   {_S[7]} AS sa, CASE WHEN o_orderkey % 3 < 2 THEN {_S[8]} END AS sg FROM orders),
 f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, record_id) > 1 AS twice,
   CASE WHEN sg IS NULL THEN (s1 + sa + sd + si) / 4 ELSE (s1 + sa + sg + sd + si) / 5 END AS mean
   FROM o),
 fr AS (SELECT doc_id, record_id, page, age, gender, o_orderpriority AS district, income,
   round(mean, 6) AS record_confidence, CASE WHEN mean >= 0.9 THEN 'high'
    WHEN mean >= 0.7 THEN 'medium' ELSE 'low' END AS record_confidence_band,
   income IS NULL OR twice OR least(s1, sd, si, sa, sg) < 0.7 AS needs_review,
   CASE WHEN income IS NULL THEN 'Income could not be interpreted as a number.' ELSE '' END
    AS issues,
   concat_ws('|', CASE WHEN age > 120 THEN
     concat('Age ', CAST(age AS VARCHAR), ' is outside the plausible range.') END,
    CASE WHEN gender = 'robot' THEN 'Unrecognized gender value: ''robot''.' END,
    CASE WHEN twice THEN concat('Duplicate Record ID ''', record_id, ''' within this upload.')
    END) AS warnings FROM f)"""


def form_lines(spark, sf_dir):
    return spark.sql(_LINES.replace("{text}", "STRING"), orders=table(spark, sf_dir, "orders"))


def stored_forms(spark, sf_dir):
    return stored(spark, sf_dir, "forms", lambda: read_forms(form_lines(spark, sf_dir)))


@query("form_lines_to_records", with_(FORMS) + """
 SELECT doc_id, record_id, page, age, gender, district, income, record_confidence,
  record_confidence_band FROM fr""")
def _forms(spark, sf_dir):
    return rounded(stored_forms(spark, sf_dir).select(
        "doc_id", "record_id", "page", "age", "gender", "district", "income",
        "record_confidence", "record_confidence_band"))


@query("form_record_warnings", with_(FORMS) + """
 SELECT doc_id, record_id, age, issues, warnings, needs_review FROM fr""")
def _warnings(spark, sf_dir):
    return stored_forms(spark, sf_dir).select(
        "doc_id", "record_id", "age", F.concat_ws("|", "issues").alias("issues"),
        F.concat_ws("|", "warnings").alias("warnings"), "needs_review")


@query("form_preview", with_(FORMS) + """
 SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS records_detected,
  count(*) FILTER (needs_review) AS records_needing_review FROM fr GROUP BY doc_id""")
def _preview(spark, sf_dir):
    return preview(form_lines(spark, sf_dir), stored_forms(spark, sf_dir))


# --- labels: broken hard rules, every 500th turned around ----------------------

_TRUTH = """lab AS (SELECT record_id, (anomaly_status = 'CONFIRMED')
   <> (CAST(substr(record_id, 2) AS BIGINT) % 500 = 0) AS bad, anomaly_status, rule_n, stat_n
   FROM fused)"""
_CONFUSION = """count(*) FILTER (anomaly_status = 'CONFIRMED' AND bad) AS true_positives,
  count(*) FILTER (anomaly_status = 'CONFIRMED' AND NOT bad) AS false_positives,
  count(*) FILTER (anomaly_status <> 'CONFIRMED' AND bad) AS false_negatives"""
_RATES = """round(true_positives * 1.0 / (true_positives + false_positives), 6) AS precision,
  round(true_positives * 1.0 / (true_positives + false_negatives), 6) AS recall"""


def labels(spark, sf_dir):
    number = F.substring("record_id", 2, 20).cast("bigint")
    flag = (F.col("anomaly_status") == "CONFIRMED") != (number % 500 == 0)
    return stored_assessments(spark, sf_dir).withColumn("bad", flag).where("bad").select(
        "record_id", F.lit(True).alias("expect_rule"))


@query("label_confusion", with_(*TWO, _TRUTH, f"c AS (SELECT {_CONFUSION} FROM lab)")
       + f" SELECT *, {_RATES} FROM c")
def _confusion(spark, sf_dir):
    predicted = stored_assessments(spark, sf_dir).where("anomaly_status = 'CONFIRMED'")
    return rounded(confusion(predicted, labels(spark, sf_dir)))


@query("label_report", with_(*TWO, _TRUTH, f"""c AS (SELECT {_CONFUSION},
  count(*) FILTER (rule_n > 0) AS flagged_by_rules,
  count(*) FILTER (stat_n > 0) AS flagged_by_statistics, CAST(0 AS BIGINT) AS flagged_by_ml,
  count(*) AS fused_assessments, count(*) FILTER (rule_n > 0 OR stat_n > 0) AS detected_evidence,
  count(*) FILTER (anomaly_status = 'CONFIRMED') AS confirmed_anomalies,
  count(*) FILTER (anomaly_status = 'REVIEW') AS review_signals,
  count(*) FILTER (bad) AS labelled, count(*) - count(*) FILTER (bad) AS intentionally_clean
  FROM lab)""") + f" SELECT *, {_RATES} FROM c")
def _label_report(spark, sf_dir):
    return rounded(evaluation_report(stored_assessments(spark, sf_dir), labels(spark, sf_dir)))
