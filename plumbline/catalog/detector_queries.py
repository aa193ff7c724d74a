"""Detectors over the survey view.

Where the data stays below a detector's usual limit, the limit is lowered so
that the compared result is not empty.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.catalog.profile_queries import MISSING, TEXTS, WIDTH, rounded
from plumbline.catalog.views import (
    SV, SVB, SVD, query, survey, survey_batch, survey_batches, survey_daily, table, with_,
)
from plumbline.config import DETECTORS
from plumbline.operators.detectors.common import Survey, group_rates
from plumbline.operators.detectors.enumerator import enumerators
from plumbline.operators.detectors.geographic import geography
from plumbline.operators.detectors.pattern import cluster_patterns
from plumbline.operators.detectors.relationship import (
    arithmetic_consistency, household_consistency, record_relationships,
)
from plumbline.operators.detectors.run import run_detectors
from plumbline.operators.detectors.shift import distribution_shift, prior_counts
from plumbline.operators.detectors.drift import in_order, period_drift, period_steps
from plumbline.operators.detectors.temporal import temporal
from plumbline.operators.profile import TOP_VALUES
from plumbline.operators.reports import distribution_items, temporal_series


def lowered(detector: str, **thresholds: float):
    return {**DETECTORS, detector: replace(DETECTORS[detector], thresholds=thresholds)}


def shown(found, *extra: str):
    return rounded(found.select(
        "entity_id", "field_name", "observed_value", "expected_value", "deviation", "severity",
        "baseline_type", *extra))


# --- relationships ------------------------------------------------------------

NOT_WORKING = ("(employment_status LIKE '%unemploy%' OR employment_status LIKE '%nilf%' "
               "OR employment_status LIKE '%not working%' OR employment_status LIKE '%inactive%')")
RECORD_CHECKS = (
    (1, "REL_AGE_MARITAL", "age", "age", 18,
     "age < 18 AND marital_status LIKE '%married%' AND marital_status NOT LIKE '%unmarried%' "
     "AND marital_status NOT LIKE '%never%'"),
    (2, "REL_AGE_EDUCATION", "education", "age", 20,
     "age < 20 AND (education LIKE '%postgrad%' OR education LIKE '%phd%' "
     "OR education LIKE '%doctor%' OR education LIKE '%master%')"),
    (3, "REL_EMPLOYMENT_HOURS", "working_hours", "working_hours", 10,
     f"working_hours > 10 AND {NOT_WORKING}"),
    (4, "REL_AGE_HOUSEHOLD_ROLE", "household_role", "age", 16,
     "age < 16 AND household_role IN ('head', 'household head', 'hhh')"),
    (5, "REL_INCOME_EMPLOYMENT", "income", "income", 80000,
     "employment_status LIKE '%unemploy%' AND income >= 80000"),
    (6, "REL_HOURS_EMPLOYMENT", "working_hours", "working_hours", 0,
     f"working_hours > 0 AND {NOT_WORKING}"),
)


def _check_sql(name, fld, seen, limit, test):
    return with_(SV) + f"""
 SELECT record_id AS entity_id, '{fld}' AS field_name,
  round(CAST({seen} AS DOUBLE), 6) AS observed_value,
  CAST({limit} AS DOUBLE) AS expected_value,
  round(CAST({seen} AS DOUBLE) - {limit}, 6) AS deviation, 'MEDIUM' AS severity,
  'relationship_rule' AS baseline_type, enumerator_id, cluster_id,
  district_code AS district_id, household_id FROM sv WHERE {test}"""


def _check(name):
    def run(spark, sf_dir):
        found = record_relationships(Survey.of(survey(spark, sf_dir)))
        return shown(found.where(F.col("detector_type") == name), "enumerator_id", "cluster_id",
                     "district_id", "household_id")
    return run


for _i, _name, _fld, _seen, _limit, _test in RECORD_CHECKS:
    query(_name.lower(), _check_sql(_name, _fld, _seen, _limit, _test))(_check(_name))

HOMES = """homes AS (SELECT household_id,
  count(*) FILTER (household_role IN ('head', 'household head', 'hhh')) AS heads,
  count(age) AS ages, max(age) - min(age) AS span,
  min_by(enumerator_id, record_id) AS enumerator_id, min_by(cluster_id, record_id) AS cluster_id,
  min_by(district_code, record_id) AS district_id FROM sv GROUP BY household_id)"""


@query("rel_household_consistency", with_(SV, HOMES) + """
 SELECT household_id AS entity_id, 'household_role' AS field_name,
  CAST(heads AS DOUBLE) AS observed_value, CAST(1.0 AS DOUBLE) AS expected_value,
  CAST(heads - 1 AS DOUBLE) AS deviation, 'MEDIUM' AS severity,
  'household_structure' AS baseline_type, enumerator_id, cluster_id, district_id
 FROM homes WHERE heads > 1
 UNION ALL SELECT household_id, 'age', CAST(span AS DOUBLE), CAST(90.0 AS DOUBLE), NULL, 'LOW',
  'household_structure', NULL, cluster_id, district_id FROM homes WHERE ages >= 2 AND span > 90""")
def _household(spark, sf_dir):
    found = household_consistency(Survey.of(survey(spark, sf_dir)))
    return shown(found, "enumerator_id", "cluster_id", "district_id")


_TOTALS = """SELECT o_orderkey AS record_id, o_totalprice AS total_income,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice - o_orderkey % 4 END AS wage_income,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1.5 END AS other_income FROM {orders}"""


@query("rel_arithmetic", f"""
 WITH t AS ({_TOTALS.format(orders='orders')}),
 s AS (SELECT *, coalesce(wage_income, 0) + coalesce(other_income, 0) AS summed FROM t)
 SELECT CAST(record_id AS VARCHAR) AS entity_id, 'total_income' AS field_name,
  round(total_income, 6) AS observed_value, round(CAST(summed AS DOUBLE), 6) AS expected_value,
  round(CAST(total_income - summed AS DOUBLE), 6) AS deviation, 'MEDIUM' AS severity,
  'relationship_rule' AS baseline_type FROM s WHERE abs(total_income - summed) > 1.0""")
def _arithmetic(spark, sf_dir):
    df = spark.sql(_TOTALS, orders=table(spark, sf_dir, "orders"))
    df = df.withColumn("other_income", F.col("other_income").cast("double"))
    return shown(arithmetic_consistency(Survey.of(df)))


# --- enumerators and geography ------------------------------------------------

EMPLOYED = ("(employment_status LIKE '%employ%' "
            "AND employment_status NOT LIKE '%unemploy%')")
RATES = f"""batch AS (SELECT avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END) AS rate,
   sum({MISSING}) / (count(*) * {WIDTH}.0) AS missing FROM sv),
 dist AS (SELECT district_code AS district_id, count(*) AS n,
   avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END) AS rate FROM sv GROUP BY ALL),
 people AS (SELECT enumerator_id, count(*) AS n,
   avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END) AS rate,
   sum({MISSING}) / (count(*) * {WIDTH}.0) AS missing,
   min_by(district_code, record_id) AS district_id FROM sv GROUP BY ALL),
 areas AS (SELECT cluster_id, count(*) AS n,
   avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END) AS rate,
   min_by(district_code, record_id) AS district_id FROM sv GROUP BY ALL)"""


def entropy_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys} -sum(p * log2(p)) AS h FROM (
   SELECT {keys} count(*) * 1.0 / sum(count(*)) OVER ({f'PARTITION BY {by}' if by else ''}) AS p
   FROM sv WHERE employment_status IS NOT NULL GROUP BY {keys} employment_status) {group}"""


ENTROPY = f"people_h AS ({entropy_sql('enumerator_id')}), batch_h AS ({entropy_sql('')})"
SIGNATURE = """concat_ws('|',
  CASE WHEN age IS NULL THEN 'age:'
   ELSE concat('age:', CAST(CAST(floor(age / 5.0) * 5 AS BIGINT) AS VARCHAR)) END,
  concat('sex:', lower(sex)), concat('education:', lower(education)),
  concat('employment_status:', lower(employment_status)),
  CASE WHEN working_hours IS NULL THEN 'working_hours:'
   ELSE concat('hours:', CAST(CAST(round_even(working_hours / 5.0, 0) * 5 AS BIGINT) AS VARCHAR))
   END,
  CASE WHEN income IS NULL THEN 'income:'
   ELSE concat('income:', CAST(CAST(floor(income / 5000.0) * 5000 AS BIGINT) AS VARCHAR)) END)"""
SIGNED = f"""sigs AS (SELECT enumerator_id, cluster_id, district_code, record_id,
  {SIGNATURE} AS sig FROM sv)"""
TOPS = SIGNED + """, people_sig AS (SELECT enumerator_id, max(c) AS top, sum(c) AS n FROM (
  SELECT enumerator_id, sig, count(*) AS c FROM sigs GROUP BY ALL) GROUP BY enumerator_id),
 area_sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
   ORDER BY c DESC, first) AS place, sum(c) OVER (PARTITION BY cluster_id) AS n FROM (
   SELECT cluster_id, sig, count(*) AS c, min(record_id) AS first,
    min_by(district_code, record_id) AS district_id,
    min_by(enumerator_id, record_id) AS enumerator_id FROM sigs GROUP BY cluster_id, sig))
  WHERE place = 1)"""


def _people(name, detector, sql, history=None, field=None, **thresholds):
    def run(spark, sf_dir):
        s = Survey.of(survey(spark, sf_dir), configs=lowered(detector, **thresholds))
        found = enumerators(s, group_rates(s)).detections
        return shown(found.where(F.col("detector_type") == detector), "district_id")
    query(name, sql)(run)


def people_select(field, observed, expected, baseline, test, source):
    return f""" SELECT enumerator_id AS entity_id, '{field}' AS field_name,
  round(CAST({observed} AS DOUBLE), 6) AS observed_value,
  round(CAST({expected} AS DOUBLE), 6) AS expected_value,
  round(CAST({observed} - {expected} AS DOUBLE), 6) AS deviation, 'MEDIUM' AS severity,
  '{baseline}' AS baseline_type, district_id FROM {source} WHERE {test}"""


_people("enum_employment", "ENUMERATOR_DEVIATION", with_(SV, RATES) + people_select(
    "employment_rate", "p.rate", "d.rate", "district", "p.n >= 8 AND abs(p.rate - d.rate) >= 0.05",
    "people p JOIN dist d USING (district_id)"), pp_threshold=0.05, min_records=8)
_people("enum_missingness", "ENUMERATOR_MISSINGNESS", with_(SV, RATES) + people_select(
    "missing_rate", "p.missing", "b.missing", "batch",
    "p.n >= 8 AND abs(p.missing - b.missing) >= 0.0005", "people p, batch b"),
        pp_threshold=0.0005, min_records=8)
_people("enum_entropy", "ENUMERATOR_ENTROPY", with_(SV, RATES, ENTROPY) + people_select(
    "response_entropy", "h.h", "b.h", "batch", "p.n >= 8 AND h.h / b.h <= 0.99",
    "people p JOIN people_h h USING (enumerator_id), batch_h b"),
        entropy_ratio=0.99, min_records=8)
_people("enum_similarity", "PATTERN_ENUMERATOR_SIMILARITY",
        with_(SV, RATES, TOPS) + people_select(
            "response_similarity", "s.top * 1.0 / p.n", "0.015", "enumerator_internal",
            "p.n >= 8 AND s.top * 1.0 / p.n >= 0.015",
            "people p JOIN people_sig s USING (enumerator_id)"),
        share_threshold=0.015, min_records=8)


@query("enum_history", with_(SVB, f"""
 r AS (SELECT batch_id, enumerator_id, count(*) AS n,
   avg(CASE WHEN {EMPLOYED} THEN 1.0 ELSE 0.0 END) AS rate,
   min_by(district_code, record_id) AS district_id FROM svb GROUP BY ALL),
 past AS (SELECT enumerator_id, 1 - rate AS rate FROM r WHERE batch_id = 'B2'),
 p AS (SELECT * FROM r WHERE batch_id = 'B3')""") + people_select(
    "employment_rate", "p.rate", "past.rate", "historical_enumerator",
    "abs(past.rate - p.rate) >= 0.2", "p JOIN past USING (enumerator_id)"))
def _enum_history(spark, sf_dir):
    """B3 against a history in which B2's rates are turned around."""
    before = Survey.of(survey_batch(spark, sf_dir, "B2"))
    past = group_rates(before).where(F.col("scope") == "enumerator").select(
        F.col("group_id").alias("enumerator_id"),
        (F.lit(1.0) - F.col("employment_rate")).alias("employment_rate"))
    s = Survey.of(survey_batch(spark, sf_dir, "B3"))
    found = enumerators(s, history=past).detections
    return shown(found.where(F.col("baseline_type") == "historical_enumerator"), "district_id")


@query("geo_district", with_(SV, RATES) + """
 SELECT d.district_id AS entity_id, 'employment_rate' AS field_name,
  round(d.rate, 6) AS observed_value, round(b.rate, 6) AS expected_value,
  round(d.rate - b.rate, 6) AS deviation,
  CASE WHEN abs(d.rate - b.rate) >= 0.3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'national' AS baseline_type FROM dist d, batch b WHERE d.n >= 8 AND abs(d.rate - b.rate) >= 0.01""")
def _district(spark, sf_dir):
    s = Survey.of(survey(spark, sf_dir),
                  configs=lowered("GEOGRAPHIC_DISTRICT", pp_threshold=0.01, min_records=8))
    found = geography(s).detections
    return shown(found.where(F.col("detector_type") == "GEOGRAPHIC_DISTRICT"))


CLUSTERS = """SELECT a.cluster_id AS entity_id, 'employment_rate' AS field_name,
  round(a.rate, 6) AS observed_value, round(d.rate, 6) AS expected_value,
  round(a.rate - d.rate, 6) AS deviation,
  CASE WHEN abs(a.rate - d.rate) >= 0.35 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'district' AS baseline_type, district_id FROM areas a JOIN dist d USING (district_id)
 WHERE a.n >= 6 AND abs(a.rate - d.rate) >= 0.05"""


@query("geo_cluster", with_(SV, RATES) + CLUSTERS)
def _cluster(spark, sf_dir):
    s = Survey.of(survey(spark, sf_dir),
                  configs=lowered("GEOGRAPHIC_CLUSTER", pp_threshold=0.05, min_records=6))
    found = geography(s).detections
    return shown(found.where(F.col("detector_type") == "GEOGRAPHIC_CLUSTER"), "district_id")


@query("cluster_pattern", with_(SV, TOPS) + """
 SELECT cluster_id AS entity_id, 'response_signature' AS field_name,
  round(c * 1.0 / n, 6) AS observed_value, CAST(0.02 AS DOUBLE) AS expected_value,
  round(c * 1.0 / n - 0.02, 6) AS deviation, 'MEDIUM' AS severity,
  'cluster_internal' AS baseline_type, first AS record_id, district_id, enumerator_id,
  sig AS signature FROM area_sig WHERE n >= 8 AND c * 1.0 / n >= 0.02""")
def _pattern(spark, sf_dir):
    s = Survey.of(survey(spark, sf_dir),
                  configs=lowered("CLUSTER_PATTERN", share_threshold=0.02, min_records=8))
    found = cluster_patterns(s).detections
    return shown(found.withColumn("signature", F.try_element_at("evidence", F.lit("signature"))),
                 "record_id", "district_id", "enumerator_id", "signature")


# --- periods ------------------------------------------------------------------

PERIODS = """per AS (SELECT survey_round AS period, count(*) AS n,
   avg(CASE WHEN employment_status LIKE '%unemploy%' THEN 1.0 ELSE 0.0 END) AS rate,
   row_number() OVER (ORDER BY survey_round) AS i FROM svd GROUP BY survey_round)"""


def _temporal(kind):
    def run(spark, sf_dir):
        s = Survey.of(survey_daily(spark, sf_dir),
                      configs=lowered("TEMPORAL_CHANGE", pp_threshold=0.03, min_period_n=8))
        found = temporal(s).detections
        return shown(found.where(F.col("baseline_type") == kind))
    return run


_CHANGE = with_(SVD, PERIODS) + """
 SELECT c.period AS entity_id, 'unemployment_rate' AS field_name,
  round(c.rate, 6) AS observed_value, round(p.rate, 6) AS expected_value,
  round(c.rate - p.rate, 6) AS deviation,
  CASE WHEN abs(c.rate - p.rate) >= 0.12 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'previous_period' AS baseline_type FROM per c JOIN per p ON p.i = c.i - 1
 WHERE c.n >= 8 AND p.n >= 8 AND abs(c.rate - p.rate) >= 0.03"""
_OFF = with_(SVD, PERIODS, "t AS (SELECT avg(rate) AS m, stddev_samp(rate) AS s "
                                        "FROM per)") + """
 SELECT period AS entity_id, 'unemployment_rate' AS field_name, round(rate, 6) AS observed_value,
  round(m, 6) AS expected_value, round(rate - m, 6) AS deviation, 'MEDIUM' AS severity,
  'rolling_mean' AS baseline_type FROM per, t WHERE n >= 8 AND abs((rate - m) / s) >= 2.5"""
_DRIFT = with_(SVD, PERIODS, """
 use AS (SELECT period, rate, row_number() OVER (ORDER BY period) AS k FROM per WHERE n >= 8),
 walk AS (
  SELECT k, period, rate, rate AS ewma, CAST(0.0 AS DOUBLE) AS carry,
   CAST(0.0 AS DOUBLE) AS cusum FROM use WHERE k = 1
  UNION ALL
  SELECT k, period, rate, ewma, CASE WHEN cusum >= 0.15 THEN 0.0 ELSE cusum END, cusum FROM (
   SELECT u.k, u.period, u.rate, 0.4 * u.rate + 0.6 * w.ewma AS ewma,
    greatest(0.0, w.carry + u.rate - (0.4 * u.rate + 0.6 * w.ewma)) AS cusum
   FROM walk w JOIN use u ON u.k = w.k + 1))""") + """
 SELECT period AS entity_id, 'unemployment_rate' AS field_name, round(rate, 6) AS observed_value,
  round(ewma, 6) AS expected_value, round(cusum, 6) AS deviation, 'MEDIUM' AS severity,
  'ewma_cusum' AS baseline_type FROM walk WHERE cusum >= 0.15"""
query("temporal_change", _CHANGE)(_temporal("previous_period"))
query("temporal_z", _OFF)(_temporal("rolling_mean"))
query("temporal_ewma_cusum", _DRIFT)(_temporal("ewma_cusum"))


@query("temporal_series", "SELECT * FROM (" + " UNION ALL ".join(f"""
 SELECT entity_id AS period, observed_value AS observed, expected_value AS baseline,
  round(coalesce(expected_value, 0) + 0.08, 6) AS threshold, deviation FROM ({x})"""
                                                                for x in (_CHANGE, _OFF, _DRIFT)) + ")")
def _series(spark, sf_dir):
    s = Survey.of(survey_daily(spark, sf_dir), configs=lowered("TEMPORAL_CHANGE", pp_threshold=0.03, min_period_n=8))
    return rounded(temporal_series(temporal(s).detections))


query("temporal_steps_per_record", """
 WITH e AS (SELECT concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', CAST(event_id AS VARCHAR)) AS period,
   CAST(event_type = 'error' AS INT)::DOUBLE AS rate FROM events)
 SELECT period, rate, lag(period) OVER w AS p_period, lag(rate) OVER w AS p_rate FROM e
 WINDOW w AS (ORDER BY period)""")(
    lambda spark, sf_dir: period_steps(in_order(spark.sql(
        "SELECT concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_id) AS period, "
        "CAST(1 AS BIGINT) AS n, CAST(CAST(event_type = 'error' AS INT) AS DOUBLE) AS rate "
        "FROM {events}", events=table(spark, sf_dir, "events"))))
    .select("period", "rate", "p_period", "p_rate"))


# One period per event, in blocks of 512: every state but the first comes through summaries.
query("temporal_drift_per_record", """
 WITH RECURSIVE use AS MATERIALIZED (
  SELECT concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', CAST(event_id AS VARCHAR)) AS period,
   least(value, 60.0) / 200.0 AS rate, row_number() OVER (ORDER BY period) AS k
  FROM events WHERE event_type <> 'view'),
 walk AS (
  SELECT k, period, rate, rate AS ewma, CAST(0.0 AS DOUBLE) AS carry,
   CAST(0.0 AS DOUBLE) AS cusum FROM use WHERE k = 1
  UNION ALL
  SELECT k, period, rate, ewma, CASE WHEN cusum >= 0.15 THEN 0.0 ELSE cusum END, cusum FROM (
   SELECT u.k, u.period, u.rate, 0.4 * u.rate + 0.6 * w.ewma AS ewma,
    greatest(0.0, w.carry + u.rate - (0.4 * u.rate + 0.6 * w.ewma)) AS cusum
   FROM walk w JOIN use u ON u.k = w.k + 1))
 SELECT period, round(rate, 6) AS rate, round(ewma, 6) AS ewma, round(cusum, 6) AS cusum
 FROM walk WHERE cusum >= 0.15""")(
    lambda spark, sf_dir: period_drift(in_order(spark.sql(
        "SELECT concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_id) AS period, "
        "CAST(event_type <> 'view' AS BIGINT) AS n, least(value, 60.0) / 200.0 AS rate "
        "FROM {events}", events=table(spark, sf_dir, "events")), 512), 1)
    .select("period", *[F.round(c, 6).alias(c) for c in ("rate", "ewma", "cusum")]))


# --- distribution shift -------------------------------------------------------

def _shift_sql(top: bool) -> str:
    limit = "WHERE place <= 10" if top else ""
    return with_(SVB, "l AS (" + " UNION ALL ".join(
        f"SELECT batch_id, '{c}' AS variable, {c} AS value FROM svb WHERE {c} IS NOT NULL"
        for c in TEXTS) + f"""),
 c AS (SELECT batch_id, variable, value, count(*) AS n FROM l GROUP BY ALL),
 e AS (SELECT variable, value, n FROM (SELECT *, row_number() OVER (PARTITION BY variable
    ORDER BY n DESC, value) AS place FROM c WHERE batch_id = 'B2') {limit}),
 a AS (SELECT variable, value, n FROM c WHERE batch_id = 'B3'),
 et AS (SELECT variable, sum(n) AS t FROM e GROUP BY variable),
 atot AS (SELECT variable, sum(n) AS t FROM a GROUP BY variable),
 d AS (SELECT variable, 0.5 * sum(abs(coalesce(a.n, 0) * 1.0 / atot.t
     - coalesce(e.n, 0) * 1.0 / et.t)) AS distance
   FROM e FULL OUTER JOIN a USING (variable, value) JOIN et USING (variable)
   JOIN atot USING (variable) WHERE et.t >= 8 AND atot.t >= 8 GROUP BY variable)""") + """
 SELECT 'B3' AS entity_id, variable AS field_name, round(distance, 6) AS observed_value,
  CAST(0.01 AS DOUBLE) AS expected_value, round(distance, 6) AS deviation, 'MEDIUM' AS severity,
  'historical_batch' AS baseline_type FROM d WHERE distance >= 0.01"""


def _shift(full):
    def run(spark, sf_dir):
        prior = prior_counts(survey_batch(spark, sf_dir, "B2"), None if full else TOP_VALUES)
        s = Survey.of(survey_batch(spark, sf_dir, "B3"),
                      configs=lowered("DISTRIBUTION_SHIFT", tvd_threshold=0.01))
        return shown(distribution_shift(s, prior, "B2", "B3").detections)
    return run


query("distribution_shift_tvd", _shift_sql(True))(_shift(False))
query("distribution_shift_full", _shift_sql(False))(_shift(True))


@query("distribution_items", f"""SELECT field_name AS field, observed_value AS distance,
 expected_value AS threshold FROM ({_shift_sql(False)})""")
def _items(spark, sf_dir):
    s = Survey.of(survey_batch(spark, sf_dir, "B3"), configs=lowered("DISTRIBUTION_SHIFT", tvd_threshold=0.01))
    found = distribution_shift(s, prior_counts(survey_batch(spark, sf_dir, "B2"), None), "B2", "B3").detections
    return rounded(distribution_items(found).drop("explanation"))


# --- all families at their usual limits ----------------------------------------

ALL = ", ".join((RATES, ENTROPY, TOPS, HOMES)) + ", det AS (" + " UNION ALL ".join(
    [f"""SELECT '{name}' AS detector_type, 'record' AS entity_type, record_id AS entity_id,
  record_id, enumerator_id, cluster_id, 'MEDIUM' AS severity,
  0 AS family, 0 AS step, record_id AS position, {i} AS number, 'relationship_rule' AS baseline_type
  FROM sv WHERE {test}""" for i, name, _, _, _, test in RECORD_CHECKS] + [
        """SELECT 'REL_HOUSEHOLD_CONSISTENCY', 'household', household_id, NULL, enumerator_id,
  cluster_id, 'MEDIUM', 0, 1, household_id, 0, 'household_structure' FROM homes WHERE heads > 1""",
        """SELECT 'REL_HOUSEHOLD_CONSISTENCY', 'household', household_id, NULL, NULL,
  cluster_id, 'LOW', 0, 1, household_id, 1, 'household_structure' FROM homes
  WHERE ages >= 2 AND span > 90""",
        """SELECT 'ENUMERATOR_DEVIATION', 'enumerator', enumerator_id, NULL, enumerator_id, NULL,
  'MEDIUM', 1, 0, enumerator_id, 0, 'district' FROM people p JOIN dist d USING (district_id)
  WHERE p.n >= 8 AND abs(p.rate - d.rate) >= 0.25""",
        """SELECT 'ENUMERATOR_MISSINGNESS', 'enumerator', enumerator_id, NULL, enumerator_id, NULL,
  'MEDIUM', 1, 0, enumerator_id, 1, 'batch' FROM people p, batch b
  WHERE p.n >= 8 AND abs(p.missing - b.missing) >= 0.08""",
        """SELECT 'ENUMERATOR_ENTROPY', 'enumerator', enumerator_id, NULL, enumerator_id, NULL,
  'MEDIUM', 1, 0, enumerator_id, 2, 'batch' FROM people p JOIN people_h h USING (enumerator_id),
  batch_h b WHERE p.n >= 8 AND h.h / b.h <= 0.45""",
        """SELECT 'PATTERN_ENUMERATOR_SIMILARITY', 'enumerator', enumerator_id, NULL,
  enumerator_id, NULL, 'MEDIUM', 1, 0, enumerator_id, 3, 'enumerator_internal'
  FROM people p JOIN people_sig s USING (enumerator_id)
  WHERE p.n >= 8 AND s.top * 1.0 / p.n >= 0.6""",
        """SELECT 'GEOGRAPHIC_DISTRICT', 'district', d.district_id, NULL, NULL, NULL,
  CASE WHEN abs(d.rate - b.rate) >= 0.3 THEN 'HIGH' ELSE 'MEDIUM' END, 3, 0, d.district_id, 0,
  'national' FROM dist d, batch b WHERE d.n >= 8 AND abs(d.rate - b.rate) >= 0.2""",
        """SELECT 'GEOGRAPHIC_CLUSTER', 'cluster', a.cluster_id, NULL, NULL, a.cluster_id,
  CASE WHEN abs(a.rate - d.rate) >= 0.35 THEN 'HIGH' ELSE 'MEDIUM' END, 3, 1, a.cluster_id, 0,
  'district' FROM areas a JOIN dist d USING (district_id)
  WHERE a.n >= 6 AND abs(a.rate - d.rate) >= 0.25""",
        """SELECT 'CLUSTER_PATTERN', 'cluster', cluster_id, first, enumerator_id, cluster_id,
  'MEDIUM', 4, 0, cluster_id, 0, 'cluster_internal' FROM area_sig
  WHERE n >= 8 AND c * 1.0 / n >= 0.7"""]) + ")"
# Weekly unemployment of the survey view stays below every temporal limit.
WEEKLY = """wk AS (SELECT survey_round AS period, count(*) AS n,
  avg(CASE WHEN employment_status LIKE '%unemploy%' THEN 1.0 ELSE 0.0 END) AS rate
  FROM sv GROUP BY survey_round),
 wkl AS (SELECT *, lag(rate) OVER o AS p_rate, lag(n) OVER o AS p_n FROM wk
  WINDOW o AS (ORDER BY period))"""
ALL = ALL.removesuffix(")") + """ UNION ALL SELECT 'TEMPORAL_CHANGE', 'state', period, NULL, NULL,
  NULL, CASE WHEN abs(rate - p_rate) >= 0.12 THEN 'HIGH' ELSE 'MEDIUM' END, 2, 0, period, 0,
  'previous_period' FROM wkl WHERE n >= 8 AND p_n >= 8 AND abs(rate - p_rate) >= 0.08)"""


@query("detector_run", with_(SV, WEEKLY, ALL) + """
 SELECT detector_type, entity_type, entity_id, record_id, enumerator_id, cluster_id, severity,
  baseline_type FROM det""")
def _run(spark, sf_dir):
    found = run_detectors(survey(spark, sf_dir)).detections
    return found.select("detector_type", "entity_type", "entity_id", "record_id",
                        "enumerator_id", "cluster_id", "severity", "baseline_type")
