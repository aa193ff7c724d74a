"""Statistical evidence over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.profile_queries import LONG, MEASURES, rounded
from plumbline.catalog.views import SV, SVB, query, survey, survey_batch, survey_batches, with_
from plumbline.config import StatSettings
from plumbline.operators.detectors.shift import stability_index
from plumbline.operators.statistics import (
    batch_baselines, historical_shift, latest_baselines, record_evidence, statistics_summary,
)

IDS = "record_id, enumerator_id, cluster_id, district_code AS district_id"
COLUMNS = ("record_id", "enumerator_id", "cluster_id", "district_id", "variable", "detector",
           "scope", "observed_value", "baseline_value", "baseline_std", "score", "threshold",
           "severity")

Z = f"""z AS (SELECT {IDS}, variable, 'z_score' AS detector, 'dataset' AS scope,
  value AS observed_value, m AS baseline_value, s AS baseline_std, (value - m) / s AS score
 FROM (SELECT *, avg(value) OVER p AS m, stddev_samp(value) OVER p AS s, count(value) OVER p AS n
       FROM lng WINDOW p AS (PARTITION BY variable))
 WHERE n >= 8 AND abs(s) >= 1e-9 AND abs((value - m) / s) >= 2)"""
IQR = f"""q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY variable),
 iqr AS (SELECT {IDS}, variable, 'iqr' AS detector, 'dataset' AS scope, value AS observed_value,
  q2 AS baseline_value, q3 - q1 AS baseline_std, value AS score,
  value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) AS far
 FROM lng JOIN q USING (variable)
 WHERE q3 - q1 >= 1e-9
  AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))"""
GROUP = "g AS (" + " UNION ALL ".join(f"""
 SELECT {IDS}, variable, 'group_z_score' AS detector, '{s}' AS scope, value AS observed_value,
  m AS baseline_value, s AS baseline_std, (value - m) / s AS score
 FROM (SELECT *, avg(value) OVER p AS m, stddev_samp(value) OVER p AS s, count(value) OVER p AS n
       FROM lng WINDOW p AS (PARTITION BY variable, {c}))
 WHERE n >= 5 AND abs(s) >= 1e-9 AND abs((value - m) / s) >= 2"""
    for s, c in (("enumerator", "enumerator_id"), ("cluster", "cluster_id"),
                 ("district", "district_code"))) + ")"
_GRADED = """*, CASE WHEN abs(score) >= 3 THEN 3.0 ELSE 2.0 END AS threshold,
 CASE WHEN abs(score) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity"""
EVIDENCE = f"""st AS (SELECT {_GRADED} FROM z UNION ALL SELECT {_GRADED} FROM g
 UNION ALL SELECT * EXCLUDE (far), CASE WHEN far THEN 3.0 ELSE 1.5 END,
  CASE WHEN far THEN 'HIGH' ELSE 'MEDIUM' END FROM iqr)"""
ROUND = ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in (
        "observed_value", "baseline_value", "baseline_std", "score", "threshold") else c
    for c in COLUMNS)


def _only(detector: str):
    def run(spark, sf_dir):
        found = record_evidence(survey(spark, sf_dir), detectors=(detector,))
        return rounded(found.select(*COLUMNS))
    return run


query("stat_z_score", with_(SV, LONG, Z) + f" SELECT {ROUND} FROM (SELECT {_GRADED} FROM z)")(
    _only("z_score"))
query("stat_group_z", with_(SV, LONG, GROUP) + f" SELECT {ROUND} FROM (SELECT {_GRADED} FROM g)")(
    _only("group_z_score"))
query("stat_iqr", with_(SV, LONG, IQR) + f""" SELECT {ROUND} FROM (SELECT * EXCLUDE (far),
  CASE WHEN far THEN 3.0 ELSE 1.5 END AS threshold,
  CASE WHEN far THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM iqr)""")(_only("iqr"))
query("stat_mad", with_(SV, LONG, f"""med AS (SELECT variable, quantile_cont(value, 0.5) AS m
   FROM lng GROUP BY variable),
 d AS (SELECT variable, m, quantile_cont(abs(value - m), 0.5) AS mad
   FROM lng JOIN med USING (variable) GROUP BY ALL),
 r AS (SELECT {IDS}, variable, 'mad' AS detector, 'dataset' AS scope, value AS observed_value,
   m AS baseline_value, mad AS baseline_std, 0.6745 * (value - m) / mad AS score
   FROM lng JOIN d USING (variable)
   WHERE mad >= 1e-9 AND abs(0.6745 * (value - m) / mad) >= 2)""")
      + f" SELECT {ROUND} FROM (SELECT {_GRADED} FROM r)")(_only("mad"))


@query("stat_evidence", with_(SV, LONG, Z, IQR, GROUP, EVIDENCE) + f" SELECT {ROUND} FROM st")
def _all(spark, sf_dir):
    return rounded(record_evidence(survey(spark, sf_dir)).select(*COLUMNS))


@query("stat_summary", with_(SV, LONG, Z, IQR, GROUP, EVIDENCE) + """
 SELECT (SELECT count(*) FROM sv) AS records_checked, CAST(4 AS BIGINT) AS variables_checked,
  count(*) AS detections, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, false AS historical_context_available FROM st""")
def _summary(spark, sf_dir):
    df = survey(spark, sf_dir)
    return statistics_summary(record_evidence(df), df.count(), len(MEASURES), False)


# Batch means of this data lie close together, so the limits are set low.
SENSITIVE = StatSettings(z_medium=0.001, z_high=0.02)


def baseline_log(spark, sf_dir):
    """(batch_id, created_at, variable, mean, std) of every batch."""
    rows = survey_batches(spark, sf_dir)
    parts = [
        batch_baselines(rows.where(F.col("batch_id") == b), list(MEASURES))
        .withColumns({"batch_id": F.lit(b), "created_at": F.lit(i)})
        for i, b in enumerate(("B1", "B2", "B3"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stat_historical_shift", with_(SVB, "l AS (" + " UNION ALL ".join(
    f"SELECT batch_id, '{m}' AS variable, CAST({m} AS DOUBLE) AS value FROM svb"
    for m in MEASURES) + """),
 s AS (SELECT batch_id, variable, avg(value) AS m, stddev_samp(value) AS sd FROM l GROUP BY ALL),
 d AS (SELECT c.variable, c.m AS cm, p.m AS pm, p.sd AS ps, (c.m - p.m) / p.sd AS score
   FROM s c JOIN s p USING (variable) WHERE c.batch_id = 'B3' AND p.batch_id = 'B2')""") + """
 SELECT variable, 'historical_shift' AS detector, 'dataset' AS scope,
  round(cm, 6) AS observed_value, round(pm, 6) AS baseline_value, round(ps, 6) AS baseline_std,
  round(score, 6) AS score, CASE WHEN abs(score) >= 0.02 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'B2' AS source_batch_id FROM d WHERE abs(score) >= 0.001""")
def _history(spark, sf_dir):
    current = batch_baselines(survey_batch(spark, sf_dir, "B3"), list(MEASURES))
    latest = latest_baselines(baseline_log(spark, sf_dir), "B3")
    return rounded(historical_shift(current, latest, SENSITIVE).select(
        "variable", "detector", "scope", "observed_value", "baseline_value", "baseline_std",
        "score", "severity", F.col("evidence.source_batch_id").alias("source_batch_id")))


_PSI = ("age", "income")


@query("distribution_psi", with_(SVB, "l AS (" + " UNION ALL ".join(
    f"SELECT batch_id, '{m}' AS variable, CAST({m} AS DOUBLE) AS value FROM svb "
    f"WHERE {m} IS NOT NULL" for m in _PSI) + """),
 e AS (SELECT variable, list_sort(list_distinct(
   quantile_cont(value, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS edges
   FROM l WHERE batch_id = 'B1' GROUP BY variable),
 b AS (SELECT batch_id, variable, len(edges) - 1 AS k, least(len(edges) - 1,
   len(list_filter(edges, lambda x: x <= value))) AS bin FROM l JOIN e USING (variable)
   WHERE batch_id IN ('B1', 'B2') AND value >= edges[1] AND value <= edges[-1]),
 n AS (SELECT variable, k, unnest(range(1, k + 1)) AS bin FROM (SELECT DISTINCT variable, k FROM b)),
 c AS (SELECT n.variable, n.k, n.bin,
   (SELECT count(*) FROM b WHERE b.variable = n.variable AND b.bin = n.bin AND batch_id = 'B1')
     AS ec,
   (SELECT count(*) FROM b WHERE b.variable = n.variable AND b.bin = n.bin AND batch_id = 'B2')
     AS ac FROM n),
 p AS (SELECT variable, (ec + 1e-6) / (sum(ec) OVER v + 1e-6 * k) AS ep,
   (ac + 1e-6) / (sum(ac) OVER v + 1e-6 * k) AS ap FROM c WINDOW v AS (PARTITION BY variable))""")
       + " SELECT variable, round(sum((ap - ep) * ln(ap / ep)), 6) AS psi FROM p GROUP BY variable")
def _psi(spark, sf_dir):
    prior, current = (survey_batch(spark, sf_dir, b) for b in ("B1", "B2"))
    return rounded(stability_index(prior, current, list(_PSI)))
