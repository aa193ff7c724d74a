"""Unemployment over survey periods, in text order of the period.

Records are first aggregated to one row per period; what needs an order is in ``drift``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import detector_enabled, detector_threshold
from plumbline.functions.answers import unemployed
from plumbline.operators.detectors.common import (
    Outcome, Survey, detection_fields, evidence_map, no_detections, seq,
)
from plumbline.operators.detectors.drift import in_order, period_drift, period_steps
from plumbline.plans.lookup import materialize

DISABLED = "TEMPORAL_CHANGE disabled"
NO_PERIOD = "No previous survey period available"
NO_STATUS = "No employment field for temporal rates"
TOO_FEW = "INSUFFICIENT HISTORICAL DATA — fewer than two periods"
CHANGE_HIGH = 0.12
Z_LIMIT = 2.5


def period_rates(s: Survey) -> DataFrame:
    """(period, n, rate), one row per distinct period."""
    status = F.col(s.concept("employment")).cast("string")
    rows = s.df.select(F.col(s.concept("period")).cast("string").alias("period"),
                       unemployed(status).cast("double").alias("_u"))
    return rows.where(F.col("period").isNotNull()).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_u").alias("rate"))


def temporal(s: Survey) -> Outcome:
    if not detector_enabled(s.configs, "TEMPORAL_CHANGE"):
        return Outcome(False, reason=DISABLED)
    if not s.concept("period"):
        return Outcome(False, reason=NO_PERIOD)
    if not s.concept("employment"):
        return Outcome(False, reason=NO_STATUS)
    table = materialize(period_rates(s))
    facts = table.agg(F.count(F.lit(1)).alias("periods"), F.avg("rate").alias("mean"),
                      F.stddev_samp("rate").alias("std")).first()
    if facts["periods"] < 2:
        return Outcome(False, reason=TOO_FEW)
    minimum = detector_threshold(s.configs, "TEMPORAL_CHANGE", "min_period_n", 8)
    gap = detector_threshold(s.configs, "TEMPORAL_CHANGE", "pp_threshold", 0.08)
    mean, std = facts["mean"], facts["std"]
    usable = (F.col("n") >= minimum) & F.col("rate").isNotNull()

    def fields(text: str, number: int, observed: Column, expected: Column, deviation: Column,
               kind: str, severity: Column, extra: Column) -> list[Column]:
        return detection_fields(
            "TEMPORAL_CHANGE", "TEMPORAL", text=text,
            entity_type=F.lit("state"), entity_id=F.col("period"), severity=severity,
            field_name=F.lit("unemployment_rate"), observed_value=observed,
            expected_value=expected, deviation=deviation, baseline_type=F.lit(kind),
            evidence=extra, seq=seq(2, 0, F.col("period"), number))

    ordered = in_order(table)
    steps = period_steps(ordered)
    change = F.col("rate") - F.col("p_rate")
    changed = steps.where(
        usable & (F.col("p_n") >= minimum) & (F.abs(change) >= gap)
    ).select(*fields(
        "TEMPORAL_CHANGE", 0, F.col("rate"), F.col("p_rate"), change, "previous_period",
        F.when(F.abs(change) >= CHANGE_HIGH, "HIGH").otherwise("MEDIUM"),
        evidence_map(current_period=F.col("period"), previous_period=F.col("p_period"),
                     percentage_point_change=change, rolling_mean=F.lit(mean),
                     rolling_std=F.lit(std))))
    off = no_detections(s.spark)
    if std is not None and std > 1e-9:
        z = (F.col("rate") - F.lit(mean)) / F.lit(std)
        off = table.where(usable & (F.abs(z) >= Z_LIMIT)).select(*fields(
            "TEMPORAL_BASELINE", 1, F.col("rate"), F.lit(mean), F.col("rate") - F.lit(mean),
            "rolling_mean", F.lit("MEDIUM"), evidence_map(robust_z_score=z)))
    drift = period_drift(ordered, minimum).select(*fields(
        "TEMPORAL_CUSUM", 2, F.col("rate"), F.col("ewma"), F.col("cusum"), "ewma_cusum",
        F.lit("MEDIUM"), evidence_map(cusum=F.col("cusum"), ewma=F.col("ewma"))))
    return Outcome(True, changed.unionByName(off).unionByName(drift))
