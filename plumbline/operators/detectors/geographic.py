"""Districts against the batch, clusters against their district."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import detector_enabled, detector_threshold
from plumbline.operators.detectors.common import (
    Outcome, Survey, detection_fields, district_baseline, evidence_map, group_rates,
    no_detections, scope_of, seq,
)

NO_GEOGRAPHY = "district_code not present — geographic detector unavailable"
TOO_FEW = "INSUFFICIENT_DATA for geographic comparison"
DISTRICT_HIGH = 0.3
CLUSTER_HIGH = 0.35
FEW_ROWS = 8


def districts(s: Survey, rates: DataFrame, national: float | None) -> DataFrame:
    minimum = detector_threshold(s.configs, "GEOGRAPHIC_DISTRICT", "min_records", 8)
    gap = detector_threshold(s.configs, "GEOGRAPHIC_DISTRICT", "pp_threshold", 0.2)
    delta = F.col("employment_rate") - F.lit(national).cast("double")
    return (
        scope_of(rates, "district")
        .where((F.col("n") >= minimum) & (F.abs(delta) >= gap))
        .select(*detection_fields(
            "GEOGRAPHIC_DISTRICT", "GEOGRAPHIC",
            entity_type=F.lit("district"), entity_id=F.col("group_id"),
            district_id=F.col("group_id"),
            severity=F.when(F.abs(delta) >= DISTRICT_HIGH, "HIGH").otherwise("MEDIUM"),
            field_name=F.lit("employment_rate"), observed_value=F.col("employment_rate"),
            expected_value=F.lit(national), deviation=delta, baseline_type=F.lit("national"),
            evidence=evidence_map(n_records=F.col("n"), peer_comparison=F.lit("unavailable")),
            seq=seq(3, 0, F.col("group_id")),
        ))
    )


def clusters(s: Survey, rates: DataFrame, national: float | None) -> DataFrame:
    minimum = detector_threshold(s.configs, "GEOGRAPHIC_CLUSTER", "min_records", 6)
    gap = detector_threshold(s.configs, "GEOGRAPHIC_CLUSTER", "pp_threshold", 0.25)
    groups = scope_of(rates, "cluster").join(district_baseline(rates), "district_id", "left")
    baseline = F.coalesce("district_rate", F.lit(national).cast("double"))
    delta = F.col("employment_rate") - baseline
    return (
        groups.where((F.col("n") >= minimum) & (F.abs(delta) >= gap))
        .select(*detection_fields(
            "GEOGRAPHIC_CLUSTER", "GEOGRAPHIC",
            entity_type=F.lit("cluster"), entity_id=F.col("group_id"),
            cluster_id=F.col("group_id"), district_id=F.col("district_id"),
            severity=F.when(F.abs(delta) >= CLUSTER_HIGH, "HIGH").otherwise("MEDIUM"),
            field_name=F.lit("employment_rate"), observed_value=F.col("employment_rate"),
            expected_value=baseline, deviation=delta,
            baseline_type=F.when(F.col("district_id").isNotNull(), "district")
            .otherwise("national"),
            evidence=evidence_map(n_records=F.col("n"),
                                  national_employment_rate=F.lit(national)),
            seq=seq(3, 1, F.col("group_id")),
        ))
    )


def geography(s: Survey, rates: DataFrame | None = None) -> Outcome:
    if not s.roles.district_id and not s.roles.cluster_id:
        return Outcome(False, reason=NO_GEOGRAPHY)
    rates = group_rates(s) if rates is None else rates
    whole = scope_of(rates, "dataset").first()
    national = whole["employment_rate"]
    found = no_detections(s.spark)
    if s.roles.district_id and detector_enabled(s.configs, "GEOGRAPHIC_DISTRICT"):
        found = found.unionByName(districts(s, rates, national))
    if s.roles.cluster_id and detector_enabled(s.configs, "GEOGRAPHIC_CLUSTER"):
        found = found.unionByName(clusters(s, rates, national))
    if whole["n"] < FEW_ROWS and found.isEmpty():
        return Outcome(False, reason=TOO_FEW)
    return Outcome(True, found)
