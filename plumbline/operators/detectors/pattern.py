"""Clusters in which most records give the same answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import SIGNATURE_CONCEPTS, detector_enabled, detector_threshold
from plumbline.functions.answers import signature
from plumbline.operators.detectors.common import (
    Outcome, Survey, detection_fields, evidence_map, seq,
)

DISABLED = "CLUSTER_PATTERN disabled"
NO_CLUSTER = "cluster_id not present"
FEW_FIELDS = "Too few canonical fields for signatures"
MIN_FIELDS = 3


def cluster_patterns(s: Survey) -> Outcome:
    if not detector_enabled(s.configs, "CLUSTER_PATTERN"):
        return Outcome(False, reason=DISABLED)
    if not s.roles.cluster_id:
        return Outcome(False, reason=NO_CLUSTER)
    fields = [c for c in (s.concept(n) for n in SIGNATURE_CONCEPTS) if c]
    if len(fields) < MIN_FIELDS:
        return Outcome(False, reason=FEW_FIELDS)
    minimum = detector_threshold(s.configs, "CLUSTER_PATTERN", "min_records", 8)
    limit = detector_threshold(s.configs, "CLUSTER_PATTERN", "share_threshold", 0.7)
    counted = (
        s.df.select(
            s.role("cluster_id"), signature(s.df, fields).alias("_sig"),
            F.struct(s.order.alias("o"), s.role("record_id"), s.role("district_id"),
                     s.role("enumerator_id")).alias("_row"))
        .where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", "_sig")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_row"))
    )
    # Largest count first; among equals the signature that was seen first.
    best = F.min(F.struct((-F.col("_c")).alias("c"), F.col("_row").alias("row"),
                          F.col("_sig").alias("sig")))
    groups = counted.groupBy("cluster_id").agg(F.sum("_c").alias("n"), best.alias("_top"))
    top = -F.col("_top.c")
    share = top / F.col("n")
    found = groups.where((F.col("n") >= minimum) & (share >= limit)).select(*detection_fields(
        "CLUSTER_PATTERN", "PATTERN",
        entity_type=F.lit("cluster"), entity_id=F.col("cluster_id"),
        record_id=F.col("_top.row.record_id"), cluster_id=F.col("cluster_id"),
        district_id=F.col("_top.row.district_id"),
        enumerator_id=F.col("_top.row.enumerator_id"),
        field_name=F.lit("response_signature"), observed_value=share,
        expected_value=F.lit(limit), deviation=share - F.lit(limit),
        baseline_type=F.lit("cluster_internal"),
        evidence=evidence_map(duplicate_signature_count=top, near_duplicate_count=top,
                              n_records=F.col("n"), signature=F.col("_top.sig")),
        seq=seq(4, 0, F.col("cluster_id")),
    ))
    return Outcome(True, found)
