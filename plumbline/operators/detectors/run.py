"""All detector families over one batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import DetectorConfig
from plumbline.operators.detectors.common import Survey, group_rates, no_detections
from plumbline.operators.detectors.enumerator import enumerators
from plumbline.operators.detectors.geographic import geography
from plumbline.operators.detectors.pattern import cluster_patterns
from plumbline.operators.detectors.relationship import relationships
from plumbline.operators.detectors.shift import distribution_shift
from plumbline.operators.detectors.temporal import temporal


@dataclass(frozen=True)
class DetectorRun:
    detections: DataFrame
    available: list[str]
    skipped: dict[str, str]


def run_detectors(
    df: DataFrame,
    order: str | None = None,
    configs: dict[str, DetectorConfig] | None = None,
    enumerator_history: DataFrame | None = None,
    prior: DataFrame | None = None,
    source_batch: str = "",
    batch_id: str = "",
) -> DetectorRun:
    """A family that cannot look is named with its reason and emits nothing."""
    s = Survey.of(df, order, configs)
    rates = group_rates(s)
    outcomes = {
        "RELATIONSHIP": relationships(s),
        "ENUMERATOR": enumerators(s, rates, enumerator_history),
        "TEMPORAL": temporal(s),
        "GEOGRAPHIC": geography(s, rates),
        "PATTERN": cluster_patterns(s),
        "HISTORICAL": distribution_shift(s, prior, source_batch, batch_id),
    }
    found = no_detections(s.spark)
    for outcome in outcomes.values():
        if outcome.available:
            found = found.unionByName(outcome.detections)
    return DetectorRun(
        found,
        [name for name, o in outcomes.items() if o.available],
        {name: o.reason or "" for name, o in outcomes.items() if not o.available},
    )


def skipped_families(run: DetectorRun, spark) -> DataFrame:
    return spark.createDataFrame(list(run.skipped.items()), "family string, reason string")


def filter_detections(
    detections: DataFrame,
    detector_type: str | None = None,
    classification: str | None = None,
    baseline_type: str | None = None,
    entity_type: str | None = None,
    entity_id: str | None = None,
) -> DataFrame:
    wanted = {"detector_type": detector_type, "classification": classification,
              "baseline_type": baseline_type, "entity_type": entity_type,
              "entity_id": entity_id}
    for name, value in wanted.items():
        if value is not None:
            detections = detections.where(F.col(name) == value)
    return detections
