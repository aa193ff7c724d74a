"""Enumerators whose work differs from their district, batch or own past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import SIGNATURE_CONCEPTS, detector_enabled, detector_threshold
from plumbline.functions.answers import signature
from plumbline.operators.detectors.common import (
    Outcome, Survey, detection_fields, district_baseline, evidence_map, group_rates,
    scope_of, seq,
)

NO_COLUMN = "enumerator_id not present — enumerator detection unavailable"
TOO_FEW = "INSUFFICIENT_DATA: fewer than two enumerators"
HISTORY_GAP = 0.2


def answer_entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., entropy) from (by..., answer, count); two levels of grouping."""
    totals = counts.groupBy(*by).agg(
        F.sum("count").alias("_n"),
        F.sum(F.col("count") * F.log2("count")).alias("_c"),
    )
    # -sum(c/n * log2(c/n)) = log2(n) - sum(c * log2 c) / n
    return totals.select(*by, (F.log2("_n") - F.col("_c") / F.col("_n")).alias("entropy"))


def answer_counts(s: Survey) -> DataFrame:
    status = s.concept("employment")
    return (
        s.df.select(s.role("enumerator_id"), F.col(status).cast("string").alias("answer"))
        .where(F.col("answer").isNotNull())
        .groupBy("enumerator_id", "answer").agg(F.count(F.lit(1)).alias("count"))
    )


def repeated_signatures(s: Survey, role: str) -> DataFrame:
    """(role, n, top): records and size of the most frequent signature.

    Signatures are counted per (group, signature) first, so a hot group is
    spread over its signatures.
    """
    fields = [c for c in (s.concept(n) for n in SIGNATURE_CONCEPTS) if c]
    counted = (
        s.df.select(s.role(role), signature(s.df, fields).alias("_sig"))
        .where(F.col(role).isNotNull())
        .groupBy(role, "_sig").agg(F.count(F.lit(1)).alias("_c"))
    )
    return counted.groupBy(role).agg(F.sum("_c").alias("sig_n"), F.max("_c").alias("top"))


def enumerators(
    s: Survey, rates: DataFrame | None = None, history: DataFrame | None = None
) -> Outcome:
    """``history`` has (enumerator_id, employment_rate) of earlier batches."""
    if not s.roles.enumerator_id:
        return Outcome(False, reason=NO_COLUMN)
    rates = group_rates(s) if rates is None else rates
    facts = {r["scope"]: r for r in rates.groupBy("scope").agg(
        F.count(F.lit(1)).alias("groups"), F.max("employment_rate").alias("rate"),
        F.max("missing_rate").alias("missing")).collect()}
    if "enumerator" not in facts or facts["enumerator"]["groups"] < 2:
        return Outcome(False, reason=TOO_FEW)
    batch_rate, batch_missing = facts["dataset"]["rate"], facts["dataset"]["missing"]

    def on(detector: str) -> bool:
        return detector_enabled(s.configs, detector)

    def limit(detector: str, name: str, default: float) -> float:
        return detector_threshold(s.configs, detector, name, default)

    people = scope_of(rates, "enumerator").withColumnRenamed("group_id", "enumerator_id")
    if "district" in facts:
        people = people.join(district_baseline(rates), "district_id", "left")
    else:
        people = people.withColumn("district_rate", F.lit(None).cast("double"))
    batch_entropy = None
    people = people.withColumn("entropy", F.lit(None).cast("double"))
    if s.concept("employment") and on("ENUMERATOR_ENTROPY"):
        counts = answer_counts(s)
        whole = answer_entropy(
            counts.groupBy("answer").agg(F.sum("count").alias("count")), []).first()
        batch_entropy = whole["entropy"] if whole else None
        people = people.drop("entropy").join(
            answer_entropy(counts, ["enumerator_id"]), "enumerator_id", "left")
    if any(s.concept(c) for c in SIGNATURE_CONCEPTS) and on("PATTERN_ENUMERATOR_SIMILARITY"):
        people = people.join(repeated_signatures(s, "enumerator_id"), "enumerator_id", "left")
    else:
        people = people.withColumns({"sig_n": F.lit(None).cast("long"),
                                     "top": F.lit(None).cast("long")})
    if history is not None:
        past = history.where(F.col("employment_rate").isNotNull()).select(
            "enumerator_id", F.col("employment_rate").alias("prior_rate"))
        people = people.join(past, "enumerator_id", "left")
    else:
        people = people.withColumn("prior_rate", F.lit(None).cast("double"))

    own, baseline = F.col("employment_rate"), F.coalesce("district_rate", F.lit(batch_rate))
    share = F.col("top") / F.col("n")
    share_limit = limit("PATTERN_ENUMERATOR_SIMILARITY", "share_threshold", 0.6)

    def hit(number, detector, minimum, test, seen, expected, name, kind, text=None, **extra):
        fields = detection_fields(
            detector, "ENUMERATOR", text=text,
            entity_type=F.lit("enumerator"), entity_id=F.col("enumerator_id"),
            enumerator_id=F.col("enumerator_id"), district_id=F.col("district_id"),
            field_name=F.lit(name), observed_value=seen, expected_value=expected,
            deviation=seen - expected, baseline_type=kind,
            evidence=evidence_map(record_count=F.col("n"),
                                  batch_employment_rate=F.lit(batch_rate),
                                  district_employment_rate=F.col("district_rate"), **extra),
            seq=seq(1, 0, F.col("enumerator_id"), number),
        )
        return F.when(F.coalesce(test, F.lit(False)) & (F.col("n") >= minimum), F.struct(*fields))

    hits = []
    if on("ENUMERATOR_DEVIATION") and batch_rate is not None:
        hits.append(hit(
            0, "ENUMERATOR_DEVIATION", limit("ENUMERATOR_DEVIATION", "min_records", 8),
            F.abs(own - baseline) >= limit("ENUMERATOR_DEVIATION", "pp_threshold", 0.25),
            own, baseline, "employment_rate",
            F.when(F.col("district_rate").isNotNull(), "district").otherwise("batch")))
    if on("ENUMERATOR_MISSINGNESS"):
        hits.append(hit(
            1, "ENUMERATOR_MISSINGNESS", limit("ENUMERATOR_MISSINGNESS", "min_records", 8),
            F.abs(F.col("missing_rate") - F.lit(batch_missing))
            >= limit("ENUMERATOR_MISSINGNESS", "pp_threshold", 0.08),
            F.col("missing_rate"), F.lit(batch_missing), "missing_rate", F.lit("batch")))
    if batch_entropy:
        hits.append(hit(
            2, "ENUMERATOR_ENTROPY", limit("ENUMERATOR_ENTROPY", "min_records", 8),
            F.col("entropy") / F.lit(batch_entropy)
            <= limit("ENUMERATOR_ENTROPY", "entropy_ratio", 0.45),
            F.col("entropy"), F.lit(batch_entropy), "response_entropy", F.lit("batch")))
    hits.append(hit(
        3, "PATTERN_ENUMERATOR_SIMILARITY",
        limit("PATTERN_ENUMERATOR_SIMILARITY", "min_records", 8),
        share >= share_limit, share, F.lit(share_limit), "response_similarity",
        F.lit("enumerator_internal"), duplicate_signature_count=F.col("top")))
    hits.append(hit(
        4, "ENUMERATOR_DEVIATION", 1, F.abs(F.col("prior_rate") - own) >= HISTORY_GAP,
        own, F.col("prior_rate"), "employment_rate", F.lit("historical_enumerator"),
        text="ENUMERATOR_HISTORY"))
    found = (
        people.select(F.explode(F.array(*hits)).alias("_d"))
        .where(F.col("_d").isNotNull())
        .select("_d.*")
    )
    return Outcome(True, found)
