"""Evidence of all sources -> one assessment per record.

Records and evidence are stacked in one narrow shape and grouped by record id
once. Every per-record quantity is a sum, a maximum or a small set, so a record
id that occurs very often is combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import (
    ESCALATION_REASON, RULE_SCORES, SEVERITY_RANK, SOURCES, STAT_SCORES, FusionSettings,
)
from plumbline.functions import scoring
from plumbline.functions.values import id_text
from plumbline.operators.roles import detect_roles, role_text
from plumbline.plans import lookup
from plumbline.plans.lookup import lookup_join, materialize

IDS = ("enumerator_id", "cluster_id", "district_id")
GROUP_ROLES = ("enumerator_id", "cluster_id")
TYPES = "array<struct<seq:struct<family:int,step:int,position:string,number:int>,type:string>>"


def record_ids(df: DataFrame) -> DataFrame:
    """(record_id, group ids) of every record that has an id."""
    roles = detect_roles(df)
    names = ["record_id", *IDS]
    rows = df.select(*[id_text(role_text(df, roles, r)).alias(r) for r in names])
    return rows.where(F.col("record_id").isNotNull())


def _part(df: DataFrame, rank: int, source: str, score: Column, severity: Column,
          code: Column | None = None, variable: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.where(F.col("record_id") != "").select(
        "record_id", *IDS, F.lit(rank).alias("_rank"), F.lit(source).alias("_source"),
        score.cast("double").alias("_score"), scoring.severity_rank(severity).alias("_level"),
        (none if code is None else code).alias("_code"),
        (none if variable is None else variable).alias("_variable"),
        F.lit(None).cast(TYPES.removeprefix("array<").removesuffix(">")).alias("_type"),
    )


def record_types(detections: DataFrame) -> DataFrame:
    """One row per record and detector type, with its first place in the run."""
    return (
        detections.where(F.col("record_id").isNotNull())
        .groupBy("record_id", "detector_type").agg(F.min("seq").alias("seq"))
    )


def group_types(detections: DataFrame) -> DataFrame:
    """(role, id, types): detector types met by an enumerator or a cluster, in
    order of appearance. At most one entry per detector type."""
    reached = F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).alias("id")) for r in GROUP_ROLES]))
    firsts = (
        detections.select(reached.alias("_g"), "detector_type", "seq")
        .where(F.col("_g.id").isNotNull())
        .groupBy("_g.role", "_g.id", "detector_type").agg(F.min("seq").alias("seq"))
    )
    return firsts.groupBy("role", "id").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.col("detector_type").alias("type"))))
        .alias("types"))


def fuse(
    records: DataFrame,
    rules: DataFrame | None = None,
    statistics: DataFrame | None = None,
    ml: DataFrame | None = None,
    detections: DataFrame | None = None,
    history: bool = False,
    settings: FusionSettings = FusionSettings(),
) -> DataFrame:
    """Assessments of all records in ``records`` (see ``record_ids``) or evidence.

    A source given as None was not available: it is left out and the weights of
    the others grow accordingly. ``detections`` are read more than once: pass a
    stored or materialised table.
    """
    s = settings
    none = F.lit(None).cast("string")
    parts = [_part(records, 4, "", F.lit(None), none)]
    if rules is not None:
        parts.append(_part(rules, 1, "rules",
                           scoring.pick(F.upper("severity"), RULE_SCORES, 0.0),
                           F.col("severity"), code=F.col("rule_code")))
    if statistics is not None:
        parts.append(_part(
            statistics, 2, "statistics", scoring.pick(F.upper("severity"), STAT_SCORES, 0.0),
            F.col("severity"),
            variable=F.when(F.upper("severity").isin("HIGH", "CRITICAL"), F.col("variable"))))
    if ml is not None:
        clipped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("anomaly_score")))
        parts.append(_part(ml, 3, "ml", F.coalesce(clipped, F.lit(0.0)), F.col("severity")))
    if detections is not None:
        parts.append(record_types(detections).select(
            "record_id", *[none.alias(i) for i in IDS], F.lit(9).alias("_rank"),
            F.lit("detections").alias("_source"), F.lit(None).cast("double").alias("_score"),
            F.lit(0).alias("_level"), none.alias("_code"), none.alias("_variable"),
            F.struct("seq", F.col("detector_type").alias("type")).alias("_type")))
    available = [n for n, given in zip(SOURCES, (rules, statistics, ml)) if given is not None]

    sums = []
    for n in available:
        own = F.col("_source") == n
        sums += [
            F.count_if(own).alias(f"_n_{n}"),
            F.max(F.when(own, F.col("_score"))).alias(f"_max_{n}"),
            F.sum(F.when(own, F.col("_score"))).alias(f"_sum_{n}"),
            F.max(F.when(own, F.col("_level"))).alias(f"_level_{n}"),
        ]
    grouped = reduce(DataFrame.unionByName, parts).groupBy("record_id").agg(
        # Evidence names the groups first, in source order, then the record.
        *[F.min(F.when(F.coalesce(F.col(i), F.lit("")) != "", F.struct("_rank", i)))
          .getField(i).alias(i) for i in IDS],
        *sums,
        F.count_if(F.col("_rank") < 9).alias("_known"),
        F.sort_array(F.collect_set("_code")).alias("rule_codes"),
        F.sort_array(F.collect_set("_variable")).alias("high_stat_variables"),
        F.array_sort(F.collect_set("_type")).alias("_record_types"),
    ).where(F.col("_known") > 0).withColumns({
        f"_n_{n}": F.lit(0).cast("bigint") for n in SOURCES if n not in available})

    scores = {n: F.col(f"_score_{n}") for n in available}
    levels = {n: F.col(f"_severity_{n}") for n in available}
    for n in available:
        grouped = grouped.withColumns({
            f"_score_{n}": scoring.capped_total(F.col(f"_max_{n}"), F.col(f"_sum_{n}"),
                                                s.remainder),
            f"_severity_{n}": scoring.severity_name(F.coalesce(f"_level_{n}", F.lit(0))),
        })
    agreed = scoring.agreement(scores, levels, s)
    risk = scoring.weighted_risk(scores, s) if available else F.lit(0.0)
    weighed = grouped.withColumns({
        "_risk": risk, "agreement": agreed,
        "escalation_applied": scoring.high_sources(levels) >= s.escalation_sources,
    }).withColumn("_base", scoring.risk_severity(F.col("_risk"), s))
    lifted = F.col("escalation_applied") & F.col("_base").isin("LOW", "MEDIUM")

    hard = F.exists("rule_codes", lambda c: scoring.is_hard_code(c, s))
    lookup = F.exists("rule_codes", scoring.is_lookup_code)
    stat = F.col("_n_statistics") > 0
    odd = F.col("_n_ml") > 0
    status = (F.when(hard, "CONFIRMED").when(stat | odd, "REVIEW").otherwise("NORMAL"))
    reason = (
        F.when(hard, "hard_rule_violation")
        .when(stat & odd, "unusual_without_validity_violation")
        .when(stat, "statistics_only_unusual")
        .when(odd, "ml_only_unusual")
        .when(lookup, "demo_reference_list_miss")
        .otherwise("none")
    )
    confidence = F.bround(
        scoring.confidence(len(available), F.col("agreement"), history), 2)

    def texts(names):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    assessed = weighed.withColumns({
        "risk_score": F.bround(
            F.when(lifted, F.greatest(F.col("_risk"), F.lit(s.risk_high)))
            .otherwise(F.col("_risk")), 2),
        "severity": F.when(lifted, "HIGH").otherwise(F.col("_base")),
        "confidence": confidence,
        "available_sources": texts(available),
        "missing_sources": texts([n for n in SOURCES if n not in available]),
        "source_scores": F.map_from_arrays(
            texts(available),
            F.array(*[F.bround(c, 2) for c in scores.values()]).cast("array<double>")),
        "source_severities": F.map_from_arrays(
            texts(available), F.array(*levels.values()).cast("array<string>")),
        "escalation_reason": F.when(F.col("escalation_applied"), ESCALATION_REASON),
        "methodology_version": F.lit(s.methodology_version),
        "anomaly_status": status, "classification_reason": reason,
        "rule_violations": F.col("_n_rules"), "statistical_evidence": F.col("_n_statistics"),
        "ml_evidence": F.col("_n_ml"),
    })
    if detections is None:
        assessed = assessed.withColumn("detectors", F.array().cast("array<string>"))
    else:
        assessed = _attach_groups(assessed, detections)
    return _classified(assessed)


def _attach_groups(assessed: DataFrame, detections: DataFrame) -> DataFrame:
    """Detector types of the record, then of its enumerator, then its cluster.

    Only pre-aggregated type lists are joined, one entry per group.
    """
    out = assessed
    types = materialize(group_types(detections))
    sizes = {r["role"]: r["count"] for r in types.groupBy("role").count().collect()}
    for role in GROUP_ROLES:
        table = types.where(F.col("role") == role).select(
            F.col("id").alias(role), F.col("types").alias(f"_{role}_types"))
        size, weight = sizes.get(role, 0), None
        if size > lookup.BROADCAST_ROWS:
            # Records per group tell which groups are hot.
            counts = assessed.where(F.col(role).isNotNull()).groupBy(role).agg(F.count(F.lit(1)).alias("_records"))
            weight = "_records"
            table = materialize(table.join(counts, role, "left").fillna(0, [weight]))
        out = lookup_join(out, table, [role], weight, size).drop("_records")
    empty = F.array().cast(TYPES)
    names = F.concat(*[
        F.transform(F.coalesce(c, empty), lambda t: t["type"])
        for c in (F.col("_record_types"), F.col("_enumerator_id_types"),
                  F.col("_cluster_id_types"))
    ])
    return out.withColumn("detectors", F.array_distinct(names))


def _classified(df: DataFrame) -> DataFrame:
    n = F.size("detectors")
    first = F.get("detectors", F.lit(0))
    status = F.col("anomaly_status")
    review = status == "REVIEW"
    confirmed = status == "CONFIRMED"
    return df.withColumns({
        "intelligence_classification":
            F.when(confirmed, "VALIDATION_ERROR")
            .when(review & (n >= 2), "INVESTIGATION_REQUIRED")
            .when(review, "UNUSUAL_PATTERN").otherwise("INFORMATIONAL"),
        "primary_detector":
            F.when(confirmed, F.lit("HARD_RULE"))
            .when(review, F.coalesce(first, F.lit("STATISTICAL_OUTLIER"))).otherwise(first),
        "detector_count":
            F.when(confirmed, n + 1).when(review, F.greatest(n, F.lit(1))).otherwise(n),
        "review_required": confirmed | review,
    }).select(
        "record_id", *IDS, "risk_score", "severity", "confidence", "agreement",
        "available_sources", "missing_sources", "source_scores", "source_severities",
        "escalation_applied", "escalation_reason", "methodology_version",
        F.struct("rule_codes", "rule_violations", "statistical_evidence", "ml_evidence",
                 "high_stat_variables", "detectors").alias("evidence_refs"),
        "anomaly_status", "classification_reason", "intelligence_classification",
        "primary_detector", "detector_count", "review_required",
    )


def dataset_context(
    statistics: DataFrame, history: bool = False, settings: FusionSettings = FusionSettings()
) -> DataFrame:
    """Score of the evidence no record owns; never part of a record's risk.

    No row when there is none.
    """
    score = scoring.pick(F.upper("severity"), STAT_SCORES, 0.0)
    total = statistics.where(F.coalesce("record_id", F.lit("")) == "").agg(
        F.count(F.lit(1)).alias("evidence"), F.max(score).alias("_max"),
        F.sum(score).alias("_sum"), F.max(scoring.severity_rank(F.col("severity"))).alias("_level"))
    return total.where(F.col("evidence") > 0).select(
        F.lit("dataset").alias("scope"),
        F.bround(scoring.capped_total(F.col("_max"), F.col("_sum"), settings.remainder), 2)
        .alias("context_score"),
        scoring.severity_name(F.col("_level")).alias("severity"),
        F.bround(scoring.confidence(1, F.lit("single_source"), history), 2).alias("confidence"),
        F.lit("single_source").alias("agreement"), "evidence",
        F.lit(settings.methodology_version).alias("methodology_version"),
        F.lit(True).alias("not_a_record_risk"),
    )


def fusion_summary(assessments: DataFrame) -> DataFrame:
    return assessments.agg(
        F.count(F.lit(1)).alias("records_assessed"),
        *[F.count_if(F.col("severity") == x).alias(x.lower())
          for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count_if(F.col("anomaly_status") == "CONFIRMED").alias("confirmed_anomalies"),
        F.count_if(F.col("anomaly_status") == "REVIEW").alias("review_signals"),
    )


def classification_trace(assessments: DataFrame) -> DataFrame:
    refs = F.col("evidence_refs")
    return assessments.select(
        "record_id", "risk_score", "severity",
        (refs["rule_violations"] > 0).alias("rule_signal"),
        (refs["statistical_evidence"] > 0).alias("statistics_signal"),
        (refs["ml_evidence"] > 0).alias("ml_signal"), "agreement", "anomaly_status",
        F.col("classification_reason").alias("anomaly_reason"),
        refs["rule_codes"].alias("rule_codes"),
    )


def severity_order(c: Column) -> Column:
    """0 for CRITICAL ... 3 for LOW, 4 otherwise."""
    return F.when(F.upper(c).isin("CRITICAL", "HIGH", "MEDIUM", "LOW"),
                  SEVERITY_RANK["CRITICAL"] - scoring.severity_rank(c)).otherwise(4)
