"""Unusual combinations of answers within a record or a household."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import (
    INCOME_PARTS, ROLE_CANDIDATES, detector_enabled, detector_threshold,
)
from plumbline.functions.answers import field_number, field_text, not_working
from plumbline.operators.detectors.common import (
    Outcome, Survey, detection_fields, evidence_map, no_detections, seq,
)

HEADS = ("head", "household head", "hhh")
ADVANCED = "postgrad|phd|doctor|master"
AGE_SPAN = 90
FIELDS = ("age", "marital", "education", "employment", "hours", "income", "role")
NO_FIELDS = "No relationship fields present"


def _record_checks(s: Survey) -> list[tuple[str, int, Column, str, Column, float, Column]]:
    """(detector, place, test, field, observed, expected, evidence) per check."""
    df = s.df

    def number(name: str) -> Column:
        c = s.concept(name)
        return field_number(df, c) if c else F.lit(None).cast("double")

    def text(name: str) -> Column:
        c = s.concept(name)
        return field_text(df, c) if c else F.lit("")

    def limit(detector: str, name: str, default: float) -> float:
        return detector_threshold(s.configs, detector, name, default)

    age, hours, income = number("age"), number("hours"), number("income")
    marital, education = text("marital"), text("education")
    status, role = text("employment"), text("role")
    marriage = limit("REL_AGE_MARITAL", "min_marriage_age", 18)
    degree = limit("REL_AGE_EDUCATION", "postgraduate_min_age", 20)
    idle = limit("REL_EMPLOYMENT_HOURS", "not_working_hours_threshold", 10)
    head = limit("REL_AGE_HOUSEHOLD_ROLE", "min_head_age", 16)
    rich = limit("REL_INCOME_EMPLOYMENT", "unemployed_high_income", 80000)
    checks = [
        ("REL_AGE_MARITAL",
         (age < marriage) & marital.contains("married") & ~marital.rlike("unmarried|never"),
         s.concept("age") or "age", age, marriage, {"marital_status": marital}),
        ("REL_AGE_EDUCATION", (age < degree) & education.rlike(ADVANCED),
         s.concept("education") or "education", age, degree, {"education": education}),
        ("REL_EMPLOYMENT_HOURS", not_working(status) & (hours > idle),
         s.concept("hours") or "working_hours", hours, idle, {"employment_status": status}),
        ("REL_AGE_HOUSEHOLD_ROLE", (age < head) & role.isin(*HEADS),
         s.concept("role") or "household_role", age, head, {"household_role": role}),
        ("REL_INCOME_EMPLOYMENT", status.contains("unemploy") & (income >= rich),
         s.concept("income") or "income", income, rich, {"employment_status": status}),
        ("REL_HOURS_EMPLOYMENT", (hours > 0) & not_working(status),
         s.concept("hours") or "working_hours", hours, 0.0, {"employment_status": status}),
    ]
    return [
        (d, i, F.coalesce(test, F.lit(False)), name, seen, float(expected),
         evidence_map(**extra, rule_id=F.lit(f"RULE_REL_{i:03d}")))
        for i, (d, test, name, seen, expected, extra) in enumerate(checks, start=1)
        if detector_enabled(s.configs, d)
    ]


def record_relationships(s: Survey) -> DataFrame:
    """All record checks in one pass over the table."""
    checks = _record_checks(s)
    if not checks:
        return no_detections(s.spark)
    household = s.concept("household")
    hits = []
    for detector, place, test, name, seen, expected, extra in checks:
        hits.append(F.when(test, F.struct(*detection_fields(
            detector, "RELATIONSHIP",
            entity_type=F.lit("record"),
            entity_id=F.coalesce(s.role("record_id"), F.lit("unknown")),
            **{r: s.role(r) for r in ROLE_CANDIDATES},
            household_id=F.col(household).cast("string") if household else F.lit(None).cast("string"),
            field_name=F.lit(name), observed_value=seen, expected_value=F.lit(expected),
            deviation=seen - F.lit(expected), baseline_type=F.lit("relationship_rule"),
            evidence=extra, seq=seq(0, 0, s.order, place),
        ))))
    return (
        s.df.where(reduce(lambda a, b: a | b, [c[2] for c in checks]))
        .select(F.explode(F.array(*hits)).alias("_d"))
        .where(F.col("_d").isNotNull())
        .select("_d.*")
    )


def household_consistency(s: Survey) -> DataFrame:
    """Households with several heads, or with ages more than 90 years apart.

    Identifiers come from the first record of the household.
    """
    household, role, age = s.concept("household"), s.concept("role"), s.concept("age")
    if not household or not detector_enabled(s.configs, "REL_HOUSEHOLD_CONSISTENCY"):
        return no_detections(s.spark)
    key = F.col(household).cast("string")
    rows = s.df.select(
        key.alias("household_id"),
        (F.lower(F.col(role).cast("string")).isin(*HEADS) if role else F.lit(False))
        .alias("_head"),
        (field_number(s.df, age) if age else F.lit(None).cast("double")).alias("_age"),
        F.struct(s.order.alias("o"), *[s.role(r) for r in
                                       ("enumerator_id", "cluster_id", "district_id")])
        .alias("_ids"),
    ).where(F.col("household_id").isNotNull() & ~F.col("household_id").isin("nan", "None", ""))
    homes = rows.groupBy("household_id").agg(
        F.count_if("_head").alias("heads"),
        F.count("_age").alias("ages"),
        (F.max("_age") - F.min("_age")).alias("span"),
        F.min("_ids").alias("_ids"),
    ).where((F.col("heads") > 1) | ((F.col("ages") >= 2) & (F.col("span") > AGE_SPAN)))
    rule = F.lit("RULE_REL_007")
    common = dict(
        entity_type=F.lit("household"), entity_id=F.col("household_id"),
        household_id=F.col("household_id"), cluster_id=F.col("_ids.cluster_id"),
        district_id=F.col("_ids.district_id"), baseline_type=F.lit("household_structure"),
    )
    heads = F.struct(*detection_fields(
        "REL_HOUSEHOLD_CONSISTENCY", "RELATIONSHIP", text="HOUSEHOLD_HEADS", **common,
        enumerator_id=F.col("_ids.enumerator_id"), field_name=F.lit(role),
        observed_value=F.col("heads"), expected_value=F.lit(1.0),
        deviation=F.col("heads") - F.lit(1.0),
        evidence=evidence_map(rule_id=rule, head_count=F.col("heads")),
        seq=seq(0, 1, F.col("household_id"), 0),
    ))
    span = F.struct(*detection_fields(
        "REL_HOUSEHOLD_CONSISTENCY", "RELATIONSHIP", text="HOUSEHOLD_AGES", **common,
        severity=F.lit("LOW"), field_name=F.lit(age),
        observed_value=F.col("span"), expected_value=F.lit(float(AGE_SPAN)),
        evidence=evidence_map(rule_id=rule), seq=seq(0, 1, F.col("household_id"), 1),
    ))
    return (
        homes.select(F.explode(F.array(
            F.when(F.col("heads") > 1, heads),
            F.when((F.col("ages") >= 2) & (F.col("span") > AGE_SPAN), span),
        )).alias("_d"))
        .where(F.col("_d").isNotNull())
        .select("_d.*")
    )


def arithmetic_consistency(s: Survey) -> DataFrame:
    """A stated total that differs from the sum of its parts."""
    total = s.concept("total_income")
    parts = [p for p in INCOME_PARTS if p in s.df.columns]
    if not total or not parts or not detector_enabled(s.configs, "REL_ARITHMETIC"):
        return no_detections(s.spark)
    tolerance = detector_threshold(s.configs, "REL_ARITHMETIC", "tolerance", 1.0)
    stated = field_number(s.df, total)
    summed = reduce(lambda a, b: a + b,
                    [F.coalesce(field_number(s.df, p), F.lit(0.0)) for p in parts])
    household = s.concept("household")
    return s.df.where(F.abs(stated - summed) > tolerance).select(*detection_fields(
        "REL_ARITHMETIC", "RELATIONSHIP",
        entity_type=F.lit("record"),
        entity_id=F.coalesce(s.role("record_id"), F.lit("unknown")),
        **{r: s.role(r) for r in ROLE_CANDIDATES},
        household_id=F.col(household).cast("string") if household else F.lit(None).cast("string"),
        field_name=F.lit(total), observed_value=stated, expected_value=summed,
        deviation=stated - summed, baseline_type=F.lit("relationship_rule"),
        evidence=evidence_map(rule_id=F.lit("RULE_REL_008"), components=F.lit(",".join(parts))),
        seq=seq(0, 2, s.order, 0),
    ))


def relationships(s: Survey) -> Outcome:
    if not any(s.concept(f) for f in FIELDS):
        return Outcome(False, reason=NO_FIELDS)
    found = record_relationships(s).unionByName(household_consistency(s))
    return Outcome(True, found.unionByName(arithmetic_consistency(s)))
