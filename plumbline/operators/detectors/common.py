"""The fixed shape every detector emits, and what detectors share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import DETECTORS, EXPLANATIONS, DetectorConfig
from plumbline.functions.answers import employed, missing_cells, unemployed
from plumbline.operators.profile import scope_sums
from plumbline.operators.roles import Roles, concept, detect_roles, role_text, row_order
from plumbline.plans.lookup import empty_frame, materialize

UNUSUAL = "UNUSUAL_PATTERN"

# ``seq`` is the place of a detection in the run: family, step, position, number.
DETECTION = (
    "entity_type string, entity_id string, record_id string, enumerator_id string, "
    "cluster_id string, district_id string, household_id string, detector_type string, "
    "category string, classification string, severity string, confidence double, "
    "review_required boolean, field_name string, observed_value double, expected_value double, "
    "deviation double, baseline_type string, explanation string, evidence map<string,string>, "
    "seq struct<family:int,step:int,position:string,number:int>"
)
NAMES = [part.strip().split(" ")[0] for part in DETECTION.split("seq struct")[0].split(", ")
         if part.strip()] + ["seq"]
NUMBERS = {"confidence", "observed_value", "expected_value", "deviation"}


@dataclass(frozen=True)
class Outcome:
    """What one family of detectors found, or why it could not look."""

    available: bool
    detections: DataFrame | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Survey:
    """A batch with its roles and concepts resolved once."""

    df: DataFrame
    roles: Roles
    order: Column
    configs: dict[str, DetectorConfig] = field(default_factory=lambda: dict(DETECTORS))

    @staticmethod
    def of(df: DataFrame, order: str | None = None,
           configs: dict[str, DetectorConfig] | None = None) -> Survey:
        roles = detect_roles(df)
        return Survey(df, roles, row_order(df, roles, order), configs or dict(DETECTORS))

    def concept(self, name: str) -> str | None:
        return concept(self.df, name)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def role(self, role: str) -> Column:
        return role_text(self.df, self.roles, role)


def no_detections(spark: SparkSession) -> DataFrame:
    return empty_frame(spark, DETECTION)


def evidence_map(**items: Column) -> Column:
    pairs = [x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def seq(family: int, step: int, position: Column, number: int | Column = 0) -> Column:
    n = number if isinstance(number, Column) else F.lit(number)
    return F.struct(F.lit(family).alias("family"), F.lit(step).alias("step"),
                    position.cast("string").alias("position"), n.cast("int").alias("number"))


def detection_fields(detector: str, category: str, *, text: str | None = None,
                     **given: Column) -> list[Column]:
    """Columns of a detection; anything not given is null or a default."""
    values = {
        "detector_type": F.lit(detector),
        "category": F.lit(category),
        "classification": F.lit(UNUSUAL),
        "severity": F.lit("MEDIUM"),
        "confidence": F.lit(0.6),
        "review_required": F.lit(True),
        "explanation": F.lit(EXPLANATIONS[text or detector]),
        **given,
    }
    out = []
    for name in NAMES:
        if name not in values:
            kind = "MAP<STRING,STRING>" if name == "evidence" else (
                "DOUBLE" if name in NUMBERS else "STRING")
            out.append(F.expr(f"CAST(NULL AS {kind}) AS {name}"))
        elif name in NUMBERS:
            out.append(values[name].cast("double").alias(name))
        else:
            out.append(values[name].alias(name))
    return out


def group_rates(survey: Survey) -> DataFrame:
    """Employment and missing cells per scope and group, and for the batch.

    One pass for all scopes; ``scope`` is enumerator, cluster, district or
    dataset. ``district_id`` is the district of the group's first record.
    """
    df, roles = survey.df, survey.roles
    status = survey.concept("employment")
    answer = F.col(status).cast("string") if status else F.lit(None).cast("string")
    counted = ("answered", "employed", "unemployed", "missing")
    rows = scope_sums(
        df, roles, survey.order,
        [answer.isNotNull().cast("long").alias("_answered"),
         employed(answer).cast("long").alias("_employed"),
         unemployed(answer).cast("long").alias("_unemployed"),
         missing_cells(df.columns).cast("long").alias("_missing")],
        [F.count(F.lit(1)).alias("n"),
         *[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in counted]])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *counted)]
    groups = rows.where(
        F.col("group_id").isNotNull() & (F.col("scope") != "dataset")
    ).groupBy("scope", "group_id").agg(
        *sums,
        F.min(F.when(F.col("_district").isNotNull(), F.struct("_first", "_district")))
        .alias("_first"),
    ).select("scope", "group_id", "n", *counted, F.col("_first._district").alias("district_id"))
    # A table without records has this row too.
    whole = rows.where("scope = 'dataset'").agg(*sums).select(
        F.lit("dataset").alias("scope"), F.lit("all").alias("group_id"), "n", *counted,
        F.lit(None).cast("string").alias("district_id"))
    cells = len(df.columns)
    return materialize(
        groups.unionByName(whole)
        .withColumn("employment_rate",
                    F.when(F.col("answered") > 0, F.col("employed") / F.col("answered")))
        .withColumn("missing_rate",
                    F.when(F.col("n") > 0, F.col("missing") / (F.col("n") * cells))
                    .otherwise(F.lit(0.0)))
    )


def scope_of(rates: DataFrame, scope: str) -> DataFrame:
    return rates.where(F.col("scope") == scope).drop("scope")


def district_baseline(rates: DataFrame) -> DataFrame:
    """(district_id, district_rate), one row per district."""
    return scope_of(rates, "district").select(
        F.col("group_id").alias("district_id"), F.col("employment_rate").alias("district_rate"))
