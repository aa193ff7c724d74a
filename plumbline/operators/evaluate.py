"""Predicted ids against labelled ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predicted: DataFrame, actual: DataFrame, key: str = "record_id") -> DataFrame:
    """One row: true/false positives, false negatives, precision, recall.

    Both sides are stacked and grouped by id, which also drops repeats.
    """
    sides = predicted.select(key, F.lit(1).alias("p"), F.lit(0).alias("a")).unionByName(
        actual.select(key, F.lit(0).alias("p"), F.lit(1).alias("a")))
    ids = sides.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max("p").alias("p"), F.max("a").alias("a"))
    counts = ids.agg(
        F.count_if((F.col("p") == 1) & (F.col("a") == 1)).alias("true_positives"),
        F.count_if((F.col("p") == 1) & (F.col("a") == 0)).alias("false_positives"),
        F.count_if((F.col("p") == 0) & (F.col("a") == 1)).alias("false_negatives"),
    )
    tp = F.col("true_positives")
    return counts.withColumns({
        "precision": F.coalesce(F.try_divide(tp, tp + F.col("false_positives")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, tp + F.col("false_negatives")), F.lit(0.0)),
    })


def evaluation_report(assessments: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` has (record_id, expect_rule): the intentionally unusual records."""
    refs = F.col("evidence_refs")
    seen = assessments.agg(
        F.count_if(refs["rule_violations"] > 0).alias("flagged_by_rules"),
        F.count_if(refs["statistical_evidence"] > 0).alias("flagged_by_statistics"),
        F.count_if(refs["ml_evidence"] > 0).alias("flagged_by_ml"),
        F.count(F.lit(1)).alias("fused_assessments"),
        F.count_if((refs["rule_violations"] > 0) | (refs["statistical_evidence"] > 0)
                   | (refs["ml_evidence"] > 0)).alias("detected_evidence"),
        F.count_if(F.col("anomaly_status") == "CONFIRMED").alias("confirmed_anomalies"),
        F.count_if(F.col("anomaly_status") == "REVIEW").alias("review_signals"),
    )
    labelled = labels.agg(F.count_distinct("record_id").alias("labelled"))
    result = confusion(
        assessments.where(F.col("anomaly_status") == "CONFIRMED"),
        labels.where("expect_rule"))
    one = F.lit(1).alias("_one")
    # Three one-row aggregates side by side.
    return (
        seen.select("*", one).join(labelled.select("*", one), "_one")
        .join(result.select("*", one), "_one")
        .withColumn("intentionally_clean", F.col("fused_assessments") - F.col("labelled"))
        .drop("_one")
    )
