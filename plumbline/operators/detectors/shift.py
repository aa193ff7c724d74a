"""Distribution changes against an earlier batch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import detector_enabled, detector_threshold
from plumbline.functions.answers import field_number
from plumbline.functions.order_stats import exact_quantiles
from plumbline.operators.detectors.common import (
    Outcome, Survey, detection_fields, evidence_map, seq,
)
from plumbline.operators.profile import TOP_VALUES, category_counts, top_values

DISABLED = "DISTRIBUTION_SHIFT disabled"
NO_PRIOR = "INSUFFICIENT HISTORICAL DATA — no prior variable profiles"
MIN_VALUES = 8
PSI_BINS = 8
PSI_SMOOTHING = 1e-6


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def prior_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """(variable, value, count) an earlier batch is remembered by: all values, or the
    ``top`` most frequent of each column."""
    counts = category_counts(df, text_columns(df)).where(F.col("value").isNotNull())
    if top is None:
        return counts
    return top_values(counts, ["variable"], top).drop("position")


def variation_distance(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(variable, prior_n, current_n, distance) for variables on both sides.

    Both sides are counts, so they are stacked and grouped rather than joined.
    The last grouping needs every total first; it has one row per variable.
    """
    both = prior.select("variable", "value", F.col("count").alias("e"), F.lit(0).alias("a"))
    both = both.unionByName(
        current.select("variable", "value", F.lit(0).cast("bigint").alias("e"),
                       F.col("count").alias("a")))
    cells = both.groupBy("variable", "value").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    totals = cells.groupBy("variable").agg(
        F.sum("e").alias("prior_n"), F.sum("a").alias("current_n"))
    # One row per column of the table.
    return (
        cells.join(F.broadcast(totals), "variable")
        .groupBy("variable", "prior_n", "current_n")
        .agg((F.lit(0.5) * F.sum(F.abs(
            F.col("a") / F.greatest("current_n", F.lit(1))
            - F.col("e") / F.greatest("prior_n", F.lit(1))))).alias("distance"))
    )


def distribution_shift(
    s: Survey, prior: DataFrame | None, source_batch: str = "", batch_id: str = ""
) -> Outcome:
    """``prior`` as given by ``prior_counts`` of the latest earlier batch."""
    if not detector_enabled(s.configs, "DISTRIBUTION_SHIFT"):
        return Outcome(False, reason=DISABLED)
    if prior is None:
        return Outcome(False, reason=NO_PRIOR)
    limit = detector_threshold(s.configs, "DISTRIBUTION_SHIFT", "tvd_threshold", 0.35)
    current = category_counts(s.df, text_columns(s.df)).where(F.col("value").isNotNull())
    shifted = variation_distance(prior, current).where(
        (F.col("prior_n") >= MIN_VALUES) & (F.col("current_n") >= MIN_VALUES)
        & (F.col("distance") >= limit))
    return Outcome(True, shifted.select(*detection_fields(
        "DISTRIBUTION_SHIFT", "HISTORICAL",
        entity_type=F.lit("district"), entity_id=F.lit(batch_id),
        field_name=F.col("variable"), observed_value=F.col("distance"),
        expected_value=F.lit(limit), deviation=F.col("distance"),
        baseline_type=F.lit("historical_batch"),
        evidence=evidence_map(metric=F.lit("total_variation_distance"),
                              source_batch_id=F.lit(source_batch)),
        seq=seq(5, 0, F.col("variable")),
    )))


def stability_index(
    prior: DataFrame, current: DataFrame, measures: list[str], bins: int = PSI_BINS
) -> DataFrame:
    """(variable, psi): population stability index over quantile bins of ``prior``.

    Null with fewer than eight values on a side or fewer than three edges. The
    last bin includes its upper edge; values outside the edges are left out.
    """
    spark = prior.sparkSession
    edges = exact_quantiles(prior, {m: field_number(prior, m) for m in measures},
                            [i / bins for i in range(bins + 1)])
    cuts = {m: sorted(set(q)) if q else [] for m, q in edges.items()}

    def histogram(df: DataFrame, side: str) -> dict:
        exprs = []
        for i, m in enumerate(measures):
            v, c = field_number(df, m), cuts[m]
            exprs.append(F.count(v).alias(f"n{i}"))
            for b in range(len(c) - 1):
                upper = v <= c[b + 1] if b == len(c) - 2 else v < c[b + 1]
                exprs.append(F.count_if((v >= c[b]) & upper).alias(f"b{i}_{b}"))
        return df.agg(*exprs).first().asDict()  # bins x measures numbers

    old, new = histogram(prior, "e"), histogram(current, "a")
    rows = []
    for i, m in enumerate(measures):
        k = len(cuts[m]) - 1
        if old[f"n{i}"] < MIN_VALUES or new[f"n{i}"] < MIN_VALUES or k < 2:
            rows.append((m, None))
            continue

        def shares(h):
            counts = [h[f"b{i}_{b}"] for b in range(k)]
            total = sum(counts) + PSI_SMOOTHING * k
            return [(c + PSI_SMOOTHING) / total for c in counts]

        rows.append((m, sum((a - e) * math.log(a / e) for e, a in zip(shares(old), shares(new)))))
    return spark.createDataFrame(rows, "variable string, psi double")
