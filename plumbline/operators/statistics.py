"""Outlier evidence on numeric measures.

One grouping-sets aggregate gives counts, means and deviations for the whole
table and for every group of every scope. The table is then scanned once more:
dataset baselines are literals, group baselines are looked up, and all detectors
of a record are evaluated side by side. Records are never shuffled per group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import StatSettings
from plumbline.functions.answers import field_number
from plumbline.functions.order_stats import exact_quantiles
from plumbline.functions.scoring import robust_z, usable, z_severity, z_threshold
from plumbline.operators.roles import Roles, detect_roles, eligible_measures, id_columns
from plumbline.operators.rules import severity_counts
from plumbline.plans.lookup import empty_frame, lookup_join, materialize

EVIDENCE = (
    "record_id string, enumerator_id string, cluster_id string, district_id string, "
    "variable string, detector string, scope string, observed_value double, "
    "baseline_value double, baseline_std double, score double, threshold double, "
    "severity string, evidence struct<group_id:string, q1:double, q3:double, lower:double, "
    "upper:double, baseline_mean:double, source_batch_id:string, metric:string>"
)
DETAILS = ("group_id", "q1", "q3", "lower", "upper", "baseline_mean", "source_batch_id", "metric")
TEXT_DETAILS = ("group_id", "source_batch_id", "metric")


@dataclass(frozen=True)
class Baselines:
    """Dataset moments as numbers, group moments as one table per scope."""

    measures: list[str]
    dataset: dict[str, tuple[int, float | None, float | None]]
    groups: dict[str, DataFrame]
    sizes: dict[str, int]


def _details(**given) -> Column:
    return F.struct(*[
        (given[d] if d in given else F.lit(None))
        .cast("string" if d in TEXT_DETAILS else "double").alias(d)
        for d in DETAILS
    ])


def _hit(variable, detector, scope, observed, baseline, spread, score, threshold, severity,
         **details) -> Column:
    return F.struct(
        F.lit(variable).alias("variable"), F.lit(detector).alias("detector"),
        F.lit(scope).alias("scope"), observed.cast("double").alias("observed_value"),
        baseline.cast("double").alias("baseline_value"),
        spread.cast("double").alias("baseline_std"), score.cast("double").alias("score"),
        threshold.cast("double").alias("threshold"), severity.alias("severity"),
        _details(**details).alias("evidence"),
    )


def measure_baselines(
    df: DataFrame, roles: Roles, measures: list[str], scopes: list[str] | None = None
) -> Baselines:
    wanted = {s: c for s, c in roles.scopes.items() if scopes is None or s in scopes}
    numbers = df.select(
        *[F.col(c).alias(f"_g_{s}") for s, c in wanted.items()],
        *[field_number(df, m).alias(f"_m{i}") for i, m in enumerate(measures)],
    )
    moments = [
        e for i in range(len(measures)) for e in (
            F.count(f"_m{i}").alias(f"n{i}"), F.avg(f"_m{i}").alias(f"mean{i}"),
            F.stddev_samp(f"_m{i}").alias(f"std{i}"))
    ]
    keys = [f"_g_{s}" for s in wanted]
    if keys:
        table = numbers.groupingSets(
            [[F.col(k)] for k in keys] + [[]],
            *[F.col(k) for k in keys],
        ).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows"), *moments)
    else:
        table = numbers.agg(F.lit(0).alias("_set"), F.count(F.lit(1)).alias("_rows"), *moments)
    table = materialize(table)
    all_bits = (1 << len(keys)) - 1
    # The grouping id has a 1 for every key that is rolled up.
    ids = {s: all_bits ^ (1 << (len(keys) - 1 - i)) for i, s in enumerate(wanted)}
    summary = table.groupBy("_set").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.max(f"{p}{i}").alias(f"{p}{i}") for i in range(len(measures))
          for p in ("n", "mean", "std")],
    ).collect()  # one row per scope
    sizes = {r["_set"]: r["size"] for r in summary}
    total = next((r for r in summary if r["_set"] == all_bits), None)
    dataset = {
        m: (total[f"n{i}"], total[f"mean{i}"], total[f"std{i}"]) if total else (0, None, None)
        for i, m in enumerate(measures)
    }
    groups = {
        s: table.where((F.col("_set") == ids[s]) & F.col(f"_g_{s}").isNotNull()).select(
            F.col(f"_g_{s}").alias(c), F.col("_rows").alias(f"_rows_{s}"),
            *[F.col(f"{p}{i}").alias(f"_{s}_{p}{i}") for i in range(len(measures))
              for p in ("n", "mean", "std")])
        for s, c in wanted.items()
    }
    return Baselines(measures, dataset, groups, {s: sizes.get(ids[s], 0) for s in wanted})


def _z_hits(value: Column, m: str, base: tuple, s: StatSettings) -> list[tuple[Column, Column]]:
    n, mean, std = base
    if not n or n < s.min_observations or not std or abs(std) < s.std_epsilon or std != std:
        return []
    z = (value - F.lit(mean)) / F.lit(std)
    return [(F.abs(z) >= s.z_medium,
             _hit(m, "z_score", "dataset", value, F.lit(mean), F.lit(std), z,
                  z_threshold(F.abs(z), s), z_severity(F.abs(z), s)))]


def _iqr_hits(value: Column, m: str, base: tuple, quartiles, s: StatSettings):
    n, mean, _ = base
    if not n or n < s.min_observations or quartiles is None:
        return []
    q1, median, q3 = quartiles
    iqr = q3 - q1
    if abs(iqr) < s.std_epsilon:
        return []
    low_in, high_in = q1 - s.iqr_inner * iqr, q3 + s.iqr_inner * iqr
    low_out, high_out = q1 - s.iqr_outer * iqr, q3 + s.iqr_outer * iqr
    far = (value < low_out) | (value > high_out)
    return [((value < low_in) | (value > high_in),
             _hit(m, "iqr", "dataset", value, F.lit(median), F.lit(iqr), value,
                  F.when(far, F.lit(s.iqr_outer)).otherwise(F.lit(s.iqr_inner)),
                  F.when(far, "HIGH").otherwise("MEDIUM"),
                  q1=F.lit(q1), q3=F.lit(q3),
                  lower=F.when(far, F.lit(low_out)).otherwise(F.lit(low_in)),
                  upper=F.when(far, F.lit(high_out)).otherwise(F.lit(high_in)),
                  baseline_mean=F.lit(mean)))]


def _mad_hits(value: Column, m: str, base: tuple, median, mad, s: StatSettings):
    n, _, _ = base
    if not n or n < s.min_observations or mad is None or abs(mad) < s.std_epsilon:
        return []
    z = robust_z(value, F.lit(median), F.lit(mad))
    return [(F.abs(z) >= s.z_medium,
             _hit(m, "mad", "dataset", value, F.lit(median), F.lit(mad), z,
                  z_threshold(F.abs(z), s), z_severity(F.abs(z), s),
                  metric=F.lit("robust_z_score")))]


def _group_hits(value: Column, m: str, i: int, scope: str, key: Column, s: StatSettings):
    n, mean, std = (F.col(f"_{scope}_{p}{i}") for p in ("n", "mean", "std"))
    fit = (n >= s.min_group_observations) & usable(std, s.std_epsilon)
    z = F.when(fit, (value - mean) / std)
    return [(F.abs(z) >= s.z_medium,
             _hit(m, "group_z_score", scope, value, mean, std, z,
                  z_threshold(F.abs(z), s), z_severity(F.abs(z), s),
                  group_id=key.cast("string")))]


DEFAULT_DETECTORS = ("z_score", "iqr", "group_z_score")


def record_evidence(
    df: DataFrame,
    settings: StatSettings = StatSettings(),
    measures: list[str] | None = None,
    detectors: tuple[str, ...] = DEFAULT_DETECTORS,
    scopes: list[str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Evidence of single records: z-score, fences, group z-score, optional MAD."""
    roles = detect_roles(df)
    measures = eligible_measures(roles) if measures is None else measures
    if not measures:
        return empty_frame(df.sparkSession, EVIDENCE)
    grouped = "group_z_score" in detectors
    base = measure_baselines(df, roles, measures, scopes if grouped else [])
    columns = {m: field_number(df, m) for m in measures}
    quartiles, medians, mads = {}, {}, {}
    if "iqr" in detectors:
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    if "mad" in detectors:
        medians = {m: q and q[0] for m, q in exact_quantiles(df, columns, [0.5]).items()}
        off = {m: F.abs(columns[m] - F.lit(medians[m])) for m in measures
               if medians[m] is not None}
        mads = {m: q and q[0] for m, q in exact_quantiles(df, off, [0.5]).items()}

    source = df
    for scope, table in base.groups.items():
        source = lookup_join(source, table, [roles.scopes[scope]], weight=f"_rows_{scope}",
                             rows=base.sizes[scope])
    checks: list[tuple[Column, Column]] = []
    for i, m in enumerate(measures):
        value, stats = columns[m], base.dataset[m]
        if "z_score" in detectors:
            checks += _z_hits(value, m, stats, settings)
        if "mad" in detectors:
            checks += _mad_hits(value, m, stats, medians.get(m), mads.get(m), settings)
        if "iqr" in detectors:
            checks += _iqr_hits(value, m, stats, quartiles.get(m), settings)
        for scope in base.groups:
            checks += _group_hits(value, m, i, scope, F.col(roles.scopes[scope]), settings)
    if not checks:
        return empty_frame(df.sparkSession, EVIDENCE)
    flagged = [(F.coalesce(test, F.lit(False)), hit) for test, hit in checks]
    return (
        source.where(reduce(lambda a, b: a | b, [t for t, _ in flagged]))
        .select(*keep, *id_columns(df, roles),
                F.explode(F.array(*[F.when(t, h) for t, h in flagged])).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*keep, "record_id", "enumerator_id", "cluster_id", "district_id", "_e.*")
    )


def batch_baselines(df: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """(variable, mean, std): what later batches compare themselves with."""
    measures = eligible_measures(detect_roles(df)) if measures is None else measures
    if not measures:
        return empty_frame(df.sparkSession, "variable string, mean double, std double")
    rows = df.agg(*[
        F.struct(F.lit(m).alias("variable"), F.avg(field_number(df, m)).alias("mean"),
                 F.stddev_samp(field_number(df, m)).alias("std")).alias(f"_{i}")
        for i, m in enumerate(measures)
    ])
    return rows.select(
        F.explode(F.array(*[F.col(f"_{i}") for i in range(len(measures))])).alias("_b")
    ).select("_b.*")


def latest_baselines(history: DataFrame, batch_id: str) -> DataFrame:
    """Per variable the newest earlier baseline with a mean.

    ``history`` has (batch_id, created_at, variable, mean, std).
    """
    newest = F.struct("created_at", "batch_id", "mean", "std")
    return (
        history.where((F.col("batch_id") != batch_id) & F.col("mean").isNotNull())
        .groupBy("variable").agg(F.max(newest).alias("_b"))
        .select("variable", F.col("_b.mean").alias("hist_mean"),
                F.col("_b.std").alias("hist_std"),
                F.col("_b.batch_id").alias("source_batch_id"))
    )


def historical_shift(
    current: DataFrame, latest: DataFrame, settings: StatSettings = StatSettings()
) -> DataFrame:
    """Dataset evidence: this batch's means against the newest earlier ones."""
    s = settings
    # Both sides hold one row per numeric column.
    pairs = current.where(F.col("mean").isNotNull()).join(F.broadcast(latest), "variable")
    known = usable(F.col("hist_std"), s.std_epsilon)
    delta = F.col("mean") - F.col("hist_mean")
    z = delta / F.col("hist_std")
    relative = F.abs(delta) / F.greatest(F.abs("hist_mean"), F.lit(s.std_epsilon))
    scored = pairs.withColumn("_known", known).withColumn(
        "score", F.when(F.col("_known"), z).otherwise(relative))
    level = F.when(F.col("_known"), z_severity(F.abs("score"), s)).otherwise(
        F.when(F.col("score") >= s.relative_high, "HIGH")
        .when(F.col("score") >= s.relative_medium, "MEDIUM"))
    limit = F.when(F.col("_known"), z_threshold(F.abs("score"), s)).otherwise(
        F.when(F.col("score") >= s.relative_high, F.lit(s.relative_high))
        .otherwise(F.lit(s.relative_medium)))
    none = F.lit(None).cast("string")
    return (
        scored.withColumn("severity", level).where(F.col("severity").isNotNull())
        .select(
            *[none.alias(c) for c in ("record_id", "enumerator_id", "cluster_id", "district_id")],
            "variable", F.lit("historical_shift").alias("detector"),
            F.lit("dataset").alias("scope"), F.col("mean").alias("observed_value"),
            F.col("hist_mean").alias("baseline_value"), F.col("hist_std").alias("baseline_std"),
            "score", limit.alias("threshold"), "severity",
            _details(source_batch_id=F.col("source_batch_id"),
                     metric=F.when(~F.col("_known"), F.lit("relative_change"))).alias("evidence"),
        )
    )


def evaluate_statistics(
    df: DataFrame,
    history: DataFrame | None = None,
    batch_id: str = "",
    settings: StatSettings = StatSettings(),
    measures: list[str] | None = None,
    detectors: tuple[str, ...] = DEFAULT_DETECTORS,
) -> DataFrame:
    """Record evidence and, with earlier batches, dataset evidence."""
    evidence = record_evidence(df, settings, measures, detectors)
    if history is None:
        return evidence
    current = batch_baselines(df, measures)
    shift = historical_shift(current, latest_baselines(history, batch_id), settings)
    return evidence.unionByName(shift)


def statistics_summary(evidence: DataFrame, records: int, variables: int,
                       history: bool) -> DataFrame:
    return evidence.agg(
        F.count(F.lit(1)).alias("detections"), *severity_counts(evidence)
    ).select(
        F.lit(records).cast("long").alias("records_checked"),
        F.lit(variables).cast("long").alias("variables_checked"),
        "detections", "critical", "high", "medium", "low",
        F.lit(history).alias("historical_context_available"),
    )
