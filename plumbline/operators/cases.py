"""Investigation cases as an append-only action log.

Log: (action_id, batch_id, record_id, ts, user, action, status, priority,
assigned_to, note). ``action`` is CREATE, ADD_NOTE, UPDATE or one of the known
actions; ``status`` is only used by UPDATE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import CASE_ACTIONS, CASE_PRIORITIES, CASE_RESOLVED, CASE_STATUSES
from plumbline.functions.scoring import pick
from plumbline.functions.sequences import neighbours
from plumbline.plans.lookup import lookup_join, materialize, null_safe_join

CASE = ["batch_id", "record_id"]


def new_status(log: DataFrame) -> Column:
    """Status an entry sets, or null when it changes none."""
    action = F.col("action")
    return (
        F.when(action == "CREATE", F.lit("OPEN"))
        .when(action.isin(*CASE_ACTIONS), pick(action, CASE_ACTIONS))
        .when((action == "UPDATE") & F.col("status").isin(*CASE_STATUSES), F.col("status"))
    )


def priority(severity: Column, requested: Column) -> Column:
    return F.coalesce(
        F.when(requested.isin(*CASE_PRIORITIES), requested),
        F.when(severity.isin(*CASE_PRIORITIES), severity),
        F.lit("MEDIUM"),
    )


def first_creations(log: DataFrame) -> DataFrame:
    """Log with one CREATE per case; later ones are dropped."""
    place = F.struct("ts", "action_id")
    first = log.where(F.col("action") == "CREATE").groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("_creations"), F.min(place).alias("_first"))
    joined = lookup_join(log, materialize(first), CASE, weight="_creations")
    repeat = (F.col("action") == "CREATE") & (F.struct("ts", "action_id") > F.col("_first"))
    return joined.where(~F.coalesce(repeat, F.lit(False))).select(*log.columns)


def current_cases(log: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    """One row per case.

    ``resolved_at`` is the first time of the last resolved stretch; a reopened
    case has none. ``assessments`` (batch_id, record_id, severity, enumerator_id,
    district_id) gives the default priority and the group ids.
    """
    place = F.struct("ts", "action_id")
    log = first_creations(log)
    entries = log.withColumn("new_status", new_status(log))
    changes = F.col("new_status").isNotNull()
    resolved = F.col("new_status").isin(*CASE_RESOLVED)

    def last(name: str, test: Column | None = None) -> Column:
        kept = F.col(name).isNotNull() if test is None else test
        return F.max(F.when(kept, F.struct("ts", "action_id", name))).getField(name).alias(name)

    heads = entries.groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("actions"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        last("new_status"), last("priority"), last("assigned_to"),
        last("note"), last("action", F.col("action").isin(*CASE_ACTIONS)),
        F.max(F.when(changes & ~resolved, place)).alias("_reopened"),
    )
    heads = materialize(heads)
    # Only entries after the last open status matter for the resolve time.
    marks = lookup_join(entries.where(resolved).select(*CASE, "ts", "action_id"),
                        heads.select(*CASE, "_reopened", "actions"), CASE, weight="actions")
    times = marks.where(
        F.col("_reopened").isNull() | (F.struct("ts", "action_id") > F.col("_reopened"))
    ).groupBy(*CASE).agg(F.min("ts").alias("resolved_at"))
    cases = heads.join(times, CASE, "left").withColumnRenamed("new_status", "case_status")
    if assessments is not None:
        cases = cases.join(
            assessments.select(*CASE, "severity", "enumerator_id", "district_id"), CASE, "left")
    else:
        cases = cases.withColumns({
            c: F.lit(None).cast("string") for c in ("severity", "enumerator_id", "district_id")})
    return cases.select(
        *CASE, F.col("case_status").alias("status"),
        priority(F.col("severity"), F.col("priority")).alias("priority"),
        "assigned_to", "action", F.col("note").alias("supervisor_notes"),
        "created_at", "updated_at", "resolved_at", "actions", "enumerator_id", "district_id")


def filter_cases(cases: DataFrame, **wanted: str | None) -> DataFrame:
    """Keep rows equal in every given column; newest change first."""
    for name, value in wanted.items():
        if value is not None:
            cases = cases.where(F.col(name) == value)
    return cases.orderBy(F.desc("updated_at"), *CASE)


def status_counts(cases: DataFrame) -> DataFrame:
    """(status, cases) for every known status, zero included, and ``resolved``."""
    counts = cases.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in CASE_STATUSES],
        F.count_if(F.col("status").isin(*CASE_RESOLVED)).alias("resolved"))
    return counts.unpivot([], list(counts.columns), "status", "cases")


def audit_trail(log: DataFrame) -> DataFrame:
    """Every entry with the status before and after it.

    Cases are cut by day, so a case with very many entries stays spread out.
    """
    entries = first_creations(log).withColumn("_set", new_status(log))
    entries = entries.withColumn("_day", F.to_date("ts"))
    order = ["ts", "action_id"]
    statuses = entries.where(F.col("_set").isNotNull()).select(*CASE, "_day", *order, "_set")
    spans = neighbours(statuses, CASE, "_day", order, {"_was": "_set"}, -1)
    changed = spans.select(*CASE, *order, F.col("_was").alias("previous_status"),
                           F.col("_set").alias("new_status"))
    quiet = entries.where(F.col("_set").isNull())
    if quiet.isEmpty():
        return null_safe_join(entries.select(*CASE, *order, "user", "action", "note"), changed,
                              [*CASE, *order])
    # An entry that sets nothing keeps the status set last before it.
    marks = statuses.select(*CASE, "_day", *order, F.col("_set").alias("_s")).unionByName(
        quiet.select(*CASE, "_day", *order, F.lit(None).cast("string").alias("_s")))
    kept = carried(marks, CASE, "_day", order, "_s")
    rest = kept.where(F.col("_s").isNull()).select(
        *CASE, *order, F.col("_carried").alias("previous_status"),
        F.col("_carried").alias("new_status"))
    return null_safe_join(entries.select(*CASE, *order, "user", "action", "note"),
                          changed.unionByName(rest), [*CASE, *order])


def carried(df: DataFrame, keys: list[str], block: str, order: list[str], value: str) -> DataFrame:
    """Add ``_carried``: the last non-null ``value`` up to each row."""
    from pyspark.sql.window import Window

    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    lasts = df.groupBy(*keys, block).agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value))).getField(value)
        .alias("_last"))
    lasts = lasts.select(*keys, block, F.last("_last", True).over(outer).alias("_before"))
    near = null_safe_join(df.withColumn("_near", F.last(value, True).over(inner)), lasts,
                          [*keys, block])
    return near.select(*df.columns, F.coalesce("_near", "_before").alias("_carried"))


def with_latest_assessment(cases: DataFrame, assessments: DataFrame) -> DataFrame:
    """Each case with the assessment of the highest run of its record."""
    fields = ["risk_score", "severity", "anomaly_status"]
    latest = assessments.groupBy(*CASE).agg(
        F.max(F.struct("run_id", *fields)).alias("_a"))
    return cases.join(latest, CASE, "left").select(
        *cases.columns, *[F.col(f"_a.{f}").alias(f) for f in fields])
