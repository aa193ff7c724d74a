"""Evidence bundles for a downstream explainer, and when they need refreshing.

No model is called here. A bundle is one JSON text per record with a byte
budget; its hash tells whether a stored explanation is still current.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.config import CONTEXT_BYTES
from plumbline.operators.fusion import severity_order
from plumbline.plans.lookup import lookup_join, materialize

# An item takes far more than BUDGET / ITEMS bytes, so a record with more items
# than this is over any budget up to ITEMS * MIN_ITEM_BYTES and gets trimmed.
MIN_ITEM_BYTES = 64
SLICE_VARIABLES = 8
KEEP = {"rule_evidence": 4, "statistical_evidence": 3, "ml_evidence": 2}
SUBJECT_LIMIT = 200
SUBJECT_DEFAULT = 20
JSON = {"ignoreNullFields": "false"}


def json_bytes(value: Column) -> Column:
    return F.octet_length(F.to_json(value, JSON))


def context_hash(value: Column) -> Column:
    return F.sha2(F.to_json(value, JSON), 256)


def _listed(evidence: DataFrame, name: str, order: list[str], item: Column,
            kept: int) -> DataFrame:
    """(record_id, <name>: items in order, <name>_n: how many there are).

    At most ``kept`` items are gathered; the rank filter is applied before the
    shuffle. The count is complete.
    """
    w = Window.partitionBy("record_id").orderBy(*order)
    rows = evidence.where(F.col("record_id") != "")
    counts = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias(f"{name}_n"))
    items = (
        rows.select("record_id", F.row_number().over(w).alias("_i"), item.alias("_item"))
        .where(F.col("_i") <= kept)
        .groupBy("record_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_item"))),
                         lambda s: s["_item"]).alias(name))
    )
    return counts.join(items, "record_id")


def evidence_bundles(
    assessments: DataFrame,
    rules: DataFrame,
    statistics: DataFrame,
    ml: DataFrame | None = None,
    variables: DataFrame | None = None,
    entities: DataFrame | None = None,
    max_bytes: int = CONTEXT_BYTES,
) -> DataFrame:
    """(record_id, bundle, bytes, context_hash, trimmed, no_detected_evidence).

    Over budget the profile slice goes first, then each list is cut to its first
    items, then all evidence goes. ``variables`` and ``entities`` are the stored
    profiles.
    """
    kept = max(KEEP.values()) + max_bytes // MIN_ITEM_BYTES
    parts = {
        "rule_evidence": _listed(
            rules, "rule_evidence", ["rule_id"],
            F.struct("rule_code", F.col("message").alias("rule_description"), "severity",
                     "field", "observed_value", "expected_condition", "message"), kept),
        "statistical_evidence": _listed(
            statistics, "statistical_evidence", ["variable", "detector", "scope", "score"],
            F.struct("variable", "detector", "scope", "observed_value", "baseline_value",
                     "baseline_std", "score", "threshold", "severity",
                     F.col("evidence.group_id").alias("group_id"),
                     (F.col("evidence.q3") - F.col("evidence.q1")).alias("baseline_iqr")), kept),
    }
    if ml is not None:
        parts["ml_evidence"] = _listed(
            ml, "ml_evidence", ["anomaly_score"],
            F.struct("model_type", "model_version", "anomaly_score", "raw_model_score",
                     "severity", "feature_names", "training_source", "training_records",
                     "prediction"), kept)
    out = assessments
    for name, table in parts.items():
        out = out.join(table, "record_id", "left")
        empty = table.select(name).schema[name].dataType
        out = out.withColumns({name: F.coalesce(name, F.array().cast(empty)),
                               f"{name}_n": F.coalesce(f"{name}_n", F.lit(0))})
    used = F.slice(F.array_distinct(F.concat(
        F.transform("statistical_evidence", lambda e: e["variable"]),
        F.transform("rule_evidence", lambda e: e["field"]))), 1, SLICE_VARIABLES)
    out = out.withColumn("_slice", used)
    slice_fields: list[Column] = [F.lit(variables is not None).alias("available")]
    if variables is not None:
        # One entry per column of the table.
        known = [r.asDict() for r in variables.select(
            "variable_name", "kind", "mean", "standard_deviation", "missing_rate").collect()]
        table = F.create_map(*[x for v in known for x in (
            F.lit(v["variable_name"]),
            F.struct(*[F.lit(v[k]).cast("double" if k not in ("kind", "name") else "string")
                       .alias(k) for k in ("kind", "mean", "standard_deviation",
                                           "missing_rate")]))])
        slice_fields.append(F.transform(
            F.filter("_slice", lambda n: F.array_contains(F.map_keys(table), n)),
            lambda n: F.struct(n.alias("name"), F.try_element_at(table, n).alias("profile"))
        ).alias("variables"))
    if entities is not None:
        for scope in ("enumerator", "cluster", "district"):
            groups = materialize(entities.where(F.col("scope") == scope).select(
                F.col("id").alias(f"{scope}_id"), F.col("record_count").alias(f"_rows_{scope}"),
                F.struct("id", "record_count", "numeric_means").alias(f"_{scope}")))
            out = lookup_join(out, groups, [f"{scope}_id"], weight=f"_rows_{scope}")
            slice_fields.append(F.col(f"_{scope}").alias(scope))
    head = F.struct(
        "record_id", "anomaly_status", "classification_reason", "risk_score", "severity",
        F.col("confidence").alias("evidence_confidence"), "agreement", "available_sources",
        "missing_sources", "escalation_applied", "escalation_reason", "methodology_version",
        "source_scores", "source_severities")
    counts = reduce(lambda a, b: a + b, [F.col(f"{n}_n") for n in parts])
    nothing = counts == 0

    def variant(profile: Column, limits: dict[str, int] | None, none: Column) -> Column:
        lists = [
            (F.col(n) if limits is None else F.slice(n, 1, limits[n])).alias(n) for n in parts]
        return F.to_json(F.struct(
            head.alias("unified_assessment"), *lists, profile.alias("profile_context"),
            none.alias("no_detected_evidence")), JSON)

    full_slice = F.struct(*slice_fields)
    bare = F.struct(F.lit(variables is not None).alias("available"))
    dropped = {n: 0 for n in parts}
    short = {n: KEEP[n] for n in parts}
    whole = reduce(lambda a, b: a & b, [F.col(f"{n}_n") <= kept for n in parts])
    fits = [
        (variant(full_slice, None, nothing), whole),
        (variant(bare, None, nothing), whole),
        (variant(bare, short, nothing), F.lit(True)),
    ]
    # A shorter text is written only where the longer ones do not fit.
    staged, left = out.withColumn("trimmed", F.lit(None).cast("int")), F.col("trimmed").isNull()
    for i, (text, complete) in enumerate(fits):
        staged = staged.withColumn(f"_t{i}", F.when(left, text)).withColumn(
            "trimmed", F.when(left & complete & (F.octet_length(f"_t{i}") <= max_bytes), F.lit(i)).otherwise(F.col("trimmed")))
    staged = staged.withColumn("_t3", F.when(left, variant(bare, dropped, F.lit(True)))).withColumn(
        "trimmed", F.coalesce("trimmed", F.lit(3)))
    bundle = F.when(F.col("trimmed") == 0, F.col("_t0")).when(
        F.col("trimmed") == 1, F.col("_t1")).when(
        F.col("trimmed") == 2, F.col("_t2")).otherwise(F.col("_t3"))
    return staged.withColumn("bundle", bundle).select(
        "record_id", *[f"{n}_n" for n in parts], F.col("_slice").alias("variables"),
        "bundle", F.octet_length("bundle").alias("bytes"),
        F.sha2("bundle", 256).alias("context_hash"), "trimmed",
        (nothing | (F.col("trimmed") == 3)).alias("no_detected_evidence"))


# Scope -> what a record must be: seen as an anomaly, or of a grave severity.
SUBJECT_SCOPES = {"all": (), "detected": ("found",), "priority": ("grave",)}


def choose_subjects(
    assessments: DataFrame, scope: str = "priority", severity: str | None = None,
    min_risk: float | None = None, limit: int | None = SUBJECT_DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """(chosen records in order, one row with ``skipped``).

    A named severity stands in for the scope. A least risk replaces the grave
    severities by that risk and, but for scope "all", leaves anomalies only.
    ``limit`` is 1 to 200; the rest is counted as skipped.
    """
    if limit is None:
        limit = SUBJECT_DEFAULT
    if not 1 <= limit <= SUBJECT_LIMIT:
        raise ValueError(f"limit {limit}: 1 to {SUBJECT_LIMIT} subjects can be chosen")
    tests = {
        "found": F.col("anomaly_status").isin("CONFIRMED", "REVIEW"),
        "grave": F.col("severity").isin("HIGH", "CRITICAL"),
        "severity": F.col("severity") == severity,
        "risk": F.col("risk_score") >= min_risk,
    }
    wanted = {"severity"} if severity else set(SUBJECT_SCOPES.get(scope, ("grave",)))
    if min_risk is not None:
        wanted = (wanted - {"grave"}) | {"risk"} | ({"found"} if scope != "all" else set())
    rows = assessments
    for name in sorted(wanted):
        rows = rows.where(tests[name])
    order = (severity_order(F.col("severity")), F.desc("risk_score"), "record_id")
    left = F.greatest(F.count(F.lit(1)) - limit, F.lit(0).cast("long"))
    return rows.orderBy(*order).limit(limit), rows.agg(left.alias("skipped"))


def without_assessment(records: DataFrame, assessments: DataFrame) -> DataFrame:
    """All record ids, assessed or not, each once."""
    return records.select("record_id").unionByName(assessments.select("record_id")).distinct()


def changed_bundles(bundles: DataFrame, stored: DataFrame, run_id: int) -> DataFrame:
    """Bundles whose stored explanation is missing, failed or out of date.

    ``stored`` has (record_id, status, context_hash, run_id).
    """
    known = stored.select(
        "record_id", F.col("status").alias("_status"), F.col("context_hash").alias("_hash"),
        F.col("run_id").alias("_run"))
    current = (
        (F.col("_status") == "available") & (F.col("_hash") == F.col("context_hash"))
        & (F.col("_run") == run_id))
    return bundles.join(known, "record_id", "left").where(
        ~F.coalesce(current, F.lit(False))).select(*bundles.columns)


# --- batch summary ------------------------------------------------------------

TOP_GROUPS = 10
TOP_VARIABLES = 20
TOP_RECORDS = 5
PRIORS = 3


def ranked_groups(entities: DataFrame, scope: str, limit: int = TOP_GROUPS) -> DataFrame:
    """Groups with most missing cells, then the largest."""
    return (
        entities.where(F.col("scope") == scope)
        .orderBy(F.desc(F.coalesce("missingness_rate", F.lit(0.0))), F.desc("record_count"), "id")
        .limit(limit))


def ranked_variables(variables: DataFrame, limit: int = TOP_VARIABLES) -> DataFrame:
    return variables.orderBy(
        F.desc(F.coalesce("missing_rate", F.lit(0.0))), "variable_name").limit(limit)


def record_highlights(zscores: DataFrame, limit: int = TOP_RECORDS) -> DataFrame:
    """Records with the largest absolute z-score, then most missing cells."""
    names = [c for c in zscores.columns if c.startswith("z_")]
    # The strongest variable; among equals the later one.
    best = F.greatest(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.abs(c).alias("size"), F.lit(i).alias("i"),
            F.lit(c.removeprefix("z_")).alias("variable"), F.col(c).alias("z")))
        for i, c in enumerate(names)], F.lit(None)) if names else F.lit(None)
    rows = zscores.select("record_id", "missing_count", best.alias("_b"))
    return rows.select(
        "record_id", F.col("_b.variable").alias("variable"), F.col("_b.z").alias("z"),
        "missing_count",
    ).orderBy(F.desc(F.coalesce(F.abs("z"), F.lit(0.0))), F.desc("missing_count"),
              "record_id").limit(limit)


def _packed(df: DataFrame, name: str, order: list[Column], item: Column) -> DataFrame:
    """A short ranked table as one row holding an array."""
    w = Window.orderBy(*order)  # at most a few dozen rows
    rows = df.select(F.row_number().over(w).alias("_i"), item.alias("_item"))
    # Items may hold maps, which have no order of their own.
    placed = F.array_sort(F.collect_list(F.struct("_i", "_item")), lambda a, b: a["_i"] - b["_i"])
    return rows.agg(F.transform(placed, lambda s: s["_item"]).alias(name))


def batch_summary(
    batch_id: str, dataset: DataFrame, variables: DataFrame, entities: DataFrame,
    zscores: DataFrame, priors: DataFrame | None = None, max_bytes: int = CONTEXT_BYTES,
) -> DataFrame:
    """One row: (batch_id, context, bytes). Trimmed in a fixed order to fit.

    ``priors`` has (batch_id, created_at, record_count, missing_rate).
    """
    pieces = [
        dataset.select(F.struct("record_count", "column_count", "missing_rate",
                                "duplicate_count", "numeric_measures", "categorical_columns")
                       .alias("dataset")),
        _packed(ranked_variables(variables), "variables",
                [F.desc(F.coalesce("missing_rate", F.lit(0.0))), F.asc("variable_name")],
                F.struct(F.col("variable_name").alias("name"), "kind", "missing_rate",
                         "missing_count", "unique_count", "mean",
                         F.col("standard_deviation").alias("std"), "min", "max")),
        _packed(record_highlights(zscores), "highlights",
                [F.desc(F.coalesce(F.abs("z"), F.lit(0.0))), F.desc("missing_count"),
                 F.asc("record_id")],
                F.struct("record_id", "variable", "z", "missing_count")),
    ]
    for scope in ("enumerator", "cluster", "district"):
        pieces.append(_packed(
            ranked_groups(entities, scope), scope,
            [F.desc(F.coalesce("missingness_rate", F.lit(0.0))), F.desc("record_count"),
             F.asc("id")],
            F.struct("id", "record_count", "missingness_rate", "numeric_means")))
    if priors is not None:
        latest = priors.where(F.col("batch_id") != batch_id).orderBy(
            F.desc("created_at")).limit(PRIORS)
        pieces.append(_packed(latest, "priors", [F.desc("created_at")],
                              F.struct("batch_id", "record_count", "missing_rate")))
    row = pieces[0].withColumn("_one", F.lit(1))
    for piece in pieces[1:]:
        # Every piece is exactly one row.
        row = row.join(piece.withColumn("_one", F.lit(1)), "_one")
    if priors is None:
        row = row.withColumn("priors", F.array().cast("array<string>"))

    def text(highlights: bool, caps: dict[str, int], history: bool = True) -> Column:
        def cut(name):
            return F.slice(name, 1, caps[name]) if name in caps else F.col(name)

        past = F.col("priors") if history else F.slice("priors", 1, 0)
        return F.to_json(F.struct(
            F.lit(batch_id).alias("batch_id"), F.col("dataset").alias("dataset_context"),
            cut("variables").alias("important_variables"),
            *[cut(s).alias(f"{s}_context") for s in ("enumerator", "cluster", "district")],
            F.struct((F.size("priors") > 0).alias("historical_context_available"),
                     past.alias("priors")).alias("historical_context"),
            *([F.col("highlights").alias("record_feature_highlights")] if highlights else []),
        ), JSON)

    caps: dict[str, int] = {}
    steps = [text(True, caps), text(False, caps)]
    for name, cap in (("district", 3), ("cluster", 3), ("enumerator", 3), ("variables", 8)):
        caps = {**caps, name: cap}
        steps.append(text(False, caps))
    last = text(False, caps, history=False)
    chosen = F.coalesce(*[F.when(F.octet_length(t) <= max_bytes, t) for t in steps], last)
    return row.select(F.lit(batch_id).alias("batch_id"), chosen.alias("context")).withColumn(
        "bytes", F.octet_length("context"))
