"""One batch from stored records to assessments, in the fixed stage order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import (
    DetectorConfig, ForestSettings, FusionSettings, StatSettings,
)
from plumbline.operators.context import evidence_bundles
from plumbline.operators.detectors.common import no_detections
from plumbline.operators.detectors.run import DetectorRun, run_detectors, skipped_families
from plumbline.operators.detectors.shift import prior_counts
from plumbline.operators.forest import EVIDENCE as FOREST_EVIDENCE
from plumbline.operators.forest import ForestRun, run_forest
from plumbline.operators.fusion import dataset_context, fuse, record_ids
from plumbline.operators.profile import (
    dataset_profile, entity_profiles, record_deviations, record_percentiles, record_zscores,
    variable_profiles,
)
from plumbline.operators.roles import detect_roles, eligible_measures
from plumbline.operators.rules import Rule, RuleRun, checked, evaluate_rules, skipped_rules
from plumbline.operators.statistics import batch_baselines, evaluate_statistics
from plumbline.plans.lookup import empty_frame, materialize
from plumbline.sources.store import Store

# Stage names in running order.
STAGES = ("INGESTION", "PARQUET", "PROFILE", "RULES", "STATISTICS", "INTELLIGENCE", "ML",
          "FUSION", "CONTEXT")


@dataclass(frozen=True)
class AssessOptions:
    rules: list[Rule] | None = None
    references: dict[str, list[str]] | DataFrame | None = None
    survey_code: str = "DEMO"
    statistics: StatSettings = StatSettings()
    forest: ForestSettings = ForestSettings()
    fusion: FusionSettings = FusionSettings()
    detectors: dict[str, DetectorConfig] | None = None
    use_forest: bool = True
    order: str | None = None


@dataclass(frozen=True)
class Assessed:
    rules: RuleRun
    statistics: DataFrame
    detectors: DetectorRun | None
    forest: ForestRun | None
    assessments: DataFrame | None
    dataset: DataFrame
    stages: dict[str, str] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return overall_status(self.stages)


def overall_status(stages: dict[str, str]) -> str:
    """FAILED on a hard stage; PARTIAL if an optional stage was unavailable."""
    if any(s == "FAILED" for s in stages.values()):
        return "FAILED"
    soft = ("ML", "INTELLIGENCE", "CONTEXT")
    if any(stages.get(s) == "UNAVAILABLE" for s in soft):
        return "PARTIAL"
    return "COMPLETED"


def assess(
    df: DataFrame,
    options: AssessOptions = AssessOptions(),
    batch_id: str = "",
    baselines: DataFrame | None = None,
    prior: DataFrame | None = None,
    source_batch: str = "",
    enumerator_history: DataFrame | None = None,
    history: DataFrame | None = None,
) -> Assessed:
    """All stages over one frame; nothing is written.

    ``baselines``, ``prior``, ``enumerator_history`` and ``history`` describe
    earlier batches: means per variable, value counts, rates, and records.
    """
    o = options
    rules = evaluate_rules(df, checked(o.rules), o.references, o.survey_code)
    statistics = evaluate_statistics(df, baselines, batch_id, o.statistics)
    stages = {"RULES": "COMPLETED", "STATISTICS": "COMPLETED"}
    detectors = run_detectors(df, o.order, o.detectors, enumerator_history, prior, source_batch,
                              batch_id)
    detectors = replace(detectors, detections=materialize(detectors.detections))
    stages["INTELLIGENCE"] = "COMPLETED"
    forest = run_forest(df, history, o.forest) if o.use_forest else None
    trained = forest is not None and forest.status == "COMPLETED"
    stages["ML"] = "COMPLETED" if trained else "UNAVAILABLE"
    known = baselines is not None and not baselines.where(
        (F.col("batch_id") != batch_id) & F.col("mean").isNotNull()).isEmpty()
    remembered = known or (trained and forest.training_source == "historical")
    assessments = fuse(
        record_ids(df), rules.violations, statistics, forest.evidence if trained else None,
        detectors.detections, history=remembered, settings=o.fusion)
    stages["FUSION"] = "COMPLETED"
    return Assessed(rules, statistics, detectors, forest, assessments,
                    dataset_context(statistics, remembered, o.fusion), stages)


class StageFailed(Exception):
    """A stage that the rest of a run cannot do without."""


class StageLog:
    """Runs stages in turn and stores the status of each as it ends."""

    def __init__(self, store: Store, batch_id: str, run_id: int):
        self.store, self.batch_id, self.run_id = store, batch_id, run_id
        self.rows: dict[str, tuple[str, str | None]] = {}

    @property
    def stages(self) -> dict[str, str]:
        return {name: status for name, (status, _) in self.rows.items()}

    def note(self, name: str, status: str, reason: str | None = None) -> None:
        self.rows[name] = (status, reason)
        rows = [(STAGES.index(n), n, *row) for n, row in self.rows.items()]
        self.store.replace("stage_status", self.batch_id, self.store.spark.createDataFrame(
            rows, "position int, stage string, status string, reason string"), self.run_id)

    def run(self, name: str, work: Callable[[], tuple[str, str | None] | None],
            soft: bool = False) -> None:
        """``work`` may name a status and reason; a soft stage that raises is UNAVAILABLE."""
        try:
            status, reason = work() or ("COMPLETED", None)
        except Exception as error:
            self.note(name, "UNAVAILABLE" if soft else "FAILED",
                      f"{type(error).__name__}: {str(error)[:500]}")
            if not soft:
                raise StageFailed(name) from error
            return
        self.note(name, status, reason)


def run_batch(store: Store, batch_id: str, options: AssessOptions = AssessOptions(),
              run_id: int = 1) -> dict[str, str]:
    """Assess a stored batch and write every derived table.

    Each stage reads the records, or what an earlier stage of this run wrote; a lost
    executor costs a task, not a stage. Detectors and context that raise are
    UNAVAILABLE; any other stage that raises is FAILED and ends the run. Returns the
    status per stage, which ``stage_status`` holds with reasons as soon as each ends.
    """
    known = store.batches().where(F.col("batch_id") == batch_id).select("status").first()
    if known is None or known["status"] not in ("COMPLETED", "PROFILED"):
        return {"INGESTION": "FAILED"}
    log = StageLog(store, batch_id, run_id)
    log.note("INGESTION", "COMPLETED")
    try:
        _run_stages(store, batch_id, options, run_id, log)
    except StageFailed:
        pass  # the log has the stage and its reason
    return log.stages


def _run_stages(store: Store, batch_id: str, o: AssessOptions, run_id: int, log: StageLog) -> None:
    spark = store.spark

    def write(table: str, df: DataFrame) -> None:
        store.replace(table, batch_id, df, run_id)

    def read(table: str) -> DataFrame:
        return store.read(table, batch_id, run_id)

    def read_records() -> None:
        store.read_batch(batch_id).schema  # noqa: B018  fails if the files are gone

    log.run("PARQUET", read_records)
    df = store.read_batch(batch_id)

    def profile() -> None:
        write("dataset_profiles", dataset_profile(df))
        write("variable_profiles", variable_profiles(df))
        write("entity_profiles", entity_profiles(df, o.order))
        write("record_profiles", record_zscores(df))
        write("record_percentiles", record_percentiles(df))
        write("record_deviations", record_deviations(df))

    log.run("PROFILE", profile)
    stored = store.read_if_present("baselines")
    earlier = None if stored is None else stored.where(F.col("batch_id") != batch_id)
    newest = None if earlier is None else earlier.orderBy(
        F.desc("created_at"), F.desc("batch_id")).select("batch_id").first()
    source = newest["batch_id"] if newest else ""
    has_means = bool(newest) and not earlier.where(F.col("mean").isNotNull()).isEmpty()
    found: dict[str, object] = {}

    def rules() -> None:
        done = evaluate_rules(df, checked(o.rules), o.references, o.survey_code)
        write("rule_violations", done.violations)
        write("skipped_rules", skipped_rules(spark, done))

    log.run("RULES", rules)
    # What the stored profile knows as numbers; it has a row per column.
    profiled = {r["variable_name"] for r in read("variable_profiles").where("kind = 'numeric'").select(
        "variable_name").collect()}
    measures = eligible_measures(detect_roles(df), profiled)
    log.run("STATISTICS", lambda: write("statistical_evidence", evaluate_statistics(
        df, earlier if newest else None, batch_id, o.statistics, measures)))

    def intelligence() -> None:
        values = store.read("value_counts", source) if newest else None
        people = store.read("entity_profiles", source) if newest else None
        done = run_detectors(
            df, o.order, o.detectors,
            None if people is None else people.where(F.col("scope") == "enumerator").select(
                F.col("id").alias("enumerator_id"), "employment_rate"),
            None if values is None else values.select("variable", "value", "count"),
            source, batch_id)
        write("quality_detections", done.detections)
        write("skipped_detectors", skipped_families(done, spark))

    write("quality_detections", no_detections(spark))
    log.run("INTELLIGENCE", intelligence, soft=True)

    def forest() -> tuple[str, str | None]:
        write("ml_evidence", empty_frame(spark, FOREST_EVIDENCE))
        if not o.use_forest:
            return "UNAVAILABLE", "switched off"
        past = store.prior_records(batch_id, measures) if newest and measures else None
        done = run_forest(df, past, o.forest, measures)
        if done.status != "COMPLETED":
            return "UNAVAILABLE", done.status
        write("ml_evidence", done.evidence)
        found["trained_on"] = done.training_source
        return "COMPLETED", None

    log.run("ML", forest)
    ml = read("ml_evidence") if log.stages["ML"] == "COMPLETED" else None
    remembered = has_means or found.get("trained_on") == "historical"

    def fusion() -> None:
        write("assessments", fuse(
            record_ids(df), read("rule_violations"), read("statistical_evidence"), ml,
            read("quality_detections"), remembered, o.fusion))
        write("dataset_assessments",
              dataset_context(read("statistical_evidence"), remembered, o.fusion))
        # What later batches compare themselves with.
        write("baselines", batch_baselines(df).withColumn("created_at", F.current_timestamp()))
        write("value_counts", prior_counts(df))

    log.run("FUSION", fusion)

    def context() -> None:
        # Bundles for the records somebody has to explain.
        flagged = read("assessments").where(F.col("anomaly_status").isin("CONFIRMED", "REVIEW"))
        write("context_bundles", evidence_bundles(
            flagged, read("rule_violations"), read("statistical_evidence"), ml,
            read("variable_profiles"), read("entity_profiles")))

    log.run("CONTEXT", context, soft=True)
