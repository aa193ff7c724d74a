import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.config import ForestSettings
from plumbline.operators import reports
from plumbline.operators.rules import Rule
from plumbline.operators.standardize import Standardized, standardize
from plumbline.operators.forest import run_forest
from plumbline.plans.assess import AssessOptions, assess, overall_status, run_batch
from plumbline.sources.readers import content_hashes, new_files
from plumbline.sources.store import Store, write_report
from plumbline.streaming.drops import watch_csv


def batch(spark, seed, n=60):
    rows = [(f"R{i + seed}", f"E{i % 3}", f"C{i % 2}", "D1", 20 + (i * seed) % 40,
             100.0 * ((i + seed) % 9), "employed" if i % 4 else "unemployed", 40)
            for i in range(n)]
    rows[3] = (rows[3][0], "E0", "C1", "D1", 140, 1e6, "employed", 200)
    df = spark.createDataFrame(
        rows, "respondent_id string, enumerator_id string, cluster_id string, district_code "
              "string, age bigint, income double, employment_status string, working_hours bigint")
    return Standardized(df, df.columns, dict(df.dtypes))


def test_batches_are_never_overwritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.batches().isEmpty() and store.find_by_hash("h") is None
    first = store.write_batch(batch(spark, 1), "csv", input_hash="h")
    assert first.startswith("BATCH_") and store.find_by_hash("h") == first
    row = store.batches().first()
    assert (row["status"], row["records"], row["column_count"]) == ("COMPLETED", 60, 8)
    with pytest.raises(AnalysisException):
        store.write_batch(batch(spark, 2), "csv", first)
    assert store.read_batch(first).count() == 60
    assert store.record_ids(first).columns == ["record_id"]


def test_equal_files_are_ingested_once(spark, tmp_path):
    for name, text in (("a", "x\n1\n"), ("b", "x\n1\n"), ("c", "x\n2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    hashes = content_hashes(spark, str(tmp_path))
    assert hashes.select("input_hash").distinct().count() == 2
    done = hashes.where(F.col("path").endswith("c.csv")).withColumn("status", F.lit("COMPLETED"))
    assert [r["path"][-5:] for r in new_files(spark, str(tmp_path), done).collect()] == ["a.csv"]


def test_two_batches_through_all_stages(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    options = AssessOptions(forest=ForestSettings(trees=20))
    for name, seed in (("B1", 1), ("B2", 7)):
        store.write_batch(batch(spark, seed), "csv", name)
        stages = run_batch(store, name, options)
        assert overall_status(stages) == "COMPLETED", stages
    assert run_batch(store, "nope") == {"INGESTION": "FAILED"}
    assert store.read("ml_evidence", "B2").first()["training_source"] == "historical"
    assert store.read("ml_evidence", "B1").first()["training_source"] == "current_batch"
    rows = store.read("assessments", "B2")
    assert rows.count() == 60
    assert rows.where("anomaly_status = 'CONFIRMED'").count() >= 1
    # Three sources with history: 88, +8/+4/-22 for agreement, +4.
    assert {r["confidence"] for r in rows.select("confidence").distinct().collect()} <= {
        100.0, 96.0, 70.0}
    run_batch(store, "B2", options, run_id=2)
    assert store.read("assessments").count() == 120
    assert {r["run_id"] for r in store.read("assessments", "B2").collect()} == {2}
    view = reports.for_view(store.read("assessments"), view="All-Batches")
    totals = reports.group_rows(view, "enumerator", store.read("entity_profiles"))
    assert totals.agg(F.sum("records")).first()[0] == 120
    one = reports.group_rows(reports.for_view(store.read("assessments"), "B1"), "enumerator")
    assert one.agg(F.sum("records")).first()[0] == 60
    order = [r["stage"] for r in store.read("stage_status", "B1").orderBy("position").collect()]
    assert order == ["INGESTION", "PARQUET", "PROFILE", "RULES", "STATISTICS", "INTELLIGENCE",
                     "ML", "FUSION", "CONTEXT"]
    # The second run replaced the files behind ``rows``: read again.
    flagged = store.read("assessments", "B2").where("anomaly_status <> 'NORMAL'").count()
    assert store.read("context_bundles", "B2").count() == flagged > 0
    assert store.read("record_profiles", "B2").count() == 60
    measures = {"age", "income", "working_hours"}
    ranks = store.read("record_percentiles", "B2")
    assert ranks.count() == 180 and {r[0] for r in ranks.select("variable").distinct().collect()} == measures
    assert {f"{s}_dev_{m}" for s in ("enumerator", "cluster", "district") for m in measures} <= set(
        store.read("record_deviations", "B2").columns)


def only_age(limit):
    return AssessOptions(rules=[Rule("AGE_MAX", "age", "less_than", limit, severity="CRITICAL")], use_forest=False)


def test_a_run_without_evidence_and_an_empty_rerun(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    clean = spark.createDataFrame([(f"R{i}", 30) for i in range(40)], "record_id string, age bigint")
    store.write_batch(Standardized(clean, clean.columns, dict(clean.dtypes)), "csv", "007")
    stages = run_batch(store, "007", only_age(100))
    assert overall_status(stages) == "PARTIAL" and stages["FUSION"] == "COMPLETED"
    assert store.read("rule_violations", "007").isEmpty()
    run_batch(store, "007", only_age(20), run_id=2)
    assert store.read("rule_violations", "007").count() == 40
    assert {r["anomaly_status"] for r in store.read("assessments", "007").collect()} == {"CONFIRMED"}
    run_batch(store, "007", only_age(100), run_id=3)
    assert store.read("rule_violations").isEmpty()
    rows = store.read("assessments")
    assert {(r["batch_id"], r["run_id"], r["anomaly_status"]) for r in rows.collect()} == {
        ("007", 3, "NORMAL")}
    assert rows.columns.count("batch_id") == 1


def test_stages_that_raise(spark, tmp_path, monkeypatch):
    from plumbline.plans import assess as plan

    store = Store(spark, str(tmp_path / "s"))
    store.write_batch(batch(spark, 1), "csv", "B1")

    def broken(*args, **kwargs):
        raise RuntimeError("no such luck")

    monkeypatch.setattr(plan, "run_detectors", broken)
    stages = run_batch(store, "B1", AssessOptions(use_forest=False))
    assert (stages["INTELLIGENCE"], stages["FUSION"]) == ("UNAVAILABLE", "COMPLETED")
    reasons = {r["stage"]: r["reason"] for r in store.read("stage_status", "B1").collect()}
    assert reasons["INTELLIGENCE"] == "RuntimeError: no such luck" and reasons["RULES"] is None
    assert store.read("quality_detections", "B1").isEmpty()
    monkeypatch.setattr(plan, "run_forest", broken)
    stages = run_batch(store, "B1", run_id=2)
    assert list(stages.items())[-1] == ("ML", "FAILED") and overall_status(stages) == "FAILED"
    last = store.read("stage_status", "B1").orderBy(F.desc("position")).first()
    assert (last["stage"], last["status"], last["run_id"]) == ("ML", "FAILED", 2)


def test_status_of_a_run():
    assert overall_status({"RULES": "FAILED", "ML": "COMPLETED"}) == "FAILED"
    assert overall_status({"RULES": "COMPLETED", "ML": "UNAVAILABLE"}) == "PARTIAL"
    assert overall_status({"RULES": "COMPLETED", "ML": "COMPLETED"}) == "COMPLETED"


def test_a_small_batch_runs_without_forest(spark):
    done = assess(batch(spark, 3, 20).frame)
    assert done.status == "PARTIAL" and done.stages["ML"] == "UNAVAILABLE"
    assert done.assessments.first()["missing_sources"] == ["ml"]


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("B1", ["rules", "ml"])], "batch_id string, sources array<string>")
    write_report(df, str(tmp_path / "r"), {"view": "cumulative"})
    back = spark.read.option("header", True).csv(str(tmp_path / "r/rows")).first()
    assert back["sources"] == "rules|ml"
    assert spark.read.text(str(tmp_path / "r/preamble")).first()["value"] == "# view=cumulative"


def test_drops_are_checked_once(spark, tmp_path):
    frame = batch(spark, 1).frame
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    frame.where("age > 100").write.option("header", True).csv(drop)

    def watch():
        watch_csv(spark, drop, frame.schema, out, f"{out}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{out}/violations").where(
            ~F.col("rule_code").contains("IN_REFERENCE"))

    assert sorted(r["rule_code"] for r in watch().collect()) == ["AGE_MAX", "WORKING_HOURS_MAX"]
    assert watch().count() == 2
    frame.where("age < 21").write.mode("append").option("header", True).csv(drop)
    assert watch().count() >= 2
    assert spark.read.parquet(f"{out}/records").count() == frame.where(
        "age > 100 or age < 21").count()


def test_standardised_batches_store_their_types(spark, tmp_path):
    raw = spark.createDataFrame([("R1", "30", " "), ("R2", "n/a", "x")],
                                "`Respondent ID` string, Age string, Notes string")
    store = Store(spark, str(tmp_path / "s"))
    name = store.write_batch(standardize(raw), "csv")
    assert dict(store.read_batch(name).dtypes) == {
        "age": "bigint", "notes": "string", "respondent_id": "string"}


def test_views_and_pages(spark):
    assert reports.view_name("All-Batches") == "cumulative"
    assert reports.view_name(None) == "current_batch"
    rows = spark.createDataFrame(
        [(f"R{i:03d}", ["LOW", "HIGH", "CRITICAL"][i % 3], float(i)) for i in range(300)],
        "record_id string, severity string, risk_score double")
    first = reports.page(rows, 1, 200).collect()
    assert len(first) == 200 and first[0]["severity"] == "CRITICAL"
    for number, size in ((1, 500), (1, 0), (0, 10)):
        with pytest.raises(ValueError):
            reports.page(rows, number, size)
    assert reports.page(rows, 2, 200).count() == 100


def test_prior_records_are_read_by_manifest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.prior_records("x", ["a"]) is None and store.manifest().isEmpty()
    frames = {
        "B1": spark.createDataFrame([("R1", 1, 2.0), ("R2", None, 5.0)], "record_id string, a bigint, b double"),
        "B2": spark.createDataFrame([(7.5, 1, "z")], "a double, record_id bigint, b string"),
        "B3": spark.createDataFrame([("R9", 100)], "person_id string, a int"),
        "B4": spark.createDataFrame([(3, None)], "a bigint, b double"),
    }
    for name, df in frames.items():
        store.write_batch(Standardized(df, df.columns, dict(df.dtypes)), "csv", name)

    def rows(*args, **more):
        return sorted(map(tuple, store.prior_records(*args, **more).collect()), key=str)

    assert rows("B9", ["a"]) == sorted([("B1", "R1", 1.0), ("B1", "R2", None), ("B2", "1", 7.5), ("B3", "R9", 100.0),
                                        ("B4", None, 3.0)], key=str)
    assert rows("B1", ["a", "b"]) == [("B4", None, 3.0, None)]
    assert rows("B9", ["a"], between={"a": (2, 50)}) == [("B2", "1", 7.5), ("B4", None, 3.0)]
    # Files that the manifest rules out are not opened.
    for f in (tmp_path / "s" / "records" / "batch_id=B3").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    assert rows("B9", ["a"], between={"a": (2, 50)}) == [("B2", "1", 7.5), ("B4", None, 3.0)]
    assert store.prior_records("B9", ["gone"]) is None
    found = {(r.column, r.role): (r.type, r.nulls, r.minimum, r.maximum) for r in
             store.manifest().where("batch_id = 'B1'").collect()}
    assert found == {("record_id", "record_id"): ("string", 0, None, None), ("a", None): ("bigint", 1, 1.0, 1.0),
                     ("b", None): ("double", 0, 2.0, 5.0)}


def test_only_measures_of_the_stored_profile_are_used(spark, tmp_path, monkeypatch):
    """A number that the profile holds as text gives neither evidence nor a feature."""
    from plumbline.plans import assess as plan

    rows = [(f"R{i}", float(i % 9), 10.0 if i else 900.0) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id string, a double, b double")
    store = Store(spark, str(tmp_path / "s"))
    store.write_batch(Standardized(df, df.columns, dict(df.dtypes)), "csv", "B1")
    run_batch(store, "B1", AssessOptions(use_forest=False))
    assert {r.variable for r in store.read("statistical_evidence", "B1").select("variable").distinct().collect()} == {"b"}
    known = plan.variable_profiles
    monkeypatch.setattr(plan, "variable_profiles", lambda d: known(d).where("variable_name <> 'b'"))
    seen = []
    monkeypatch.setattr(plan, "run_forest", lambda d, past, s, features: seen.append(features) or run_forest(
        d, past, s, features))
    run_batch(store, "B1", AssessOptions(), 2)
    assert store.read("statistical_evidence", "B1", 2).count() == 0 and seen == [["a"]]
