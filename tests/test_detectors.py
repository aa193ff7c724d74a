import types as types_
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import DETECTORS
from plumbline.functions.answers import signature
from plumbline.operators.detectors import relationship
from plumbline.operators.detectors.common import Survey, group_rates
from plumbline.operators.detectors.enumerator import answer_entropy, enumerators
from plumbline.operators.detectors.geographic import geography
from plumbline.operators.detectors.pattern import cluster_patterns
from plumbline.operators.detectors.run import filter_detections, run_detectors
from plumbline.operators.detectors.shift import (
    distribution_shift, prior_counts, stability_index,
)
from plumbline.operators.detectors.drift import SIGNAL, Drift, in_order, period_drift, period_steps, through
from plumbline.operators.detectors.temporal import temporal


def types(outcome):
    return sorted(r["detector_type"] for r in outcome.detections.collect())


def test_record_relationships(spark):
    df = spark.createDataFrame([
        ("R1", 15, "Married", "PhD", "nilf", 12, 90000.0, " Head "),
        ("R2", 15, "never married", "primary", "employed", 0, 10.0, "member"),
        ("R3", 40, "married", "master", "Unemployed", 5, 80000.0, "head"),
        ("R4", None, None, None, None, None, None, None)],
        "record_id string, age bigint, marital_status string, education string, "
        "employment_status string, working_hours bigint, income double, household_role string")
    found = relationship.record_relationships(Survey.of(df)).collect()
    hits = sorted((r["record_id"], r["detector_type"]) for r in found)
    assert hits == [
        ("R1", "REL_AGE_EDUCATION"), ("R1", "REL_AGE_HOUSEHOLD_ROLE"), ("R1", "REL_AGE_MARITAL"),
        ("R1", "REL_EMPLOYMENT_HOURS"), ("R1", "REL_HOURS_EMPLOYMENT"),
        ("R3", "REL_HOURS_EMPLOYMENT"), ("R3", "REL_INCOME_EMPLOYMENT")]
    first = next(r for r in found if r["detector_type"] == "REL_AGE_MARITAL")
    assert (first["observed_value"], first["expected_value"], first["deviation"]) == (15, 18, -3)
    assert first["evidence"]["rule_id"] == "RULE_REL_001" and first["confidence"] == 0.6
    off = {**DETECTORS, "REL_AGE_MARITAL": replace(DETECTORS["REL_AGE_MARITAL"], enabled=False)}
    assert "REL_AGE_MARITAL" not in [
        r["detector_type"]
        for r in relationship.record_relationships(Survey.of(df, configs=off)).collect()]


def test_households(spark):
    df = spark.createDataFrame([
        ("R1", "H1", "head", 95, "C1"), ("R2", "H1", "household head", 2, "C2"),
        ("R3", "H2", "head", 30, "C3"), ("R4", None, "head", 1, "C4"),
        ("R5", None, "head", 99, "C4")],
        "record_id string, household_id string, household_role string, age bigint, "
        "cluster_id string")
    rows = relationship.household_consistency(Survey.of(df)).collect()
    assert sorted((r["entity_id"], r["severity"], r["observed_value"], r["cluster_id"])
                  for r in rows) == [("H1", "LOW", 93.0, "C1"), ("H1", "MEDIUM", 2.0, "C1")]


def test_arithmetic(spark):
    df = spark.createDataFrame(
        [("R1", 10.0, 9.5, None), ("R2", 10.0, 5.0, 2.0), ("R3", None, 1.0, 1.0)],
        "record_id string, total_income double, wage_income double, other_income double")
    rows = relationship.arithmetic_consistency(Survey.of(df)).collect()
    assert [(r["record_id"], r["expected_value"], r["deviation"]) for r in rows] == [
        ("R2", 7.0, 3.0)]


def block(spark, groups, **extra):
    """{(enumerator, cluster, district): (employed, unemployed)}"""
    rows, i = [], 0
    for (e, c, d), (yes, no) in groups.items():
        for k in range(yes + no):
            rows.append((f"R{i:03d}", e, c, d, "employed" if k < yes else "unemployed",
                         20 + (i * 7) % 50, "F" if i % 2 else "M"))
            i += 1
    return spark.createDataFrame(
        rows, "record_id string, enumerator_id string, cluster_id string, district_code string, "
              "employment_status string, age bigint, sex string")


def test_enumerators(spark):
    df = block(spark, {("E1", "C1", "D1"): (12, 0), ("E2", "C1", "D1"): (2, 10)})
    outcome = enumerators(Survey.of(df))
    assert "ENUMERATOR_DEVIATION" in types(outcome)
    row = outcome.detections.where("entity_id = 'E2'").first()
    assert row["baseline_type"] == "district" and np.isclose(row["expected_value"], 14 / 24)
    alone = enumerators(Survey.of(block(spark, {("E1", "C1", "D1"): (12, 0)})))
    assert not alone.available and "fewer than two" in alone.reason
    assert not enumerators(Survey.of(df.drop("enumerator_id"))).available
    past = spark.createDataFrame([("E1", 0.7), ("E2", 0.2)],
                                 "enumerator_id string, employment_rate double")
    found = enumerators(Survey.of(df), history=past).detections
    old = found.where("baseline_type = 'historical_enumerator'").collect()
    assert [(r["entity_id"], r["expected_value"]) for r in old] == [("E1", 0.7)]


def test_entropy_is_in_bits(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("b", "x", 5)],
                                   "g string, answer string, count bigint")
    rows = {r["g"]: r["entropy"] for r in answer_entropy(counts, ["g"]).collect()}
    assert np.isclose(rows["a"], 1.0) and np.isclose(rows["b"], 0.0)


def test_geography(spark):
    df = block(spark, {("E1", "C1", "D1"): (10, 0), ("E1", "C2", "D1"): (0, 10)})
    rows = geography(Survey.of(df)).detections.collect()
    assert sorted((r["entity_id"], r["severity"], r["deviation"]) for r in rows) == [
        ("C1", "HIGH", 0.5), ("C2", "HIGH", -0.5)]
    assert not geography(Survey.of(df.limit(3))).available
    assert not geography(Survey.of(df.drop("cluster_id", "district_code"))).available


def test_patterns(spark):
    df = spark.createDataFrame(
        [(f"R{i}", "C1", 31, "F", "primary", "E7") for i in range(10)],
        "record_id string, cluster_id string, age bigint, sex string, education string, "
        "enumerator_id string")
    row = cluster_patterns(Survey.of(df)).detections.first()
    assert (row["detector_type"], row["observed_value"], row["record_id"], row["enumerator_id"]) \
        == ("CLUSTER_PATTERN", 1.0, "R0", "E7")
    assert row["evidence"]["signature"] == "age:30|sex:f|education:primary"
    assert not cluster_patterns(Survey.of(df.drop("age", "sex"))).available


def test_signature_bands(spark):
    df = spark.createDataFrame(
        [(37, 12.5, -1.0, " X "), (None, 17.5, 12345.0, None)],
        "age bigint, hours double, income double, sex string")
    text = [r["s"] for r in df.coalesce(1).select(
        signature(df, ["age", "sex", "hours", "income"]).alias("s")).collect()]
    # 12.5/5 and 17.5/5 round half to even.
    assert text == ["age:35|sex:x|hours:10|income:-5000", "age:|sex:|hours:20|income:10000"]


def test_temporal(spark):
    rows = [(f"R{i}", "R1", "employed") for i in range(12)] + [
        (f"S{i}", "R2", "unemployed") for i in range(12)]
    df = spark.createDataFrame(rows, "record_id string, survey_round string, "
                                     "employment_status string")
    outcome = temporal(Survey.of(df))
    kinds = {r["baseline_type"]: r for r in outcome.detections.collect()}
    assert kinds["previous_period"]["severity"] == "HIGH"
    assert np.isclose(kinds["ewma_cusum"]["deviation"], 0.6)
    assert not temporal(Survey.of(df.where("survey_round = 'R1'"))).available
    assert not temporal(Survey.of(df.drop("survey_round"))).available


def walked(rows, minimum):
    """Previous period and signals of one walk over all periods."""
    smooth, drift, before, steps, signals = None, 0.0, (None, None, None), [], []
    for period, n, rate in rows:
        if n >= minimum and rate is not None:
            smooth = rate if smooth is None else 0.4 * rate + 0.6 * smooth
            drift = max(0.0, drift + rate - smooth)
            if drift >= SIGNAL:
                signals.append((period, rate, smooth, drift))
                drift = 0.0
        steps.append((period, n, rate, *before))
        before = (period, n, rate)
    return steps, signals


@pytest.mark.parametrize("shape", ["rising", "noise", "flat", "jumps"])
@pytest.mark.parametrize("block", [1, 7, 64, 100000])
def test_drift_is_that_of_one_walk_over_all_periods(spark, shape, block):
    rng = np.random.default_rng(5)
    rates = {"rising": np.linspace(0, 1, 300) + rng.normal(0, .1, 300), "noise": 0.5 + rng.normal(0, .04, 300),
             "flat": np.full(300, 0.3), "jumps": np.repeat(rng.random(20), 15) + rng.normal(0, .01, 300)}[shape]
    rows = [(f"p{i:04d}", 20 if i % 7 else 3, None if i % 41 == 5 else float(r)) for i, r in enumerate(rates)]
    rows = [(p, 1, r) if 100 < i < 140 else (p, n, r) for i, (p, n, r) in enumerate(rows)]
    steps, signals = walked(rows, 8)
    frame = spark.createDataFrame(rows, "period string, n bigint, rate double").repartition(5)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):  # one range, and one per shuffle partition
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            ordered = in_order(frame, block)
            got = sorted(tuple(r) for r in period_drift(ordered, 8).collect())
            assert [g[0] for g in got] == [w[0] for w in signals]
            assert np.allclose([g[1:] for g in got], [w[1:] for w in signals], rtol=0, atol=1e-12) or not got
            assert sorted(tuple(r) for r in period_steps(ordered).collect()) == steps
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_no_periods_have_no_steps(spark):
    ordered = in_order(spark.createDataFrame([], "period string, n bigint, rate double"))
    assert not period_steps(ordered).collect() and not period_drift(ordered, 8).collect()


def test_block_map_of_the_drift_is_the_walk_from_every_sum():
    rng = np.random.default_rng(7)
    for trial in range(60):
        rates = rng.random() + rng.normal(0, rng.choice([.005, .03, .2]), rng.integers(1, 60))
        start = None if trial % 5 == 0 else float(rng.random())
        block = Drift(start)
        for r in rates:
            block.add("p", float(r))
        (row,) = block.rows(0, True)
        pieces = types_.SimpleNamespace(lo=row[1], hi=row[2], value=row[3], moves=row[4])
        assert len(row[1]) <= len(rates) + 3 and row[1][1:] == row[2][:-1]
        for drift in [0.0, *rng.random(30) * SIGNAL]:
            smooth, d = start, drift
            for r in rates:
                smooth = float(r) if smooth is None else 0.4 * float(r) + 0.6 * smooth
                d = max(0.0, d + float(r) - smooth)
                d = 0.0 if d >= SIGNAL else d
            assert np.isclose(through(pieces, drift), d, rtol=0, atol=1e-12)


def test_distribution_shift(spark):
    a = spark.createDataFrame([("x",)] * 10 + [("y",)] * 10, "v string")
    b = spark.createDataFrame([("x",)] * 18 + [("z",)] * 2, "v string")
    row = distribution_shift(Survey.of(b), prior_counts(a), "B1", "B2").detections.first()
    assert np.isclose(row["observed_value"], 0.5) and row["entity_id"] == "B2"
    assert distribution_shift(Survey.of(a), prior_counts(a)).detections.count() == 0
    assert not distribution_shift(Survey.of(b), None).available


def test_stability_index(spark):
    rng = np.random.default_rng(2)
    old, new = rng.normal(0, 1, 400), rng.normal(.5, 1, 300)
    edges = np.unique(np.quantile(old, np.linspace(0, 1, 9)))
    e, a = (np.histogram(v, edges)[0] for v in (old, new))
    ep, ap = (e + 1e-6) / (e.sum() + 8e-6), (a + 1e-6) / (a.sum() + 8e-6)
    expected = float(np.sum((ap - ep) * np.log(ap / ep)))
    frames = [spark.createDataFrame(pd.DataFrame({"x": v, "few": [1.0] * len(v)}))
              for v in (old, new)]
    found = {r["variable"]: r["psi"] for r in stability_index(*frames, ["x", "few"]).collect()}
    assert np.isclose(found["x"], expected) and found["few"] is None


def test_run_and_filters(spark):
    df = block(spark, {("E1", "C1", "D1"): (10, 0), ("E2", "C2", "D1"): (0, 10)})
    run = run_detectors(df)
    assert run.available == ["RELATIONSHIP", "ENUMERATOR", "GEOGRAPHIC", "PATTERN"]
    assert set(run.skipped) == {"TEMPORAL", "HISTORICAL"}
    found = filter_detections(run.detections, "GEOGRAPHIC_CLUSTER", entity_type="cluster")
    assert found.count() == 2
    assert filter_detections(run.detections, classification="OTHER").count() == 0


def test_rates_have_one_row_per_group(spark):
    df = block(spark, {("E1", "C1", "D1"): (3, 1), ("E2", "C1", "D2"): (0, 2)})
    rows = {(r["scope"], r["group_id"]): r for r in group_rates(Survey.of(df)).collect()}
    assert rows[("dataset", "all")]["n"] == 6
    assert rows[("cluster", "C1")]["district_id"] == "D1"
    assert np.isclose(rows[("enumerator", "E1")]["employment_rate"], 0.75)
    assert df.where(F.col("record_id").isNull()).isEmpty()
