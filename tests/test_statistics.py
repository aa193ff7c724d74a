import pytest
from pyspark.sql import functions as F

from plumbline.config import StatSettings
from plumbline.functions.scoring import z_severity
from plumbline.operators.statistics import (
    batch_baselines, evaluate_statistics, historical_shift, latest_baselines, record_evidence,
)


def values(spark, xs, groups=None):
    rows = [(f"R{i}", (groups or ["E1"] * len(xs))[i], float(x)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "record_id string, enumerator_id string, x double")


def flagged(df, detector):
    return {r["record_id"]: r["severity"]
            for r in record_evidence(df, detectors=(detector,)).collect()}


@pytest.mark.parametrize("z, expected", [(1.9, None), (2.0, "MEDIUM"), (2.9, "MEDIUM"),
                                         (3.0, "HIGH")])
def test_z_limits(spark, z, expected):
    assert spark.range(1).select(z_severity(F.lit(z), StatSettings()).alias("s")).first()["s"] \
        == expected


def test_single_outlier(spark):
    assert flagged(values(spark, [10] * 9 + [40]), "z_score") == {"R9": "MEDIUM"}
    assert flagged(values(spark, [12] * 10), "z_score") == {}
    assert flagged(values(spark, [1, 2, 90]), "z_score") == {}


def test_fences(spark):
    found = record_evidence(values(spark, [1, 2, 3, 4, 5, 6, 7, 8, 100]), detectors=("iqr",))
    row = found.first()
    assert found.count() == 1 and row["record_id"] == "R8" and row["severity"] == "HIGH"
    assert (row["score"], row["threshold"], row["baseline_value"], row["baseline_std"]) == (
        100.0, 3.0, 5.0, 4.0)


def test_groups_and_mad(spark):
    xs = [10, 11, 10, 11, 10, 11, 10, 60] + [100, 101, 100, 101]
    df = values(spark, xs, ["E1"] * 8 + ["E2"] * 4)
    assert set(flagged(df, "group_z_score")) == {"R7"}
    assert "R7" in flagged(values(spark, xs[:8]), "mad")


def history(spark, mean, std, batch="B1", at=1):
    return spark.createDataFrame([(batch, at, "x", mean, std)],
                                 "batch_id string, created_at int, variable string, "
                                 "mean double, std double")


@pytest.mark.parametrize("std, score, severity", [(None, 4.0, "HIGH"), (1.0, 32.0, "HIGH")])
def test_history(spark, std, score, severity):
    current = batch_baselines(values(spark, [40] * 8))
    row = historical_shift(current, latest_baselines(history(spark, 8.0, std), "B2")).first()
    assert (row["score"], row["severity"]) == (score, severity)
    assert row["record_id"] is None and row["evidence"]["source_batch_id"] == "B1"


def test_history_is_the_newest_other_batch(spark):
    log = history(spark, 8.0, 1.0).union(history(spark, 9.0, 1.0, "B3", 3)).union(
        history(spark, None, 1.0, "B4", 4)).union(history(spark, 1.0, 1.0, "B2", 9))
    assert latest_baselines(log, "B2").first()["hist_mean"] == 9.0
    assert evaluate_statistics(values(spark, [40] * 8), log, "B2").count() == 1
    assert evaluate_statistics(values(spark, [9.2] * 8), log, "B2").count() == 0


def test_wide_group_tables_give_the_same(spark, monkeypatch):
    from plumbline.plans import lookup

    df = values(spark, [i % 7 + (50 if i % 40 == 0 else 0) for i in range(200)],
                [f"E{i % 8}" if i % 3 else "E0" for i in range(200)])
    columns = ["record_id", "scope", "score"]
    first = sorted(map(tuple, record_evidence(df).select(*columns).collect()))
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, record_evidence(df).select(*columns).collect())) == first
