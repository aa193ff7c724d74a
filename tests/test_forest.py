import numpy as np
import pandas as pd
import pytest

from plumbline.config import ForestSettings
from plumbline.operators.forest import (
    apply_medians, fit_medians, mean_depth, run_forest, scaled, score_range, tree_samples,
)

SMALL = ForestSettings(trees=40)


def table(spark, n=40, extreme=True):
    rng = np.random.default_rng(0)
    x = pd.DataFrame({"record_id": [f"R{i}" for i in range(n)],
                      "a": rng.normal(50, 5, n), "b": rng.normal(10, 1, n)})
    if extreme:
        x.loc[len(x)] = ["X", 500.0, 90.0]
    return spark.createDataFrame(x).coalesce(1)


def test_medians(spark):
    df = spark.createDataFrame([(10.0, 4.0), (20.0, 6.0), (None, 8.0), (30.0, None)],
                               "a double, b double")
    assert fit_medians(df, ["a", "b", "gone"]) == {"a": 20.0, "b": 6.0}
    rows = apply_medians(df, {"a": 20.0, "b": 6.0}).collect()
    assert [tuple(r) for r in rows] == [(10, 4), (20, 6), (20, 8), (30, 6)]


def test_the_extreme_record_is_on_top_and_twice_the_same(spark):
    df = table(spark)
    one, two = (run_forest(df, settings=SMALL) for _ in range(2))
    assert one.status == "COMPLETED" and one.training_source == "current_batch"
    a = one.scores.toPandas().set_index("record_id")
    b = two.scores.toPandas().set_index("record_id")
    assert (a["raw"] == b.loc[a.index, "raw"]).all()
    assert a["raw"].idxmax() == "X" and a.loc["X", "anomaly_score"] == 100.0
    assert a["anomaly_score"].between(0, 100).all() and a["raw"].between(0, 1).all()
    evidence = one.evidence.toPandas()
    assert set(evidence["record_id"]) == set(a.index[a["raw"] > 0.5])
    assert evidence.set_index("record_id").loc["X", "severity"] == "HIGH"
    assert (evidence["raw_model_score"] < 0).all()


def test_history_is_preferred_when_large_enough(spark):
    df, past = table(spark), table(spark, 60, extreme=False)
    run = run_forest(df, past, SMALL)
    assert (run.training_source, run.training_records) == ("historical", 60)
    assert run_forest(df, past.limit(5), SMALL).training_source == "current_batch"


def test_too_little_data(spark):
    assert run_forest(table(spark, 10), settings=SMALL).status == "insufficient_data"
    assert run_forest(table(spark).drop("b"), settings=SMALL).status == "insufficient_features"


def test_equal_records_score_zero(spark):
    df = spark.createDataFrame([(f"R{i}", 1.0, 2.0) for i in range(40)],
                               "record_id string, a double, b double")
    scores = run_forest(df, settings=SMALL).scores.toPandas()
    assert (scores["anomaly_score"] == 0).all()


def test_contamination_share(spark):
    run = run_forest(table(spark, 99), settings=ForestSettings(trees=40, contamination=0.1))
    assert run.evidence.count() == pytest.approx(10, abs=1)


def test_scaling(spark):
    raw = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "raw double")
    assert [r["s"] for r in raw.coalesce(1).select(scaled(0.0, 10.0).alias("s")).collect()] == [
        0, 10, 20, 100]
    low, high = score_range(raw)
    assert np.allclose([low, high], np.percentile([0, 1, 2, 10], [1, 99]))


def test_expected_depth():
    assert mean_depth(1) == 0 and mean_depth(2) == 1
    assert mean_depth(256) == pytest.approx(10.2448, abs=1e-3)


@pytest.mark.parametrize("n", [300, 9000])
def test_labels_do_not_depend_on_partitions(spark, n):
    """Also above the size at which a row serves a few trees only, and with copies."""
    settings = ForestSettings(trees=10, subsample=64)
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"record_id": [f"R{i}" for i in range(n)], "a": rng.normal(50, 5, n).round(1),
                      "b": rng.integers(0, 30, n).astype(float)})
    df = spark.createDataFrame(x)
    runs = [run_forest(df.repartition(p), settings=settings).scores.toPandas().set_index("record_id")
            for p in (1, 7, 64)]
    for r in runs[1:]:
        assert (r.loc[runs[0].index, "raw"] == runs[0]["raw"]).all()
        assert (r.loc[runs[0].index, "anomalous"] == runs[0]["anomalous"]).all()


def test_every_tree_gets_its_sample(spark):
    for n, trees in ((40, 20), (700, 5), (20000, 20)):
        s = ForestSettings(trees=trees, subsample=128)
        df = spark.range(n).selectExpr("cast(id as double) a", "cast(id % 7 as double) b")
        samples, size = tree_samples(df, n, s)
        got = samples.groupBy("tree").count().collect()
        assert len(got) == trees and {r["count"] for r in got} == {size} == {min(128, n)}
        assert samples.select("tree", "a").distinct().count() == trees * size


def test_a_row_repeated_ten_million_times(spark):
    """Its share of every sample is its share of the table, and only candidates are shuffled."""
    n, others = 10 ** 7, 2_000_000
    s = ForestSettings(trees=12, subsample=256)
    df = spark.range(n).selectExpr("cast(1 as double) a", "cast(2 as double) b").union(
        spark.range(others).selectExpr("cast(id + 10 as double)", "cast(id % 7 as double)"))
    runs = []
    for parts in (3, 16):
        samples, size = tree_samples(df.repartition(parts), n + others, s)
        runs.append(sorted(map(tuple, samples.collect())))
    assert runs[0] == runs[1] and size == 256 and len(runs[0]) == 12 * 256
    share = sum(r[2] == 1.0 for r in runs[0]) / len(runs[0])
    assert share == pytest.approx(n / (n + others), abs=0.03)
    for tree in range(12):
        assert 180 < sum(r[2] == 1.0 for r in runs[0] if r[0] == tree) < 240


def test_the_draw_shuffles_candidates_only(spark):
    df = spark.range(100000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b")
    samples, _ = tree_samples(df, 100000, ForestSettings(trees=10, subsample=16))
    samples.collect()
    plan = samples._jdf.queryExecution().executedPlan()
    shuffled, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "ShuffleExchange" in node.getClass().getSimpleName():
            shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert shuffled and max(shuffled) < 1500
