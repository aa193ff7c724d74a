import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.operators.roles import concept, detect_roles


def frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        rows.append((f"R{i}", f"E{i % 3}" if i % 20 else None, f"C{i % 4}", f"D{i % 2}",
                     int(rng.integers(10, 60)) if i % 11 else None, float(rng.normal(100, 15)),
                     ["a", "b", "c"][int(rng.integers(0, 3))] if i % 7 else None))
    rows.append(rows[5])
    return spark.createDataFrame(
        rows, "respondent_id string, Enumerator string, fsu string, district string, age bigint, "
              "income double, answer string")


def test_roles(spark):
    roles = detect_roles(frame(spark))
    assert (roles.record_id, roles.enumerator_id, roles.cluster_id, roles.district_id) == (
        "respondent_id", "Enumerator", "fsu", "district")
    assert roles.numeric_measures == ("age", "income") and roles.categoricals == ("answer",)
    assert concept(frame(spark), "age") == "age" and concept(frame(spark), "sex") is None


def test_profiles_equal_pandas(spark):
    df = frame(spark)
    data = df.toPandas()
    row = profile.dataset_profile(df).first()
    assert row["duplicate_count"] == 1 and row["record_count"] == 121
    assert np.isclose(row["missing_rate"], data.isna().to_numpy().mean())
    found = {r["variable_name"]: r for r in profile.variable_profiles(df).collect()}
    for c in ("age", "income"):
        v = data[c].dropna()
        assert found[c]["missing_count"] == data[c].isna().sum()
        assert found[c]["unique_count"] == v.nunique()
        assert np.allclose(
            [found[c][k] for k in ("mean", "standard_deviation", "median", "p25", "p95")],
            [v.mean(), v.std(), v.median(), v.quantile(.25), v.quantile(.95)])
    top = [(t["value"], t["count"]) for t in found["answer"]["top_values"]]
    counts = data["answer"].value_counts()
    assert dict(top) == counts.to_dict()
    rough = profile.numeric_profiles(df, approx=True)
    assert rough.count() == 2


def test_records_equal_pandas(spark):
    df = frame(spark).dropDuplicates()
    data = df.toPandas().set_index("respondent_id")
    z = profile.record_zscores(df).toPandas().set_index("record_id")
    for c in ("age", "income"):
        expected = (data[c] - data[c].mean()) / data[c].std(ddof=0)
        assert np.allclose(z[f"z_{c}"].astype(float), expected.loc[z.index].astype(float),
                           equal_nan=True)
    p = profile.record_percentiles(df).toPandas()
    for c in ("age", "income"):
        mine = p[p.variable == c].set_index("record_id")["percentile"]
        expected = data[c].rank(method="average", pct=True).loc[mine.index]
        assert np.allclose(mine, expected)
    d = profile.record_deviations(df).toPandas().set_index("record_id")
    expected = data["income"] - data.groupby("Enumerator")["income"].transform("mean")
    assert np.allclose(d["enumerator_dev_income"].astype(float),
                       expected.loc[d.index].astype(float), equal_nan=True)


def test_entities(spark):
    df = frame(spark)
    data = df.toPandas()
    rows = {(r["scope"], r["id"]): r for r in profile.entity_profiles(df).collect()}
    assert rows[("enumerator", "null")]["record_count"] == data["Enumerator"].isna().sum()
    assert rows[("cluster", "C1")]["related_id"] == "D1"
    means = rows[("cluster", "C2")]["numeric_means"]
    assert np.isclose(means["income"], data[data.fsu == "C2"]["income"].mean())
    spread = rows[("district", "D0")]["categorical_distributions"]["answer"]
    assert spread == data[data.district == "D0"]["answer"].value_counts().to_dict()


def test_top_values_break_ties_by_text(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": list("ccbbaad")}))
    rows = profile.top_values(profile.category_counts(df, ["v"]), ["variable"], 3)
    assert [r["value"] for r in rows.orderBy("position").collect()] == ["a", "b", "c"]
    assert rows.where(F.col("count") != 2).count() == 0


def test_copies_of_wide_rows_are_counted_by_digest(spark):
    from plumbline.operators.profile import duplicate_rows, row_copies

    rows = [(i % 40, None if i % 3 else "x", float(i % 2) if i % 5 else None) for i in range(600)]
    rows += [(None, "1", None), (1, None, None), (None, None, None), (7, "y", -0.0), (7, "y", 0.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(5)
    plain = df.groupBy(*df.columns).count()
    got = duplicate_rows(df).first()
    assert (got.rows, got.distinct_rows) == (605, plain.count())
    assert sorted(r[0] for r in row_copies(df).collect()) == sorted(r["count"] for r in plain.collect())
    assert tuple(duplicate_rows(df.limit(0)).first()) == (0, 0, 0)
    alone = duplicate_rows(spark.range(3000).selectExpr("id", "repeat('x', 500) as wide"))
    assert tuple(alone.first()) == (3000, 3000, 0)


def test_records_are_combined_before_scopes(spark):
    """Null orders come first, copies per scope are made of combinations only."""
    df = spark.createDataFrame(
        [(f"R{i}", f"E{i % 2}", f"C{i % 2}" if i else None, f"D{i % 4 // 2}" if i != 5 else None, i, float(i))
         for i in range(400)],
        "respondent_id string, Enumerator string, fsu string, district string, age bigint, at double")
    df = df.withColumn("at", F.when(F.col("respondent_id") != "R7", F.col("at")))
    roles = detect_roles(df)
    rows = profile.scope_sums(df, roles, F.col("at"), [F.col("age").alias("v")],
                              [F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")])
    # (E0, null, D0), (E0, C0, D0), (E0, C0, D1), (E1, C1, D0), (E1, C1, D1), (E1, C1, null)
    assert rows.count() == 6 * 4
    whole = rows.where("scope = 'dataset'").agg(F.sum("n"), F.sum("v")).first()
    assert tuple(whole) == (400, sum(range(400)))
    groups = {(r["scope"], r["id"]): r for r in profile.entity_profiles(df, "at").collect()}
    assert groups["cluster", "C1"]["related_id"] == "D1"  # R7 has no order
    assert groups["cluster", "null"]["record_count"] == 1
    assert groups["enumerator", "E1"]["numeric_means"]["age"] == 200.0
    assert groups["district", "null"]["employment_rate"] is None
