import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import order_stats
from plumbline.functions.order_stats import exact_quantiles, rank_table
from plumbline.functions.sequences import neighbours, running_sum
from plumbline.plans.lookup import lookup_join, materialize

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]


def sample(n=5000):
    rng = np.random.default_rng(1)
    hot = np.where(rng.random(n) < 0.34, 7.0, np.exp(rng.normal(3, 2, n)))
    return pd.DataFrame({"x": hot, "y": rng.integers(0, 9, n).astype(float)})


def test_quantiles_match_numpy_however_far_brackets_go(spark):
    data = sample()
    df = spark.createDataFrame(data).repartition(5)
    columns = {"x": F.col("x"), "y": F.col("y")}
    found = [exact_quantiles(d, columns, PROBS, inside_rows=n)
             for d, n in ((df, 10**6), (df, 100), (df, 1), (df.repartition(1), 30), (df.repartition(64), 30))]
    for c in columns:
        assert np.allclose(found[0][c], np.quantile(data[c], PROBS), rtol=1e-12)
    assert all(f == found[0] for f in found)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5]) == {
        "a": None, "b": [1.0]}


def test_ranks_match_pandas(spark):
    data = sample(2000)
    long = pd.concat([pd.DataFrame({"variable": c, "value": data[c]}) for c in data])
    ranks = rank_table(spark.createDataFrame(long), "variable", "value", range_rows=20).toPandas()
    for c in data:
        mine = ranks[ranks.variable == c].sort_values("value")
        low, high = data[c].rank(method="min"), data[c].rank(method="max")
        expected = pd.DataFrame({"v": data[c], "l": low, "h": high}).drop_duplicates().sort_values("v")
        assert (mine["first_rank"].to_numpy() == expected["l"].to_numpy()).all()
        assert (mine["last_rank"].to_numpy() == expected["h"].to_numpy()).all()
        assert (mine["total"] == len(data)).all()


def test_lookup_gives_one_answer_on_every_path(spark):
    facts = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(900)], "id int, k string")
    table = materialize(facts.where("k <> 'k6'").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
    ways = [
        lookup_join(facts, table, ["k"]),
        lookup_join(facts, table, ["k"], broadcast_rows=0),
        lookup_join(facts, table, ["k"], weight="n", broadcast_rows=0),
    ]
    answers = [sorted((r["id"], r["k"], r["top"]) for r in w.collect()) for w in ways]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 900


def nodes(df):
    """Names of the executed plan's nodes, stages of an adaptive plan included, with their text."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        out.append((kind, node.simpleString(200)))
        if "AdaptiveSparkPlan" in kind:
            todo.append(node.executedPlan())
        elif "QueryStage" in kind:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_three_large_lookups_scan_the_facts_once(spark, tmp_path, monkeypatch):
    from plumbline.plans import lookup

    rows = [(i, "hot" if i % 3 else f"k{i % 50}", None if i % 7 == 0 else f"b{i % 11}", f"c{i % 90}") for i in range(900)]
    spark.createDataFrame(rows, "id int, a string, b string, c string").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    out = facts
    for k in "abc":
        held = materialize(facts.where(F.col(k).isNotNull() & (F.col(k) != "k6")).groupBy(k).agg(
            F.count(F.lit(1)).alias(f"n_{k}"), F.max("id").alias(f"top_{k}")))
        out = lookup_join(out, held, [k], weight=f"n_{k}", broadcast_rows=0)
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.5)
    cold = lookup_join(facts, held, ["c"], weight="n_c", broadcast_rows=0)
    scans = [text for kind, text in nodes(out) if kind.startswith("FileSourceScan")]
    assert len(scans) == 1
    top = {}
    for r in rows:
        for k, v in zip("abc", r[1:]):
            top[k, v] = max(top.get((k, v), -1), r[0])
    for r in out.collect():
        for k in "abc":
            known = r[k] is not None and r[k] != "k6"
            assert r[f"top_{k}"] == (top[k, r[k]] if known else None)
    assert out.count() == 900 and sorted(r.top_c for r in cold.collect()) == sorted(top["c", r[3]] for r in rows)
    assert out.columns == ["c", "b", "a", "id", "n_a", "top_a", "n_b", "top_b", "n_c", "top_c"]


def test_wide_tables_are_not_broadcast(spark, monkeypatch):
    from plumbline.plans import lookup

    facts = spark.range(50).selectExpr("id", "cast(id % 9 as string) k")
    table = materialize(facts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("text", F.repeat(F.lit("x"), 500)))
    monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    for limit, broadcast in ((10 ** 6, True), (1000, False)):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
        joined = lookup_join(facts, table, ["k"], weight="n")
        assert ("_salt" in joined._jdf.queryExecution().optimizedPlan().toString()) is not broadcast
        assert joined.where("length(text) = 500").count() == 50


def test_a_marked_split_loses_no_key(spark):
    from plumbline.plans.lookup import maybe_in

    df = spark.range(5000).selectExpr("if(id % 50 = 0, null, id) as id", "id as n")
    keys = spark.range(0, 5000, 7)
    some, others = maybe_in(df, keys, "id")
    assert some.columns == others.columns == ["id", "n"] and some.count() + others.count() == 5000
    assert some.join(keys, "id").count() == df.join(keys, "id").count()
    assert others.where("id is null").count() == 100 and others.count() > 3500
    none, rest = maybe_in(df, keys.limit(0), "id")
    assert not none.count() and rest.count() == 5000


def test_ranges_of_ranks_follow_the_values(spark):
    df = spark.range(3000).selectExpr("'a' as k", "cast(id % 1000 as double) v").union(
        spark.range(5).selectExpr("'b'", "cast(1 as double)"))
    for size in (100, 10 ** 6):
        got = {(r.k, r.value): (r.first_rank, r.last_rank, r.total) for r in
               rank_table(df.withColumnRenamed("v", "value"), "k", "value", range_rows=size).collect()}
        assert got == {("a", float(i)): (3 * i + 1, 3 * i + 3, 3000) for i in range(1000)} | {("b", 1.0): (1, 5, 5)}
    assert not rank_table(df.limit(0).withColumnRenamed("v", "value"), "k", "value").collect()


def test_long_sequences_are_the_same_when_cut(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{d}", i, i // 7, int(rng.integers(0, 2))) for d in range(3) for i in range(40 + d)]
    df = spark.createDataFrame(rows, "d string, i int, b int, v int")
    data = df.toPandas().sort_values(["d", "i"])
    group = data.groupby("d")["v"]
    for step in (-1, 1):
        found = neighbours(df, ["d"], "b", ["i"], {"other": "v"}, step).toPandas()
        found = found.sort_values(["d", "i"])
        expected = group.shift(-step).to_numpy()
        assert np.array_equal(found["other"].to_numpy(dtype=float), expected, equal_nan=True)
    total = running_sum(df, ["d"], "b", ["i"], F.col("v"), "s").toPandas().sort_values(["d", "i"])
    assert (total["s"].to_numpy() == group.cumsum().to_numpy()).all()


def test_quantiles_of_a_column_share_a_sketch(spark, monkeypatch):
    made = []
    sketch = F.percentile_approx

    def counted(*args):
        made.append(args)
        return sketch(*args)

    monkeypatch.setattr(order_stats.F, "percentile_approx", counted)
    df = spark.range(3000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    found = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.25, 0.5, 0.75], inside_rows=2999)
    assert found == {"a": [749.75, 1499.5, 2249.25], "b": [1499.5, 2999.0, 4498.5]}
    assert len(made) == 2  # one pass, a sketch per column
