"""Isolation forest over numeric measures.

Trees are grown in parallel from small samples (one group per tree, at most
``subsample`` rows each) and become a node table bounded by trees x subsample.
That table is broadcast and all records are scored in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.config import ForestSettings
from plumbline.functions.order_stats import exact_quantiles
from plumbline.operators.roles import (
    detect_roles, eligible_measures, id_columns, measure_matrix,
)
from plumbline.plans.lookup import empty_frame, materialize
from plumbline.plans.workers import ship

ship(__name__)

# A row with more than this share of all rows is drawn by its number of copies.
HEAVY = 0.001
MODEL_TYPE = "isolation_forest"
MODEL_VERSION = "isolation_forest-v1"
NODES = "tree int, node int, feature int, threshold double, below int, above int, depth double"
EVIDENCE = (
    "record_id string, enumerator_id string, cluster_id string, district_id string, "
    "model_type string, model_version string, feature_names array<string>, "
    "anomaly_score double, raw_model_score double, prediction string, severity string, "
    "training_source string, training_records bigint"
)


@dataclass(frozen=True)
class ForestRun:
    status: str
    evidence: DataFrame
    scores: DataFrame | None = None
    features: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    training_source: str = "none"
    training_records: int = 0


def fit_medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians; a feature without values is left out."""
    matrix = measure_matrix(df, features)
    found = exact_quantiles(matrix, {f: F.col(f) for f in features}, [0.5])
    return {f: q[0] for f, q in found.items() if q is not None}


def apply_medians(df: DataFrame, medians: dict[str, float], keep: list | None = None) -> DataFrame:
    return measure_matrix(df, list(medians), keep).fillna(medians)


def mean_depth(n: int) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (number, feature, threshold, below, above, depth) of one tree."""
    nodes: list[tuple] = []
    waiting = [(0, points, 0)]
    used = 1
    while waiting:
        number, rows, depth = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(open_features) == 0:
            nodes.append((number, 0, math.inf, number, number, depth + mean_depth(len(rows))))
            continue
        f = int(rng.choice(open_features))
        cut = rng.uniform(low[f], high[f])
        left = rows[:, f] <= cut
        nodes.append((number, f, cut, used, used + 1, 0.0))
        waiting += [(used, rows[left], depth + 1), (used + 1, rows[~left], depth + 1)]
        used += 2
    return sorted(nodes)


def _uniform(*cells) -> Column:
    """A hash of the cells in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cells), 11) / float(1 << 53)


def identified(df: DataFrame) -> Column:
    """A hash of all cells of a record, its ids among them, as ``_row``."""
    cells = sorted(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString())
    return F.xxhash64(*[F.col(f"`{c}`") for c in cells]).alias("_row")


def tree_samples(matrix: DataFrame, rows: int, s: ForestSettings) -> tuple[DataFrame, int]:
    """(tree, _place, features) and the sample size per tree.

    Rows are drawn by a hash of ``_row`` (of their cells, if the matrix has no such column),
    so a table gives the same samples however it is partitioned. A row is a candidate of
    about 3 x trees x size / rows trees (of all, in a small table) and a tree takes the
    ``size`` candidates of smallest hash. That is decided row by row before anything is
    shuffled: only candidates are, and of those each task passes on ``size`` per tree.

    Rows equal in all that ``_row`` covers come or stay together, which matters only where
    they are many: those with more than HEAVY of all rows, at most 1 / HEAVY of them, are
    found by a sketch, counted, and drawn by a binomial on their number.
    """
    features = [c for c in matrix.columns if c != "_row"]
    keyed = matrix if "_row" in matrix.columns else matrix.withColumn("_row", F.xxhash64(*features))
    size = min(s.subsample, rows)
    wanted = 3.0 * s.trees * size / max(rows, 1)
    turns = min(s.trees, math.ceil(wanted))
    rate = min(1.0, wanted / turns)
    heavy = _heavy_rows(keyed, features, max(size, int(HEAVY * rows)))
    if heavy is not None:
        keyed = keyed.join(F.broadcast(heavy.select("_row")), "_row", "left_anti")
    start = F.floor(_uniform(F.lit(s.seed), "_row") * s.trees).cast("int")
    drawn = (
        keyed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        .withColumn("tree", (start + F.col("_turn")) % s.trees)
        .withColumn("_draw", _uniform(F.lit(s.seed + 1), "tree", "_row"))
        .where(F.col("_draw") < rate)
        .groupBy("tree", "_draw", "_row", *features).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(size), "_n").cast("int"))))
        .select("tree", "_draw", "_copy", *features)
    )
    if heavy is not None:
        ddl = "tree int, _draw double, _copy int, " + ", ".join(f"`{f}` double" for f in features)
        chosen = heavy.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(s.trees - 1)))).mapInPandas(
            _copies(features, min(1.0, wanted / s.trees), rate, size, s.seed), ddl)
        drawn = drawn.unionByName(chosen)
    by_tree = Window.partitionBy("tree").orderBy("_draw", *features, "_copy")
    placed = drawn.withColumn("_place", F.row_number().over(by_tree)).where(F.col("_place") <= size)
    return placed.select("tree", "_place", *features), size


def _heavy_rows(keyed: DataFrame, features: list[str], limit: int) -> DataFrame | None:
    """(_row, features, _n) of rows with more than ``limit`` copies, stored; None without any.

    The sketch misses none of them: it errs by less than 1 / 4000 of the rows, and no more
    than its 1400 items can have that much less than HEAVY.
    """
    likely = keyed.agg(F.expr("approx_top_k(_row, 1400, 16384)").alias("k")).first()["k"] or []
    items = [(r["item"],) for r in likely if r["count"] > 1]
    if not items:
        return None
    some = keyed.sparkSession.createDataFrame(items, "_row bigint")
    counted = keyed.join(F.broadcast(some), "_row").groupBy("_row", *features).agg(F.count(F.lit(1)).alias("_n"))
    heavy = materialize(counted.where(F.col("_n") > limit))
    return None if heavy.isEmpty() else heavy


def _copies(features: list[str], share: float, rate: float, size: int, seed: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The copies of a heavy row that a tree draws: a binomial number of uniform draws."""
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                rng = np.random.default_rng([seed, r["_row"] % (1 << 64), r["tree"]])
                draws = np.sort(rng.random(rng.binomial(r["_n"], share)))[:size] * rate
                out += [(r["tree"], d, i + 1, *(r[f] for f in features)) for i, d in enumerate(draws)]
            yield pd.DataFrame(out, columns=["tree", "_draw", "_copy", *features])

    return run


def grow_forest(matrix: DataFrame, rows: int, s: ForestSettings) -> tuple[pd.DataFrame, int]:
    """Node table of all trees and the sample size per tree."""
    features = [c for c in matrix.columns if c != "_row"]
    samples, size = tree_samples(matrix, rows, s)
    limit = math.ceil(math.log2(max(size, 2)))
    seed = s.seed

    def build(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        points = sample.sort_values("_place")[features].to_numpy(dtype=float)
        nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "below", "above",
                                           "depth"])
        out.insert(0, "tree", tree)
        return out

    # At most trees x (2 x subsample - 1) rows.
    return samples.groupBy("tree").applyInPandas(build, NODES).toPandas(), size


def score_rows(df: DataFrame, features: list[str], nodes: pd.DataFrame, size: int) -> DataFrame:
    """Add ``raw``: 2^(-mean depth / expected depth), higher is more unusual."""
    nodes = nodes.sort_values(["tree", "node"])
    sizes = nodes.groupby("tree").size().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    offset = np.repeat(starts, sizes)
    shared = df.sparkSession.sparkContext.broadcast((
        starts, nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(),
        nodes["below"].to_numpy() + offset, nodes["above"].to_numpy() + offset,
        nodes["depth"].to_numpy(),
    ))
    levels = math.ceil(math.log2(max(size, 2)))
    expected = mean_depth(size)

    @F.pandas_udf("double")
    def raw(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        starts, feature, threshold, below, above, depth = shared.value
        for columns in parts:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            at = np.broadcast_to(starts, (len(x), len(starts))).copy()
            lines = np.arange(len(x))[:, None]
            for _ in range(levels):
                at = np.where(x[lines, feature[at]] <= threshold[at], below[at], above[at])
            mean = depth[at].mean(axis=1)
            yield pd.Series(np.power(2.0, -mean / expected) if expected else np.ones(len(x)))

    return df.withColumn("raw", raw(*[F.col(f) for f in features]))


def score_range(raw: DataFrame) -> tuple[float, float]:
    """1st and 99th percentile of the training population's raw scores."""
    low, high = exact_quantiles(raw, {"raw": F.col("raw")}, [0.01, 0.99])["raw"]
    return low, high


def scaled(low: float, high: float):
    """0-100 column; zero everywhere when the training scores do not vary."""
    if abs(high - low) < 1e-12:
        return F.lit(0.0)
    return F.least(F.lit(100.0), F.greatest(
        F.lit(0.0), (F.col("raw") - F.lit(low)) / F.lit(high - low) * 100.0))


def forest_severity(score, s: ForestSettings):
    return (F.when(score >= s.score_high, "HIGH").when(score >= s.score_medium, "MEDIUM")
            .otherwise("LOW"))


def run_forest(
    df: DataFrame,
    history: DataFrame | None = None,
    settings: ForestSettings = ForestSettings(),
    features: list[str] | None = None,
) -> ForestRun:
    """Train on earlier batches if they are enough, else on this batch."""
    s = settings
    roles = detect_roles(df)
    features = eligible_measures(roles) if features is None else features
    nothing = empty_frame(df.sparkSession, EVIDENCE)
    if len(features) < s.min_features:
        return ForestRun("insufficient_features", nothing, features=features)
    source, training, rows = "historical", None, 0
    if history is not None and all(f in history.columns for f in features):
        training, rows = history, history.count()
    if training is None or rows < s.min_training_records:
        earlier = rows
        training, source, rows = df, "current_batch", df.count()
        if rows < s.min_training_records:
            return ForestRun("insufficient_data", nothing, features=features,
                             training_records=earlier)
    medians = fit_medians(training, features)
    used = list(medians)
    if len(used) < s.min_features:
        return ForestRun("insufficient_features", nothing, features=used, medians=medians,
                         training_source=source, training_records=rows)
    nodes, size = grow_forest(apply_medians(training, medians, [identified(training)]), rows, s)
    # Scores feed several aggregates; they are computed once and written.
    current = materialize(
        score_rows(apply_medians(df, medians, id_columns(df, roles)), used, nodes, size)
        .drop(*used)
    )
    trained = current if source == "current_batch" else materialize(
        score_rows(apply_medians(training, medians), used, nodes, size).select("raw"))
    low, high = score_range(trained)
    cut = 0.5
    if s.contamination != "auto":
        share = 1.0 - float(s.contamination)
        cut = exact_quantiles(trained, {"raw": F.col("raw")}, [share])["raw"][0]
    scores = current.withColumn("anomaly_score", scaled(low, high)).withColumn(
        "anomalous", F.col("raw") > F.lit(cut))
    evidence = scores.where("anomalous").select(
        "record_id", "enumerator_id", "cluster_id", "district_id",
        F.lit(MODEL_TYPE).alias("model_type"), F.lit(MODEL_VERSION).alias("model_version"),
        F.array(*[F.lit(f) for f in used]).alias("feature_names"),
        "anomaly_score", (-F.col("raw")).alias("raw_model_score"),
        F.lit("anomaly").alias("prediction"),
        forest_severity(F.col("anomaly_score"), s).alias("severity"),
        F.lit(source).alias("training_source"),
        F.lit(rows).cast("bigint").alias("training_records"),
    )
    return ForestRun("COMPLETED", evidence, scores, used, medians, source, rows)


def forest_summary(df: DataFrame, run: ForestRun) -> DataFrame:
    return run.evidence.agg(
        F.count(F.lit(1)).alias("anomalies"),
        *[F.count_if(F.col("severity") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")],
    ).select(
        F.lit(run.status).alias("status"), F.lit(len(run.features)).alias("features_used"),
        "anomalies", "high", "medium", "low", F.lit(run.training_source).alias("training_source"),
        F.lit(run.training_records).cast("bigint").alias("training_records"),
    )
