"""Nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected on M Gaussian directions: for a distance d, the squared
projected distance over d * d follows a chi-square law with M degrees of freedom. A
kd-tree over the projections is fitted on a bounded sample; every vector is dealt to
its leaf, large leaves to several blocks. A query first searches its own leaf. Then it
visits the other leaves whose box may still hold a nearer vector: where the chi-square
probability of the box distance over the best distance so far reaches P, a nearer
vector that far away in the projection is unlikely, and the leaf is skipped. Inside a
block, projected neighbours are verified in rising order under the same stopping test.

With probability P or more each true neighbour passes the test. Distances are exact,
in double precision, on the given vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, gamma, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import _runs, arrow_batches, hot_join, need, union_all, written
from plumbline.plans.workers import ship

ship(__name__)
DIRECTIONS = 8
PROBABILITY = 0.98
SAMPLE_ROWS = 20_000
LEAF_ROWS = 2048
STEP = 64


def chi_square(x: np.ndarray, m: int = DIRECTIONS) -> np.ndarray:
    """Distribution function of the chi-square law with an even or odd number ``m``."""
    x = np.maximum(np.asarray(x, dtype=float), 0) / 2
    if m % 2 == 0:
        term, total = np.ones_like(x), np.ones_like(x)
        for i in range(1, m // 2):
            term = term * x / i
            total = total + term
        return 1 - np.exp(-x) * total
    p = np.vectorize(lambda v: erf(sqrt(v)))(x)
    for i in range(m // 2):
        p = p - np.exp(-x) * x ** (i + 0.5) / gamma(i + 1.5)
    return p


def stop_ratio(probability: float, m: int) -> float:
    """The squared ratio of projected to best distance at which the test holds."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi_square(mid, m) >= probability else (mid, hi)
    return hi


@dataclass
class Tree:
    """Splits of a kd-tree in heap order and the box of each leaf."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.axis[at]] > self.cut[at]
            at = 2 * at + 1 + right
        return at - (2 ** self.depth - 1)

    def box_distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distance from each row to each leaf's box."""
        gap = np.zeros((1, len(x), x.shape[1]))
        for level in range(self.depth):
            nodes = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
            side = x[:, self.axis[nodes]].T - self.cut[nodes][:, None]
            both = np.repeat(gap, 2, axis=0)
            for i, node in enumerate(nodes):
                a = self.axis[node]
                both[2 * i, :, a] = np.maximum(both[2 * i, :, a], side[i])
                both[2 * i + 1, :, a] = np.maximum(both[2 * i + 1, :, a], -side[i])
            gap = both
        return (np.maximum(gap, 0) ** 2).sum(axis=2).T


def grow(sample: np.ndarray, depth: int) -> Tree:
    """Split at the median of the widest axis, level by level."""
    axis = np.zeros(2 ** depth - 1, dtype=np.int64)
    cut = np.zeros(2 ** depth - 1)
    members = [sample]
    for node in range(2 ** depth - 1):
        mine = members[node]
        if len(mine):
            axis[node] = int(np.argmax(mine.std(axis=0)))
            cut[node] = float(np.median(mine[:, axis[node]]))
        right = mine[:, axis[node]] > cut[node]
        members += [mine[~right], mine[right]]
    return Tree(depth, axis, cut)


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(17).normal(size=(dim, m))


# --- one block of the index against a stream of queries ---------------------------------

@dataclass
class Block:
    """Distinct vectors, their projections, and the ids that share each vector."""

    vectors: np.ndarray
    projected: np.ndarray
    ids: list[list[int]]

    def nearest(self, q: np.ndarray, p: np.ndarray, most: int, bound: float,
                ratio: float) -> tuple[list[float], list[int]]:
        """Up to ``most`` nearest ids within ``bound``: rows are verified in rising
        projected distance, in growing steps, until the stopping test holds."""
        apart = ((self.projected - p) ** 2).sum(axis=1)
        order = np.argsort(apart, kind="stable")
        found: list[tuple[float, int]] = []
        at, step = 0, STEP
        while at < len(order) and apart[order[at]] <= ratio * bound * bound:
            rows = order[at:at + step]
            exact = np.sqrt(((self.vectors[rows] - q) ** 2).sum(axis=1))
            found += [(d, i) for d, r in zip(exact.tolist(), rows.tolist(), strict=True) if d <= bound
                      for i in self.ids[r]]
            found = sorted(found)[:most]
            if len(found) == most:
                bound = min(bound, found[-1][0])
            at, step = at + step, step * 2
        return [d for d, _ in found], [i for _, i in found]


def _search(points: DataFrame, queries: DataFrame, r: np.ndarray, most: int, ratio: float) -> DataFrame:
    """(q, bound, ids, dist) of each (query, block) of ``queries``; the vectors of a block
    are held, its queries stream past."""
    left = points.select("leaf", "salt", "split", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("q"),
                         F.lit(None).cast("double").alias("bound"), "ids", "vector")
    right = queries.select("leaf", "salt", "split", F.lit(1).alias("kind"), "q", "bound",
                           F.lit(None).cast("array<bigint>").alias("ids"), "vector")
    keys = ["leaf", "salt", "split"]
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind")
    schema = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in range(4)]
            for lo, hi in _runs(columns, batch.num_rows):
                *key, kind = (c[lo].as_py() for c in columns)
                part = batch.slice(lo, hi - lo)
                if key != at:
                    at, held, block = key, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if block is None:
                    x = np.concatenate([vectors_of(h.column("vector")) for h in held] or
                                       [np.zeros((0, len(r)))])
                    block = Block(x, x @ r, [i for h in held for i in h.column("ids").to_pylist()])
                out = {"q": [], "ids": [], "dist": []}
                y = vectors_of(part.column("vector"))
                for q, v, p, bound in zip(part.column("q").to_pylist(), y, y @ r,
                                          part.column("bound").to_pylist(), strict=True):
                    dist, ids = block.nearest(v, p, most, bound, ratio)
                    out["q"].append(q)
                    out["ids"].append(ids)
                    out["dist"].append(dist)
                yield pa.RecordBatch.from_pydict(out, schema)

    return dealt.mapInArrow(run, "q bigint, ids array<bigint>, dist array<double>")


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


# --- the operator -----------------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of rows with an id and a finite vector other than zero; of rows
    with one id the smallest vector counts."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (need(vectors, "vec_id", "embedding").withColumnRenamed("embedding", "vector")
            .where(F.col("vec_id").isNotNull() & v.isNotNull())
            .where(fine & F.exists(v, lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("vector").alias("vector")))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, m: int = DIRECTIONS,
            probability: float = PROBABILITY, sample_rows: int = SAMPLE_ROWS,
            leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row whose vec_id is
    divisible by ``every``, among all rows but its own, ties to the smaller vec_id.

    Score is the Euclidean distance. Rows without an id, and null, zero or non-finite
    vectors take no part. Vectors of one length are compared with each other only.
    Equal vectors are one entry of the index with the k + 1 smallest ids, which is all
    that a list of k can hold, so copies cost nothing.
    """
    spark = arrow_batches(vectors.sparkSession)
    rows = written(usable(vectors), "vectors")
    best = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    classes = written(
        rows.withColumn("n", best).where(F.col("n") <= k + 1).groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("q", F.col("ids")[0]), "vector_classes")
    asked = rows.where(F.col("vec_id") % every == 0)
    found = []
    for (dim,) in sorted(tuple(r) for r in classes.select(F.size("vector")).distinct().collect()):
        mine = classes.where(F.size("vector") == dim)
        wanted = (asked.where(F.size("vector") == dim).groupBy("vector").agg(F.count("*").alias("n"))
                  .join(mine, "vector").select("q", "n", "vector"))
        found.append(_nearest_classes(mine, written(wanted, "asked"), dim, k + 1, m, probability,
                                      sample_rows, leaf_rows))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tops = written(union_all(found), "tops")
    named = asked.join(classes.select("vector", "q"), "vector").select(
        F.col("vec_id").alias("query_id"), "q")
    out = hot_join(named, tops, "q", "n").select(
        "query_id", F.expr("filter(top, x -> x.vec_id <> query_id)").alias("top"))
    out = out.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id",
                      F.col("x.score").alias("score"))


def _nearest_classes(classes: DataFrame, wanted: DataFrame, dim: int, most: int, m: int,
                     probability: float, sample_rows: int, leaf_rows: int) -> DataFrame:
    """(q, n, top) with the ``most`` nearest ids of every wanted class, itself included."""
    r, ratio = directions(dim, m), stop_ratio(probability, m)
    total, asked = classes.count(), wanted.count()
    sample = (classes.orderBy(F.xxhash64("q"), "q").select("vector").limit(sample_rows)).toArrow()
    projected = vectors_of(sample.column("vector").combine_chunks()) @ r
    depth = max(0, min(int(np.ceil(np.log2(max(total, 1) / leaf_rows))),
                       int(np.log2(max(len(projected), 16) / 16))))
    tree = grow(projected, depth)
    leaves = 2 ** depth
    salts = max(1, -(-total // (leaf_rows * leaves)))
    splits = max(1, -(-asked // 20_000))
    salted = F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int")

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
        names = [c for c in columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.leaves(vectors_of(b.column("vector")) @ r).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*names, "leaf"])

        return df.select(*columns).mapInArrow(run, f"{schema}, leaf int")

    every_split = F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split")
    points = placed(classes, "q", "ids", "vector").select("leaf", salted.alias("salt"), "ids", "vector", every_split)
    split = F.pmod(F.xxhash64("q", F.lit(1)), F.lit(splits)).cast("int").alias("split")
    home = placed(wanted, "q", "vector").select(
        "q", "vector", "leaf", salted.alias("salt"), split, F.lit(float("inf")).alias("bound"))
    first = written(_search(points, home, r, most, ratio), "home_found")
    bounds = first.select("q", F.when(F.size("dist") >= most, F.element_at("dist", -1))
                          .otherwise(float("inf")).alias("bound"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that the stopping test does not exclude, but for the one searched."""
        for b in batches:
            p = vectors_of(b.column("vector")) @ r
            bound = b.column("bound").to_numpy()
            near = tree.box_distances(p) <= (ratio * bound * bound)[:, None]
            row, leaf = np.nonzero(near)
            row, leaf = np.repeat(row, salts), np.repeat(leaf, salts)
            salt = np.tile(np.arange(salts), len(row) // salts)
            seen = ((leaf == b.column("leaf").to_numpy()[row])
                    & (salt == b.column("salt").to_numpy()[row]))
            row, leaf, salt = row[~seen], leaf[~seen], salt[~seen]
            for lo in range(0, len(row), 2000):
                at = pa.array(row[lo:lo + 2000])
                yield pa.RecordBatch.from_arrays(
                    [b.column("q").take(at), b.column("vector").take(at), b.column("bound").take(at),
                     pa.array(leaf[lo:lo + 2000].astype(np.int32)),
                     pa.array(salt[lo:lo + 2000].astype(np.int32))],
                    ["q", "vector", "bound", "leaf", "salt"])

    kind = wanted.schema["vector"].dataType.simpleString()
    ahead = (home.drop("bound", "split").join(bounds, "q").select("q", "vector", "bound", "leaf", "salt")
             .mapInArrow(visits, f"q bigint, vector {kind}, bound double, leaf int, salt int")
             .select("*", split))
    second = _search(points, ahead, r, most, ratio)
    both = first.unionByName(second).select("q", F.explode(F.arrays_zip("dist", "ids")).alias("x")).select(
        "q", F.col("x.dist").alias("score"), F.col("x.ids").alias("vec_id"))
    rank = F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))
    tops = (both.withColumn("n", rank).where(F.col("n") <= most).groupBy("q")
            .agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("top")))
    return tops.join(wanted.select("q", "n"), "q").select("q", "n", "top")
