"""Exact order statistics that never sort one column in one task.

``exact_quantiles`` interpolates linearly between neighbours. Sketches narrow a
bracket around every wanted rank until few values are left in it, and only those are
ordered.

``rank_table`` gives every distinct value its first and last position. Values
are counted first (so copies shrink before the shuffle), dealt to as many ranges as
they need, and ordered inside each range; sums of the ranges are carried across.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.values import finite
from plumbline.plans.lookup import materialize

INSIDE_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
RANGE_ROWS = 100_000


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    inside_rows: int = INSIDE_ROWS,
) -> dict[str, list[float] | None]:
    """{name: [quantile per prob]}; None for a column without values.

    A bracket per wanted rank starts as the whole column. Each round is one pass: a
    sketch of what lies inside gives narrower brackets, and counts tell which of them
    hold their rank. A bracket whose sketch missed keeps its bounds with a wider
    margin. When at most ``inside_rows`` values (or only copies of one) are left in
    each, those are counted and ordered.
    """
    if not columns:
        return {}
    names = list(columns)
    values = df.select(*[finite(columns[c].cast("double")).alias(f"v{i}")
                         for i, c in enumerate(names)])
    counts = list(values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first())
    brackets = [_Bracket(i, j, p * (counts[i] - 1), count=counts[i])
                for i in range(len(names)) if counts[i] for j, p in enumerate(probs)]
    while wide := [b for b in brackets if b.count > inside_rows and b.low < b.high and not b.done]:
        _narrow(values, wide)
    found = _ranked_values(values, brackets)
    result: dict[str, list[float] | None] = {
        c: ([0.0] * len(probs) if counts[i] else None) for i, c in enumerate(names)
    }
    for k, b in enumerate(brackets):
        near, far = math.floor(b.position), math.ceil(b.position)
        low, high = found[k, near - b.below], found[k, far - b.below]
        result[names[b.column]][b.prob] = (
            low if near == far else (far - b.position) * low + (b.position - near) * high)
    return result


@dataclass
class _Bracket:
    """Values of a column between two bounds, in which a wanted rank lies."""

    column: int
    prob: int
    position: float
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    count: int = 0
    margin: float = 2.0 / SKETCH_ACCURACY
    done: bool = False

    def holds(self, low: float, high: float) -> Column:
        v = F.col(f"v{self.column}")
        return (v >= F.lit(float(low))) & (v <= F.lit(float(high)))


def _narrow(values: DataFrame, brackets: list[_Bracket]) -> None:
    # Brackets of the same values, as all of a column are at first, share a sketch.
    shared: dict[tuple, list[int]] = {}
    for k, b in enumerate(brackets):
        shared.setdefault((b.column, b.low, b.high), []).append(k)
    sketches = values.agg(*[
        F.percentile_approx(F.when(brackets[same[0]].holds(low, high), F.col(f"v{column}")), [
            min(1.0, max(0.0, (b.position - b.below) / max(b.count - 1, 1) + d))
            for b in (brackets[k] for k in same) for d in (-b.margin, b.margin)],
            SKETCH_ACCURACY).alias(f"s{i}")
        for i, ((column, low, high), same) in enumerate(shared.items())]).first()
    bounds: list[tuple[float, float]] = [(-math.inf, math.inf)] * len(brackets)
    for sketch, same in zip(sketches, shared.values(), strict=True):
        for j, k in enumerate(same):
            bounds[k] = (sketch[2 * j], sketch[2 * j + 1])
    seen = values.agg(
        *[F.count_if(F.col(f"v{b.column}") < F.lit(float(low))).alias(f"b{k}")
          for k, (b, (low, _)) in enumerate(zip(brackets, bounds, strict=True))],
        *[F.count_if(b.holds(low, high)).alias(f"c{k}")
          for k, (b, (low, high)) in enumerate(zip(brackets, bounds, strict=True))]).first()
    for k, (b, (low, high)) in enumerate(zip(brackets, bounds, strict=True)):
        below, count = seen[f"b{k}"], seen[f"c{k}"]
        holds = below <= math.floor(b.position) and math.ceil(b.position) < below + count
        if holds:
            # Where less than half goes, copies of few values fill the bracket.
            b.done = 2 * count > b.count
            b.low, b.high, b.below, b.count = low, high, below, count
        else:
            b.done = b.margin >= 1.0
            b.margin *= 4


def _ranked_values(values: DataFrame, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """{(bracket, rank inside it): value} for the two ranks around each position."""
    if not brackets:
        return {}
    inside = (
        values.select(F.explode(F.array(*[
            F.when(b.holds(b.low, b.high),
                   F.struct(F.lit(k).alias("k"), F.col(f"v{b.column}").alias("value")))
            for k, b in enumerate(brackets)])).alias("hit"))
        .where("hit is not null").groupBy("hit.k", "hit.value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    spot = Window.partitionBy("k").orderBy("value")
    last = F.sum("copies").over(spot.rowsBetween(Window.unboundedPreceding, 0))
    ranks = [(k, rank - b.below) for k, b in enumerate(brackets)
             for rank in sorted({math.floor(b.position), math.ceil(b.position)})]
    wanted = reduce(lambda acc, kr: acc | (
        (F.col("k") == kr[0]) & (F.col("first") <= kr[1]) & (F.lit(kr[1]) < F.col("last"))),
        ranks, F.lit(False))
    rows = (inside.withColumn("last", last).withColumn("first", F.col("last") - F.col("copies"))
            .where(wanted).collect())  # at most two rows per column and probability
    return {(k, rank): next(r["value"] for r in rows if r["k"] == k and r["first"] <= rank < r["last"])
            for k, rank in ranks}


def rank_table(
    values: DataFrame, key: str, value: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(key, value, copies, first_rank, last_rank, total), ranks 1-based.

    Distinct values are dealt to ranges of about ``range_rows`` by (key, value), so their
    number follows the table; running sums stay inside a range, and the totals of the
    ranges, one row per range and key, are summed up and added.
    """
    counts = materialize(
        values.where(F.col(value).isNotNull())
        .groupBy(key, value)
        .agg(F.count(F.lit(1)).alias("copies")))
    ranges = max(1, -(-counts.count() // range_rows))
    placed = materialize(counts.repartitionByRange(ranges, key, value).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(key, "_range").agg(F.sum("copies").alias("_in_range"))
    spread = Window.partitionBy(key).orderBy("_range")
    offsets = sums.select(
        key, "_range", (F.sum("_in_range").over(spread) - F.col("_in_range")).alias("_before"),
        F.sum("_in_range").over(Window.partitionBy(key)).alias("total"))
    inner = Window.partitionBy(key, "_range").orderBy(value)
    return (
        placed.withColumn("_upto", F.sum("copies").over(inner))
        .join(offsets, [key, "_range"])
        .withColumn("last_rank", F.col("_before") + F.col("_upto"))
        .withColumn("first_rank", F.col("last_rank") - F.col("copies") + 1)
        .select(key, value, "copies", "first_rank", "last_rank", "total")
    )
