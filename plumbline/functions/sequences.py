"""Neighbours and running sums along long sequences.

A plain window keeps one key in one task. Here a key's sequence is cut into
blocks; windows run inside a block, and one summary row per block carries the
rest across, so a key of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.lookup import null_safe_join


def neighbours(
    df: DataFrame, keys: list[str], block: str, order: list[str],
    columns: dict[str, str], step: int,
) -> DataFrame:
    """Add ``columns`` (new name -> source) of the row before (-1) or after (+1).

    ``block`` must not decrease along ``order`` within a key.
    """
    if step not in (-1, 1):
        raise ValueError("step is -1 or 1")
    shift = F.lag if step < 0 else F.lead
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(block)
    payload = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    edge = F.struct(*[F.col(o) for o in order], payload.alias("_pay"))
    edges = df.groupBy(*keys, block).agg((F.max(edge) if step < 0 else F.min(edge)).alias("_e"))
    edges = edges.select(*keys, block, shift(F.col("_e._pay")).over(outer).alias("_far"))
    joined = df.withColumn("_near", shift(payload).over(inner))
    joined = null_safe_join(joined, edges, [*keys, block])
    at_edge = F.row_number().over(inner) == 1 if step < 0 else None
    if at_edge is None:
        backward = Window.partitionBy(*keys, block).orderBy(*[F.desc(o) for o in order])
        at_edge = F.row_number().over(backward) == 1
    marked = joined.withColumn("_edge", at_edge)
    picked = F.when(F.col("_edge"), F.col("_far")).otherwise(F.col("_near"))
    return marked.select(
        *df.columns, *[picked.getField(new).alias(new) for new in columns])


def running_sum(
    df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """Add the inclusive running sum of ``value`` as ``name``."""
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_t")).select(
        *keys, block, F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_before"))
    summed = df.withColumn("_inner", F.sum(value).over(inner))
    return null_safe_join(summed, totals, [*keys, block]).select(
        *df.columns, (F.col("_inner") + F.col("_before")).alias(name))
