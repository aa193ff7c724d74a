"""Pieces the training-data operators share: stored steps, streamed groups,
skew-proof lookups, dense ranks and connected components.

A step that is read twice is written as Parquet in the shared folder, so a lost
executor repeats tasks and never changes what a later step reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.lookup import scratch_path
from plumbline.plans.workers import ship

ship(__name__)
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# A key with more than this share of the rows is hot; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
HOT_SALTS = 512


def arrow_batches(spark: SparkSession) -> SparkSession:
    """Small batches: rows are whole texts, and a worker holds one batch at a time."""
    for name, value in ARROW.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


# Shuffle files of a step go as soon as it is stored.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: later steps read what was stored."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once in the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# --- groups streamed through a sorted partition ------------------------------------

def map_groups(df: DataFrame, keys: list[str], order: list[Column | str],
               fn: Callable[[tuple, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``fn(key, rows)`` to each group of ``keys``; ``rows`` come in ``order``.

    Groups lie one after another in a sorted partition and one group is held at a
    time, so callers bound their groups. ``fn`` yields dicts of column lists.
    """
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _ddl(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            for lo, hi in _runs(columns, batch.num_rows):
                key = tuple(c[lo].as_py() for c in columns)
                if held and key != at:
                    yield from _emit(fn(at, pa.Table.from_batches(held)), out)
                    held = []
                at = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _emit(fn(at, pa.Table.from_batches(held)), out)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def _runs(columns: list[pa.Array], rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of equal keys."""
    change = np.zeros(rows, dtype=bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), rows]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _emit(parts: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield pa.RecordBatch.from_arrays(
            [_column(part[f.name], f.type) for f in schema], schema=schema)


def _column(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _ddl(schema: str) -> list:
    from pyspark.sql import types as T

    return T.StructType.fromDDL(schema).fields


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
            "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to each batch of rows."""
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _ddl(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _emit([fn(batch)], out)

    return df.mapInArrow(run, schema)


# --- joins and ranks -----------------------------------------------------------------

def hot_join(facts: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``facts`` with a stored ``table``, unique on ``key``; ``weight``
    is its column with the number of facts per key.

    A table of at most 1 / HOT_SHARE rows is broadcast. Of a larger one the keys above
    HOT_SHARE of the facts are (at most 1 / HOT_SHARE exist); their rows and rows
    without a key are spread over salts in the join of the rest, so ``facts`` is read
    once and no key meets in one task.
    """
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(weight), F.lit(0)).alias("facts")).first()
    if size.rows <= 1 / HOT_SHARE:
        return facts.join(F.broadcast(table), key, "left").select(
            *facts.columns, *[c for c in table.columns if c != key])
    values = [c for c in table.columns if c != key]
    hot = table.where(F.col(weight) > F.lit(HOT_SHARE * size.facts)).select(
        F.col(key), F.struct(*values).alias("_hot"))
    cold = table.where(F.col(weight) <= F.lit(HOT_SHARE * size.facts)).select(
        F.col(key).alias("_key"), F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    marked = facts.join(F.broadcast(hot), key, "left")
    free = F.col("_hot").isNotNull() | F.col(key).isNull()
    # Salts follow the row, not chance: a task that runs again deals as before.
    cells = [c for c in facts.columns if "map<" not in facts.schema[c].dataType.simpleString()]
    marked = marked.withColumns({
        "_key": F.when(~free, F.col(key)),
        "_salt": F.when(free, 1 + F.pmod(F.xxhash64(*cells), F.lit(HOT_SALTS)).cast("int"))
        .otherwise(F.lit(0))})
    joined = marked.join(cold, ["_key", "_salt"], "left")
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*facts.columns, *[both[c].alias(c) for c in values])


def ranked(df: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """``df`` stored in ``order`` with a dense position from 0.

    Rows are sorted by ranges; only the number of rows per range meets on the driver.
    """
    path = scratch_path(df.sparkSession, "ranked")
    with freed(df.sparkSession):
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    part = F.shiftright("_place", 33)
    counts = sorted(tuple(r) for r in held.groupBy(part.alias("p")).count().collect())
    starts, at = {}, 0
    for p, n in counts:
        starts[p] = at
        at += n
    base = held.sparkSession.createDataFrame(
        [(p, s) for p, s in starts.items()] or [(0, 0)], "_part bigint, _start bigint")
    return (held.withColumn("_part", part).join(F.broadcast(base), "_part")
            .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_start", "_place"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node can reach.

    Every node is merged into the smallest of its neighbours and itself; links are
    drawn anew between the merged nodes, and those inside one are dropped, so the links
    shrink from round to round until none is left. Rounds are stored; nothing but
    whether a link is left is collected.
    """
    low, high = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    links = written(edges.select(low, high).where("u <> v").distinct(), "links")
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    first = True
    while links.limit(1).count():
        both = links.union(links.select("v", "u"))
        into = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("label"), "n"), "merged")
        step = into.select(F.col("node").alias("at"), F.col("label").alias("to"))
        labels = into.drop("n") if first else written(
            labels.join(step, F.col("label") == F.col("at"), "left")
            .select("node", F.coalesce("to", "label").alias("label")), "labels")
        first = False
        drawn = links
        for end, to in (("u", "x"), ("v", "y")):
            drawn = hot_join(drawn, into.withColumnsRenamed({"node": end, "label": to}), end, "n").drop(end, "n")
        links = written(drawn.where("x <> y").select(
            F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
    return labels


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
