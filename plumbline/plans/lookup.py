"""Cutting lineage and joining facts to small tables without trusting luck.

``materialize`` writes a small derived table once through Spark's reliable
checkpoint, so that a lost executor never changes it and it is not computed
again. ``lookup_join`` broadcasts such a table only when its counted rows and bytes
are below limits. A larger table is joined by shuffle, in one pass over the facts:
keys known to hold more than ``HOT_SHARE`` of them (at most 1/HOT_SHARE such keys
exist) are broadcast, and their facts and those without a key are spread over
salts on which nothing joins. Where no row counts are known, every key is spread.
``maybe_in`` splits a table by a set of keys, whatever its size, without a shuffle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Tables of fewer rows than this are not measured in bytes.
SMALL_ROWS = 10_000
SALTS = 32
FREE_SALTS = 512
HOT_SHARE = 0.001


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str | None = None,
    rows: int | None = None,
    broadcast_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Left equi-join of ``facts`` with a materialised ``table`` unique on ``keys``.

    ``weight`` names the column of ``table`` that counts the facts per key and
    ``rows`` its counted size, when the caller has it.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    size = table.count() if rows is None else rows
    if size <= limit and (size <= SMALL_ROWS or _bytes(table) <= BROADCAST_BYTES):
        return facts.join(F.broadcast(table), keys, "left")
    if weight:
        total = table.agg(F.sum(weight)).first()[0] or 0
        values = [c for c in table.columns if c not in keys]
        cells = F.struct(*[F.col(f"`{c}`") for c in values])
        is_hot = F.col(weight) > F.lit(HOT_SHARE * total)
        hot = table.where(is_hot).select(*keys, cells.alias("_hot"))
        cold = table.where(~is_hot).select(*keys, F.lit(0).alias("_salt"), cells.alias("_cold"))
        marked = facts.join(F.broadcast(hot), keys, "left")
        free = F.col("_hot").isNotNull()
        for k in keys:
            free = free | F.col(f"`{k}`").isNull()
        marked = marked.withColumn("_salt", F.when(free, 1 + _salt(facts, FREE_SALTS)).otherwise(F.lit(0)))
        joined = marked.join(cold, [*keys, "_salt"], "left")
        found = F.coalesce("_hot", "_cold")
        return joined.select(*keys, *[F.col(f"`{c}`") for c in facts.columns if c not in keys],
                             *[found[c].alias(c) for c in values])
    salted = facts.withColumn("_salt", _salt(facts, salts))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def _salt(df: DataFrame, salts: int) -> Column:
    """A salt that follows the row, so that a task that runs again deals as before."""
    # Maps have no hash; the other cells tell rows apart.
    cells = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*cells), F.lit(salts)).cast("int")


def _bytes(table: DataFrame) -> int:
    """About the bytes of a table: its rows as JSON."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))
    return table.agg(F.coalesce(F.sum(F.octet_length(row)), F.lit(0))).first()[0]


BITMAP = 1 << 15  # bits of a bitmap that Spark builds
MOST_BITMAPS = 2048  # 8 MB at most are sent to every task


def marks(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(bitmaps of the hashed keys, their number), materialised; 16 bits to a key where
    MOST_BITMAPS allow it."""
    bits = 16 * keys.count()
    n = 1
    while n * BITMAP < bits and n < MOST_BITMAPS:
        n *= 2
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(n * BITMAP))
    return materialize(
        keys.where(F.col(f"`{key}`").isNotNull()).select(place.alias("_at"))
        .groupBy(F.expr(f"_at div {BITMAP}").alias("_block"))
        .agg(F.bitmap_construct_agg(F.expr(f"_at % {BITMAP}")).alias("_bits")).repartition(1)), n


def maybe_marked(df: DataFrame, held: tuple[DataFrame, int], key: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether ``key`` may be one of the marked keys. It is
    true for all of those, false for null, and true by chance for few others."""
    bitmaps, n = held
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(n * BITMAP))
    found = df.withColumn("_at", place).withColumn("_block", F.expr(f"_at div {BITMAP}")).join(
        F.broadcast(bitmaps), "_block", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.expr(f"cast(_at % {BITMAP} div 8 AS int) + 1"), F.lit(1))), 16, 10)
    hit = F.coalesce(F.getbit(byte.cast("int"), F.expr("cast(_at % 8 AS int)")) == 1, F.lit(False))
    return found.withColumn(name, hit & F.col(f"`{key}`").isNotNull()).drop("_block", "_at", "_bits")


def maybe_in(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be in ``keys``, the other rows); null is in none."""
    found = maybe_marked(df, marks(keys, key), key, "_maybe")
    return tuple(found.where(x).drop("_maybe") for x in (F.col("_maybe"), ~F.col("_maybe")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the keys come from ``left``."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def empty_frame(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows of the given shape; the optimizer drops it from any union."""
    return spark.range(1).where(F.lit(False)).select(*[
        F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl).fields
    ])
