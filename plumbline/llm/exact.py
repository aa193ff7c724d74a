"""Exact duplicates by an extendible-hash index, with DataFrame functions only.

Every row is posted under a 64-bit hash of its text, A-Z lower-cased. The leading bits
of the hash are the slots of a directory. As in an extendible hash table the directory
is doubled (one more bit) as long as a bucket holds more text than ``capacity``, and
only overfull buckets are split: a bucket is the range of hashes that share as many bits
as it needed. Texts are dealt to the owner of their bucket, which groups them by hash
and by their bytes: different texts of one hash are a chain of classes. The posts,
written to the shared folder, then look their class up.

A hash with more than HOT_SHARE of the rows is spread over salts; each salt leaves one
row per text, so that copies without number never meet in one task.
"""

from __future__ import annotations

from math import ceil, log2
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_SALTS, HOT_SHARE, hot_join, need, written

BUCKET_BYTES = 1 << 20
# 2 ** MAX_DEPTH slots at most: the directory that is broadcast stays below 32 MB.
MAX_DEPTH = 19


def folded(text: Column) -> Column:
    """The text by which rows are equal: A-Z lower-cased and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_BYTES, key: str = "xxhash64(t)") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, chain.

    Texts are equal when they are after lower-casing A-Z; a null text is an empty one,
    and all of those are equal. ``keep_id`` is the largest doc_id of the group,
    ``group_size`` its rows, repeated rows counted; rows of one id and text are all kept
    or all dropped. A row without doc_id is kept only where no row of its group has one
    (keep_id is null then). ``chain`` numbers the different texts of one hash, 0 nearly
    always. An empty table has no rows; columns other than doc_id and text take no part.

    ``key`` is the hash of the folded text ``t``; tests of chains use a poor one.
    """
    rows = need(docs, "doc_id", "text").select("doc_id", folded(F.col("text")).alias("t")).withColumn("h", F.expr(key))
    posts = written(rows.select("doc_id", "h", F.sha2("t", 256).alias("text_sha256"),
                                F.octet_length("t").alias("bytes")), "posts")
    keys = written(posts.groupBy("h").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "keys")
    size = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                    F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    hot = keys.where(F.col("n") > max(1, HOT_SHARE * size.rows)).select("h", F.lit(True).alias("hot"))
    depth = min(MAX_DEPTH, 4 + max(0, ceil(log2(max(1, size.bytes / capacity)))))
    dealt = (rows.withColumn("slot", slot(depth)).join(F.broadcast(directory(keys, depth, capacity)), "slot")
             .join(F.broadcast(hot), "h", "left")
             .withColumn("salt", F.when(F.col("hot"), 1 + F.pmod(
                 F.xxhash64("doc_id", F.spark_partition_id()), F.lit(HOT_SALTS)).cast("int")).otherwise(0))
             .repartition("bucket", "salt"))
    texts = dealt.groupBy("bucket", "salt", "h", "t").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    texts = written(texts.select(
        "bucket", "salt", "h", F.sha2("t", 256).alias("text_sha256"), "n", "keep_id",
        F.when(F.col("salt") > 0, F.col("t")).alias("t")), "texts")
    met = (texts.where("salt > 0").groupBy("h", "t", "text_sha256")
           .agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id")).drop("t"))
    classes = texts.where("salt = 0").select(*met.columns).unionByName(met)
    place = F.row_number().over(W.partitionBy("h").orderBy("text_sha256")) - 1
    classes = written(classes.withColumn("chain", place).drop("h").withColumnRenamed("n", "group_size"), "classes")
    found = hot_join(posts, classes, "text_sha256", "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256", "chain")


def slot(depth: int) -> Column:
    """The leading ``depth`` bits of the hash."""
    return F.shiftrightunsigned(F.col("h"), 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, depth: int, capacity: int) -> DataFrame:
    """(slot, bucket, bits): the bucket of each used slot, named by its first slot, and the
    bits its hashes share: the fewest with which it holds at most ``capacity`` bytes, or
    ``depth``."""
    slots = keys.groupBy(slot(depth).alias("slot")).agg(F.sum("bytes").alias("bytes"))
    levels = slots.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("start", F.expr(f"shiftleft(shiftright(slot, {depth} - bits), {depth} - bits)"))
    held = F.sum("bytes").over(W.partitionBy("bits", "start"))
    fits = levels.withColumn("held", held).where((F.col("held") <= capacity) | (F.col("bits") == depth))
    return fits.groupBy("slot").agg(F.min_by("start", "bits").alias("bucket"), F.min("bits").alias("bits"))
