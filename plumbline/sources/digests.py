"""Digests of files of any size by a hash tree.

A file is cut into pages that tasks read side by side; a page's digest is the SHA-256 of
its bytes. Up to FAN digests of one level make one of the next: the SHA-256 of a byte 1
and the digests in order. A file of one page has the plain SHA-256 of its bytes, so the
digest of a larger one depends on ``page_bytes`` and FAN, and two digests can be compared
only if they were made with the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.workers import ship

ship(__name__)
PAGE_BYTES = 4 << 20
FAN = 1024
# Pages that one task reads in a row, so that a file is opened once for all of them.
RUN = 16


def file_digests(spark: SparkSession, path: str, page_bytes: int = PAGE_BYTES, fan: int = FAN) -> DataFrame:
    """(path, length, input_hash) of every file; empty ones are left out, as by any Spark source.

    Contents are read by the tasks, page by page, and never held whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    pages = files.withColumn("page", F.explode(F.expr(
        f"sequence(0L, greatest(length - 1, 0L) div {page_bytes}L)")))
    dealt = pages.repartition("path", F.expr(f"page div {RUN}")).sortWithinPartitions("path", "page")
    level = dealt.mapInArrow(_reader(page_bytes), "path string, length bigint, page bigint, digest string")
    most = files.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    width = -(-max(most, 1) // page_bytes)
    while width > 1:
        parts = F.sort_array(F.collect_list(F.struct("page", "digest")))
        joined = F.array_join(F.transform(parts, lambda p: p["digest"]), "")
        # A file that has come down to one digest keeps it.
        level = (level.groupBy("path", "length", F.expr(f"page div {fan}").alias("page"))
                 .agg(parts.alias("parts"), joined.alias("joined"))
                 .withColumn("alone", F.expr(f"page = 0 AND size(parts) = 1"))
                 .select("path", "length", "page", F.when(F.col("alone"), F.col("joined")).otherwise(
                     F.sha2(F.unhex(F.concat(F.lit("01"), "joined")), 256)).alias("digest")))
        width = -(-width // fan)
    return level.select("path", "length", F.col("digest").alias("input_hash"))


def _reader(page_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for b in batches:
            out = []
            for path, page in zip(b.column("path").to_pylist(), b.column("page").to_pylist(), strict=True):
                if path != at:
                    if file:
                        file.close()
                    at, file = path, opened(path)
                file.seek(page * page_bytes)
                out.append(digest(file, page_bytes))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in ("path", "length", "page")), pa.array(out, pa.string())],
                ["path", "length", "page", "digest"])
        if file:
            file.close()

    return run


def digest(file, size: int, step: int = 1 << 20) -> str:
    """SHA-256 of the next ``size`` bytes, read in steps."""
    sha = hashlib.sha256()
    while size > 0 and (part := file.read(min(size, step))):
        sha.update(part)
        size -= len(part)
    return sha.hexdigest()


def opened(path: str):
    """A file of any store that pyarrow knows (local, HDFS, S3, GCS), by the path Spark gives."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@?=&+"))
    return system.open_input_file(inner)
