"""Raw inputs: CSV and JSON survey extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import CSV_NULL_TOKENS
from plumbline.operators.standardize import SchemaOptions, Standardized, standardize
from plumbline.plans.lookup import scratch_path
from plumbline.sources.digests import PAGE_BYTES, file_digests
from plumbline.sources.json_list import ListError, record_texts


class IngestError(ValueError):
    """An input nobody can use."""


def _known_null(c: str) -> Column:
    cell = F.col(f"`{c}`")
    return F.when(~cell.isin(*CSV_NULL_TOKENS), cell).alias(c)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text. A byte-order mark is dropped."""
    raw = (
        spark.read.option("header", True).option("encoding", "UTF-8")
        .option("escape", '"').option("mode", "FAILFAST").csv(path)
    )
    if not raw.columns:
        raise IngestError("CSV file is empty")
    if raw.isEmpty():
        raise IngestError("CSV file has no data rows")
    return raw.select(*[_known_null(c) for c in raw.columns])


def read_json_records(spark: SparkSession, path: str, lines: bool = False,
                      split_bytes: int | None = None) -> DataFrame:
    """A list of records, or an object with a ``records`` list; cells as text.

    A list is cut into splits of ``split_bytes`` (Spark's own size if not given) and read by
    many tasks; nested values come as their JSON text. With ``lines`` each line is a record.
    """
    if lines:
        raw = spark.read.option("primitivesAsString", True).json(path)
        if raw.columns in ([], ["_corrupt_record"]):
            raise IngestError("unsupported record structure")
    else:
        try:
            held = scratch_path(spark, "records")
            record_texts(spark, path, split_bytes).select("record").write.parquet(held)
            records = spark.read.parquet(held)
        except ListError as error:
            raise IngestError(f"unsupported record structure: {error}") from error
        names = sorted(r[0] for r in records.select(F.explode(F.json_object_keys("record"))).distinct().collect())
        if not names and not records.isEmpty():
            raise IngestError("unsupported record structure")
        kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = records.select(F.from_json("record", kind, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    if raw.isEmpty():
        raise IngestError("the extract has no records")
    return raw


def ingest_csv(spark: SparkSession, path: str, options: SchemaOptions = SchemaOptions()
               ) -> Standardized:
    return standardize(read_csv(spark, path), options)


def ingest_json(spark: SparkSession, path: str, options: SchemaOptions = SchemaOptions(),
                lines: bool = False, split_bytes: int | None = None) -> Standardized:
    return standardize(read_json_records(spark, path, lines, split_bytes), options)


def content_hashes(spark: SparkSession, path: str, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(path, input_hash): digest of each file's bytes, read page by page by the tasks. It is
    the plain SHA-256 for files of one page; see ``digests``."""
    return file_digests(spark, path, page_bytes).select("path", "input_hash")


def new_files(spark: SparkSession, path: str, batches: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(input_hash, path) of files whose content no completed batch holds; equal files count once."""
    done = batches.where(F.col("status").isin("COMPLETED", "PROFILED", "PARTIAL")).select(
        "input_hash")
    found = content_hashes(spark, path, page_bytes).groupBy("input_hash").agg(F.min("path").alias("path"))
    return found.join(done, "input_hash", "left_anti")
