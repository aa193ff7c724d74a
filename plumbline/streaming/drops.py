"""Survey files dropped into a folder, checked as they arrive.

A stream of files, not of rows: the SHA-256 of every new file is computed as a task reads
it, and the state of the stream keeps the digests seen, so an extract that comes again
under another name, also after a restart, is taken once. Files that are new are cleaned
with a fixed schema, checked by the row-local rules and appended; cells that do not parse
go to a table of their own. Statistics, detectors, forest and fusion need a whole batch
as their baseline and stay batch jobs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.values import clean_cell, is_numeric, stripped_number
from plumbline.operators.rules import Rule, checked, evaluate_rules
from plumbline.plans.workers import ship
from plumbline.sources.digests import digest, opened

ship(__name__)
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def clean_with_schema(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text cells to the declared types; cells that do not parse become null."""
    rest = [c for c in raw.columns if c not in schema.names]
    # One step after the other, as a step that names a cell twice would do the one before twice.
    text = raw.select(*[clean_cell(F.col(f.name)).alias(f.name) for f in schema.fields], *rest)
    return text.select(*[_parsed(f, F.col(f.name)).alias(f.name) for f in schema.fields], *rest)


def _parsed(f: T.StructField, text: Column) -> Column:
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return stripped_number(text)
    if not is_numeric(f.dataType):
        return text
    number = stripped_number(text)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def rejected_cells(raw: DataFrame, schema: T.StructType, keep: list[str]) -> DataFrame:
    """(*keep, column, raw_text) of every cell that holds something its type cannot: text in a
    number, a fraction or too much in a whole number."""
    numbers = [(i, f) for i, f in enumerate(schema.fields) if is_numeric(f.dataType)]
    if not numbers:
        return raw.select(*keep, F.lit("").alias("column"), F.lit("").alias("raw_text")).where(F.lit(False))
    text = raw.select(*keep, *[c for i, f in numbers for c in (
        F.col(f.name).alias(f"_raw{i}"), clean_cell(F.col(f.name)).alias(f"_text{i}"))])
    cells = [F.when(F.col(f"_text{i}").isNotNull() & _parsed(f, F.col(f"_text{i}")).isNull(), F.struct(
        F.lit(f.name).alias("column"), F.col(f"_raw{i}").alias("raw_text"))) for i, f in numbers]
    bad = text.select(*keep, F.array_compact(F.array(*cells)).alias("_bad"))
    return bad.where(F.size("_bad") > 0).select(*keep, F.explode("_bad").alias("c")).select(
        *keep, "c.column", "c.raw_text")


def text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def watch_csv(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    rules: Iterable[Rule] | None = None,
    references: dict[str, list[str]] | None = None,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Process every new file present, then stop; run again for later drops.

    Records go to ``out``/records, violations to ``out``/violations, and cells that do not
    parse to ``out``/rejects (source_file, column, raw_text). All are written under the
    micro-batch's number, so a replayed one replaces itself. Of files with equal bytes the
    first in the order of arrival, then of path, is read; ``checkpoint`` holds what was seen.
    """
    chosen = checked(rules)
    stream = (
        spark.readStream.format("binaryFile").schema(FILES)
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
        .select("path").mapInArrow(_hashed, "path string, input_hash string")
        .dropDuplicates(["input_hash"])
    )

    def save(batch: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in batch.select("path").collect())  # at most files_per_trigger
        if not paths:
            return
        raw = (spark.read.schema(text_schema(schema)).option("header", True).csv(paths)
               .withColumn("source_file", F.input_file_name()))

        def write(name: str, df: DataFrame) -> DataFrame:
            path = f"{out}/{name}/drop={number}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        # Rules read what was written: each names its cells several times, and over the raw
        # text every one of these would clean and parse its cell again.
        records = write("records", clean_with_schema(raw, schema))
        write("violations", evaluate_rules(records, chosen, references, keep=["source_file"]).violations)
        write("rejects", rejected_cells(raw, schema, ["source_file"]))

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each file, streamed: no content is held."""
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            with opened(path) as file:
                out.append(digest(file, file.size()))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "input_hash"])
