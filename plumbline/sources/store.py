"""Tables of a survey store: batches, records, evidence, profiles, results.

Everything lives under one root as Parquet, one folder per batch. Writing a batch
again replaces only its own folder.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import ROLE_CANDIDATES
from plumbline.functions.values import as_text, is_numeric
from plumbline.operators.roles import detect_roles, role_text
from plumbline.operators.standardize import Standardized

BATCHES = (
    "batch_id string, source string, survey_code string, status string, "
    "schema_version string, records bigint, column_count int, input_hash string, "
    "created_at timestamp, completed_at timestamp"
)
MANIFEST = (
    "batch_id string, position int, column string, type string, role string, nulls bigint, "
    "minimum double, maximum double"
)
USABLE = ("COMPLETED", "PROFILED")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # -- batches --

    def batches(self) -> DataFrame:
        """Newest entry per batch."""
        try:
            log = self.spark.read.schema(BATCHES).parquet(self.path("batches"))
        except AnalysisException:
            return self.spark.createDataFrame([], BATCHES)
        newest = F.max(F.struct(F.coalesce("completed_at", "created_at").alias("_at"),
                                *[c for c in log.columns]))
        return log.groupBy("batch_id").agg(newest.alias("_b")).select(
            *[F.col(f"_b.{c}").alias(c) for c in log.columns])

    def new_batch_id(self, source: str) -> str:
        """A name by time and source; its random part makes it unique, and
        ``write_batch`` refuses one that exists."""
        return f"BATCH_{datetime.now(UTC):%Y_%m_%d_%H%M%S}_{source}_{uuid.uuid4().hex[:12]}"

    def register(self, batch_id: str, source: str, result: Standardized, records: int,
                 status: str, input_hash: str | None = None, survey_code: str = "DEMO",
                 created_at: datetime | None = None) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        row = (batch_id, source, survey_code, status, result.schema_version, records,
               len(result.columns), input_hash, created_at or now,
               now if status != "PROCESSING" else None)
        (self.spark.createDataFrame([row], BATCHES).coalesce(1)
         .write.mode("append").parquet(self.path("batches")))

    def find_by_hash(self, input_hash: str) -> str | None:
        """Batch that already holds this content."""
        row = self.batches().where(
            (F.col("input_hash") == input_hash) & F.col("status").isin(*USABLE)
        ).orderBy(F.desc("created_at")).select("batch_id").first()
        return row["batch_id"] if row else None

    # -- records --

    def write_batch(self, result: Standardized, source: str, batch_id: str | None = None,
                    input_hash: str | None = None, survey_code: str = "DEMO") -> str:
        """Store a standardised batch. An existing batch is never overwritten."""
        batch_id = batch_id or self.new_batch_id(source)
        started = datetime.now(UTC).replace(tzinfo=None)
        self.register(batch_id, source, result, 0, "PROCESSING", input_hash, survey_code, started)
        target = f"{self.path('records')}/batch_id={batch_id}"
        try:
            result.frame.write.mode("errorifexists").parquet(target)
        except Exception:
            self.register(batch_id, source, result, 0, "FAILED", input_hash, survey_code, started)
            raise
        count = self.describe(batch_id)
        self.register(batch_id, source, result, count, "COMPLETED", input_hash, survey_code,
                      started)
        return batch_id

    def describe(self, batch_id: str) -> int:
        """Write the manifest of a stored batch, a row per column with the range of its numbers,
        in one pass; the number of its records."""
        df = self.read_batch(batch_id)
        roles = detect_roles(df)
        role = {name: r for r in ROLE_CANDIDATES if (name := roles.column(r))}
        numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
        found = df.agg(
            F.count(F.lit(1)).alias("records"),
            F.array(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]).alias("nulls"),
            *[f(F.col(f"`{c}`").cast("double")).alias(f"{n}_{i}") for i, c in enumerate(numbers)
              for n, f in (("lo", F.min), ("hi", F.max))]).first()
        at = {c: i for i, c in enumerate(numbers)}
        rows = [(batch_id, i, c, kind, role.get(c), found["nulls"][i],
                 *[found[f"{n}_{at[c]}"] if c in at else None for n in ("lo", "hi")])
                for i, (c, kind) in enumerate(df.dtypes)]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite")
         .parquet(self.batch_path("manifest", batch_id)))
        return found["records"]

    def manifest(self) -> DataFrame:
        """Columns of all stored batches: type, role, nulls and range."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(self.path("manifest"))
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def read_batch(self, batch_id: str) -> DataFrame:
        """One batch with its own columns and types."""
        return self.spark.read.parquet(f"{self.path('records')}/batch_id={batch_id}")

    def record_ids(self, batch_id: str) -> DataFrame:
        """Only the record id column is read."""
        df = self.read_batch(batch_id)
        return df.select(role_text(df, detect_roles(df), "record_id"))

    def prior_records(self, batch_id: str, features: list[str],
                      between: dict[str, tuple[float, float]] | None = None) -> DataFrame | None:
        """(batch_id, record_id, *features) of every earlier usable batch that has all
        ``features`` as numbers; None if there is none.

        The manifest tells which batches those are, so no file of another one is opened.
        ``between`` asks for records whose columns lie in closed ranges; batches whose own
        range does not meet them are not read. Batches of the same types are read at once.
        """
        between = between or {}
        usable = self.batches().where((F.col("batch_id") != batch_id) & F.col("status").isin(*USABLE))
        wanted = {*features, *between}
        known = self.manifest().where(F.col("column").isin(*wanted) | (F.col("role") == "record_id"))
        batches: dict[str, dict] = {}
        for r in known.join(usable.select("batch_id"), "batch_id").collect():  # rows of metadata
            batches.setdefault(r["batch_id"], {})[r["column"]] = r
        groups: dict[tuple, list[str]] = {}
        for name, columns in sorted(batches.items()):
            if not all(c in columns and columns[c]["type"].startswith(NUMBERS) for c in wanted):
                continue
            ranges = [(columns[c]["minimum"], columns[c]["maximum"], *between[c]) for c in between]
            if any(least is None or most < lo or least > hi for least, most, lo, hi in ranges):
                continue
            record = next((c for c, r in columns.items() if r["role"] == "record_id"), None)
            kinds = tuple(sorted((c, r["type"]) for c, r in columns.items()))
            groups.setdefault((record, kinds), []).append(name)
        parts = []
        for (record, kinds), names in groups.items():
            ddl = ", ".join(f"`{c}` {kind}" for c, kind in kinds) + ", batch_id string"
            df = (self.spark.read.schema(ddl).option("basePath", self.path("records"))
                  .parquet(*[f"{self.path('records')}/batch_id={n}" for n in names]))
            for c, (lo, hi) in between.items():
                df = df.where(F.col(f"`{c}`").between(lo, hi))
            record_id = (as_text(F.col(f"`{record}`"), df.schema[record].dataType) if record
                         else F.lit(None).cast("string"))
            parts.append(df.select("batch_id", record_id.alias("record_id"),
                                   *[F.col(f"`{f}`").cast("double").alias(f) for f in features]))
        return reduce(DataFrame.unionByName, parts) if parts else None

    # -- derived tables --

    def replace(self, table: str, batch_id: str, df: DataFrame, run_id: int = 1) -> None:
        """Write a derived table of one batch; what an earlier run wrote goes, also
        where this run has no row. An empty table keeps its columns."""
        (df.withColumns({"run_id": F.lit(run_id).cast("long"), "batch_id": F.lit(batch_id)})
         .write.mode("overwrite").parquet(self.batch_path(table, batch_id)))

    def batch_path(self, table: str, batch_id: str) -> str:
        return f"{self.path(table)}/part={quote(batch_id, safe='')}"

    def read(self, table: str, batch_id: str | None = None, run_id: int | None = None) -> DataFrame:
        """A derived table or ``records``: of all batches, one batch, or one run of it."""
        if table == "records":
            df = self.spark.read.parquet(self.path(table))
            df = df.withColumn("batch_id", F.col("batch_id").cast("string"))
            return df if batch_id is None else df.where(F.col("batch_id") == batch_id)
        path = self.path(table) if batch_id is None else self.batch_path(table, batch_id)
        df = self.spark.read.parquet(path)
        df = df.drop("part") if "part" in df.columns and batch_id is None else df
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    def read_if_present(self, table: str) -> DataFrame | None:
        try:
            return self.read(table)
        except AnalysisException:
            return None


def write_report(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Report rows as CSV parts; the key=value preamble as a table beside them."""
    flat = df.select(*[
        F.concat_ws("|", c).alias(c) if kind.startswith("array") else F.col(c)
        for c, kind in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    lines = [(f"# {k}={v}",) for k, v in metadata.items()]
    (df.sparkSession.createDataFrame(lines, "value string").coalesce(1)
     .write.mode("overwrite").text(f"{path}/preamble"))
