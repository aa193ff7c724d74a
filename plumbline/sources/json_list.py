"""A JSON list of records of any size, read by many tasks.

A parser needs the start of the file, a task has a stretch from its middle. So the file is
read as text that ends at each closing brace, which Spark splits by bytes, and every
stretch tells what it would do to a parser: whether it flips "inside a string", which
does not depend on where it starts, and, with that known from a running sum over all
stretches before, how it moves the depth. A second running sum gives every stretch its
depth, and records are the stretches between two returns to the depth of the list.
Sums run inside the splits, with one row per split carried across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.sequences import running_sum
from plumbline.plans.lookup import lookup_join, materialize, scratch_path

ESCAPE = r"\\(?s:.)"
STRING = r'"[^"]*"'
LIST_NAME = "records"
BLANKS = " \t\n\x0b\f\r,"
TASK_BYTES = 16 << 20  # of splits, where these are smaller


class ListError(ValueError):
    """A file that is no list of records."""


def record_texts(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, number, record): the text of each record, numbered from 0 per file.

    A file is a list of objects, or an object whose member ``records`` is one; other
    members may stand around it. ``split_bytes`` is the size of a split. Raises on
    anything else: a list that does not end, values in it that are no objects.
    """
    return _records(_shaped(_stretches(spark, path, split_bytes)))


def _stretches(spark: SparkSession, path: str, split_bytes: int | None) -> DataFrame:
    """Texts up to each closing brace, stored: file, split, id (rising in a split), text,
    bare (without escapes), quotes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        raw = spark.read.option("lineSep", "}").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
        # A task takes many small splits, but every core has some.
        splits = raw.rdd.getNumPartitions()
        tasks = max(-(-splits * (split_bytes or TASK_BYTES) // TASK_BYTES),
                    min(splits, 4 * spark.sparkContext.defaultParallelism), 1)
        bare = F.when(F.contains("text", F.lit("\\")), F.regexp_replace("text", ESCAPE, "")).otherwise(F.col("text"))
        held = scratch_path(spark, "stretches")
        raw.coalesce(tasks).withColumn("bare", bare).withColumn("quotes", _many("bare", '"')).write.parquet(held)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.parquet(held)


def _many(name: str, signs: str) -> Column:
    """How often a column has one of the signs."""
    return (F.length(name) - F.length(F.translate(name, signs, ""))).cast("bigint")


def _upto(name: str) -> Column:
    """Running sum inside a split."""
    return F.sum(name).over(Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))


def _before(totals: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(file, split, *sums): of columns of one row per split, the sums over all splits before."""
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(totals.select("file", "split", *[
        F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()]))


def _shaped(found: DataFrame) -> DataFrame:
    """Stretches in order: file, split, place, text, ended, closed, shape, step, depth, base.

    The text goes through one shuffle; what splits carry across comes from stored columns."""
    spark = found.sparkSession
    totals = found.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("quotes") % 2).alias("odd"), F.max("id").alias("end"))
    before = _before(totals, {"rows_before": "rows", "odd_before": "odd"})
    # Splits follow each other by bytes; inside one, ids do.
    last = materialize(totals.groupBy("file").agg(F.max(F.struct("split", F.col("end").alias("id"))).alias("last")))
    flips = found.withColumns({"one": F.lit(1).cast("bigint"), "flip": F.col("quotes") % 2}).withColumns({
        "place": _upto("one"), "after": _upto("flip")})
    known = lookup_join(lookup_join(flips, before, ["file", "split"]), last, ["file"])
    inside = known.select(
        "file", "split", "id", "text", "bare", (F.col("place") + F.col("rows_before") - 1).alias("place"),
        ((F.col("after") + F.col("odd_before")) % 2 == 1).alias("open"), (F.col("flip") == 1).alias("flip"),
        (F.struct("split", "id") != F.col("last")).alias("ended"))
    # What stands in strings goes; a stretch that starts inside one gets the quote it lacks,
    # as does one that ends inside.
    whole = inside.withColumn("bare", F.concat(
        F.when(F.col("open") != F.col("flip"), F.lit('"')).otherwise(F.lit("")), F.col("bare"),
        F.when(F.col("open"), F.lit('"')).otherwise(F.lit(""))))
    named = whole.withColumn("bare", F.when(
        F.contains("bare", F.lit(f'"{LIST_NAME}"')),
        F.regexp_replace("bare", rf'"{LIST_NAME}"\s*:\s*\[', "R[")).otherwise(F.col("bare")))
    shape = F.translate(F.regexp_replace("bare", STRING, "v"), BLANKS + ":\ufeff", "")
    # A name before a stretch's first brace may have begun in the stretch before; it never does,
    # since strings that hold a brace are none of the names looked for.
    closed = F.col("ended") & ~F.col("open")
    shaped = named.select("file", "split", "id", "place", "text", "ended", closed.alias("closed"), F.concat(
        shape, F.when(closed, F.lit("}")).otherwise(F.lit(""))).alias("shape"))
    held = scratch_path(spark, "shaped_stretches")
    (shaped.withColumn("step", _many("shape", "[{") - _many("shape", "]}"))
     .withColumn("deep", _upto("step")).write.parquet(held))
    stored = spark.read.parquet(held)
    above = _before(stored.groupBy("file", "split").agg(F.sum("step").alias("total")), {"deep_before": "total"})
    first = materialize(stored.where("place = 0").select(
        "file", F.when(F.substring("shape", 1, 1) == "[", 1).otherwise(2).alias("base")))
    return lookup_join(lookup_join(stored, above, ["file", "split"]), first, ["file"]).withColumn(
        "depth", F.col("deep") + F.col("deep_before"))


def _walk(on: bool):
    """What a stretch does to the list of records if it starts inside it (``on``) or not:
    (depth, on, opened, shut, odd); ``odd`` tells of a value in the list that is no object."""
    base = F.col("base")
    at = F.col("depth") - F.col("step")
    marks = F.regexp_extract_all("shape", F.lit(r"R?\[|[{\]}]|[^\[\]{}R]+"), F.lit(0))
    start = F.struct(at.alias("d"), F.lit(on).alias("on"), F.lit(False).alias("opened"), F.lit(False).alias("shut"),
                     F.lit(False).alias("odd"))

    def step(s, m):
        opens = (s["d"] == base - 1) & F.when(base == 1, m == "[").otherwise(m == "R[")
        shuts = s["on"] & (m == "]") & (s["d"] == base)
        odd = s["on"] & (s["d"] == base) & ~m.isin("{", "]")
        depth = s["d"] + F.when(F.substring(m, -1, 1).isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("d"), ((s["on"] | opens) & ~shuts).alias("on"), (s["opened"] | opens).alias("opened"),
                        (s["shut"] | shuts).alias("shut"), (s["odd"] | odd).alias("odd"))

    # Most stretches have one record or a part of it and no lists: they move nothing else.
    opening = F.startswith("shape", F.lit("{")).cast("int")
    quiet = F.struct(F.col("depth").alias("d"), F.lit(on).alias("on"), F.lit(False).alias("opened"), F.lit(False).alias("shut"),
                     (F.lit(on) & (at + opening == base) & (F.length("shape") > opening)).alias("odd"))
    return F.when(F.col("shape").rlike(r"^\{?[^\[\]{}R]*\}?\z"), quiet).otherwise(F.aggregate(marks, start, step))


def _records(deep: DataFrame) -> DataFrame:
    spark = deep.sparkSession
    held = scratch_path(spark, "record_stretches")
    (deep.withColumns({"off": _walk(False), "on": _walk(True)}).select(
        "file", "split", "place", "text", "closed", "ended", "base", "depth", F.col("off.opened").alias("opened"),
        *[F.col(f"{k}.{n}").alias(f"{n}_{k}") for k in ("off", "on") for n in ("shut", "odd", "on")]).write.parquet(held))
    found = spark.read.parquet(held)
    span = materialize(found.groupBy("file").agg(
        F.min(F.when(F.col("opened"), F.col("place"))).alias("from_"), F.max_by("depth", "place").alias("end_depth")))
    known = lookup_join(found, span, ["file"]).where("place >= from_").select("*", *[
        F.when(F.col("place") == F.col("from_"), F.col(f"{n}_off")).otherwise(F.col(f"{n}_on")).alias(n)
        for n in ("shut", "odd", "on")])
    ends = known.where("shut").groupBy("file").agg(F.min("place").alias("to"))
    span = materialize(span.join(ends, "file", "left"))
    wrong = span.where("from_ is null or to is null or end_depth > 1").select("file").limit(1).collect()
    if wrong:
        raise ListError(f"{wrong[0].file} is no list of records")
    inside = lookup_join(known.drop("from_", "end_depth"), span.select("file", "to"), ["file"]).where("place <= to")
    if inside.where("odd").limit(1).count():
        raise ListError("the list holds values that are no records")
    closes = (F.col("closed") & (F.col("depth") == F.col("base")) & F.col("on")).cast("bigint")
    numbered = running_sum(inside.withColumn("closes", closes), ["file"], "split", ["place"], F.col("closes"), "upto")
    text = F.concat("text", F.when(F.col("ended"), F.lit("}")).otherwise(F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("place", text.alias("text"))))
    whole = numbered.groupBy("file", (F.col("upto") - F.col("closes")).alias("number")).agg(
        F.max("closes").alias("closes"), F.first("base").alias("base"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("record")).where("closes = 1")
    # The first record has the opening of the list before it, the others a comma.
    bare = F.when(F.col("number") > 0, F.ltrim("record", F.lit(BLANKS))).when(
        F.col("base") == 1, F.regexp_replace("record", r"^[\s\x{FEFF}]*\[\s*", "")).otherwise(
        F.regexp_replace("record", rf'^(?s:.*?"{LIST_NAME}"\s*:)\s*\[\s*', ""))
    return whole.select("file", "number", bare.alias("record"))
