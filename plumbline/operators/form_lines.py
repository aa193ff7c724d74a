"""Recognised text lines of survey forms -> records.

Input: (doc_id, line_no, page, text, score). A record starts at every line
labelled with a record id; a label's value is on its line or on the next line
that is not a bare separator.

A document whose line numbers lie in one block is read in one task: its lines are
shuffled once, by document, and everything else happens where they lie. Longer
documents are cut into blocks whose edges are carried across.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.config import FORM_LABELS, KNOWN_GENDERS, KNOWN_MARITAL
from plumbline.functions.scoring import pick, score_band
from plumbline.functions.sequences import neighbours, running_sum
from plumbline.functions.values import NUMBER, strip
from plumbline.plans.lookup import BROADCAST_ROWS, lookup_join, materialize, null_safe_join

LINES_PER_BLOCK = 10_000
FIELDS = [name for name, _ in FORM_LABELS]
# Field by field; inside a field the longest alias first.
_ALIASES = [a for _, aliases in FORM_LABELS for a in sorted(aliases, key=len, reverse=True)]
LABEL = r"(?i)^(" + "|".join(re.escape(a).replace(r"\ ", " ") for a in _ALIASES) \
    + r")\s*[:\x{FF1A}]?\s*(.*)$"
SEPARATOR = r"^[:\x{FF1A}\-\x{2013}\x{2014}]\s*$"
COLON_EDGES = r"^[:\x{FF1A}]\s*|[:\x{FF1A}]\s*$"


def match_label(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_text`` stripped, ``field`` (or null) and ``inline``, the text after
    the label. Each expression stands once, in a step of its own: they are dear."""
    matched = lines.withColumn("_text", strip(F.col("text"))).withColumns({
        "_alias": F.lower(F.regexp_extract("_text", LABEL, 1)),
        "_rest": F.regexp_extract("_text", LABEL, 2)})
    field = pick(F.col("_alias"), {a: name for name, aliases in FORM_LABELS for a in aliases})
    return matched.withColumns({"field": field, "inline": strip(F.col("_rest"))})


def _no_colons(value: Column) -> Column:
    return strip(F.regexp_replace(value, COLON_EDGES, ""))


def _span() -> Column:
    return F.floor(F.col("line_no") / LINES_PER_BLOCK)


def form_fields(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, block, page, field, value, score), one row per field of a record.

    ``whole``: every document's lines are to lie in one task.
    """
    if whole:
        lines = lines.select("doc_id", "line_no", "page", "text", "score").repartition("doc_id")
    marked = match_label(lines).select(
        "doc_id", "line_no", "page", "text", F.col("score").cast("double").alias("score"),
        "field", _no_colons(F.col("inline")).alias("inline"),
        F.col("_text").rlike(SEPARATOR).alias("bare"), _span().alias("_span"),
    )

    def along(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        if not whole:
            return running_sum(df, ["doc_id"], "_span", [order], value, name)
        upto = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(upto))

    # A separator belongs to the text line before it.
    numbered = along(marked, "line_no", (~F.col("bare")).cast("long"), "_line")
    first = F.struct("line_no", "page", "text", "score", "field", "inline")
    texts = numbered.where(F.col("_line") > 0).groupBy("doc_id", "_line").agg(
        F.min(F.when(~F.col("bare"), first)).alias("_l"),
        F.sum(F.when(F.col("bare"), F.col("score"))).alias("_sep_sum"),
        F.count(F.when(F.col("bare"), F.col("score"))).alias("_sep_n"),
    ).select("doc_id", "_line", "_l.*", "_sep_sum", "_sep_n",
             F.floor(F.col("_line") / LINES_PER_BLOCK).alias("_span"))
    after = {"_next": "text", "_next_field": "field", "_next_score": "score"}
    if whole:
        following = Window.partitionBy("doc_id").orderBy("_line")
        ahead = texts.withColumns({new: F.lead(src).over(following) for new, src in after.items()})
    else:
        ahead = neighbours(texts, ["doc_id"], "_span", ["_line"], after, 1)
    blocks = along(ahead, "_line",
                   (F.coalesce(F.col("field"), F.lit("")) == "record_id").cast("long"), "block")
    # Dear texts are made once, for labels only; later steps name them.
    labels = blocks.where((F.col("block") > 0) & F.col("field").isNotNull()).withColumn(
        "_has_inline", F.col("inline") != "")
    candidate = F.when(~F.col("_has_inline") & F.col("_next_field").isNull(),
                       _no_colons(strip(F.col("_next"))))
    labels = labels.withColumn("_candidate", F.nullif(candidate, F.lit("")))
    has_inline, has_next = F.col("_has_inline"), F.col("_candidate").isNotNull()
    zero = F.lit(0.0)
    own_n = F.col("score").isNotNull().cast("long")
    total = F.coalesce("score", zero) + F.when(has_inline, zero).otherwise(
        F.coalesce("_sep_sum", zero)) + F.when(has_next, F.coalesce("_next_score", zero)) \
        .otherwise(zero)
    parts = own_n + F.when(has_inline, F.lit(0)).otherwise(F.col("_sep_n")) + F.when(
        has_next, F.col("_next_score").isNotNull().cast("long")).otherwise(F.lit(0))
    found = labels.select(
        "doc_id", "block", "page", "field", "line_no",
        F.when(has_inline, F.col("inline")).otherwise(F.col("_candidate")).alias("value"),
        F.try_divide(total, parts).alias("score"),
    )
    # The first value wins; without any, the last empty label counts.
    chosen = F.coalesce(
        F.min(F.when(F.col("value").isNotNull(), F.struct("line_no", "value", "score", "page"))),
        F.max(F.struct("line_no", "value", "score", "page")),
    )
    return found.groupBy("doc_id", "block", "field").agg(chosen.alias("_c")).select(
        "doc_id", "block", "field", F.col("_c.page").alias("page"),
        F.col("_c.value").alias("value"), F.col("_c.score").alias("score"))


def form_records(lines: DataFrame, whole: bool = False) -> DataFrame:
    """One row per record: raw values and mean scores, f_<field> and s_<field>."""
    fields = form_fields(lines, whole)
    cells = [
        e for f in FIELDS for e in (
            F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"f_{f}"),
            F.max(F.when(F.col("field") == f, F.col("score"))).alias(f"s_{f}"))
    ]
    page = F.max(F.when(F.col("field") == "record_id", F.col("page"))).alias("page")
    return fields.groupBy("doc_id", "block").agg(page, *cells)


def _clean(name: str) -> Column:
    cell = strip(F.regexp_replace(strip(F.col(f"f_{name}")), r"^[:\x{FF1A}]+|[:\x{FF1A}]+$", ""))
    return F.nullif(cell, F.lit(""))


def normalize_records(records: DataFrame) -> DataFrame:
    """Typed record with issues, warnings, score bands and a review flag."""
    cleaned = records.select(
        "doc_id", "block", "page", *[_clean(f).alias(f) for f in FIELDS],
        *[F.col(f"s_{f}") for f in FIELDS])
    numbers = ("age", "income")
    typed = cleaned.withColumns({
        f"_{n}_digits": F.regexp_replace(F.col(n), r"[^0-9.\-]", "") for n in numbers
    }).withColumns({
        f"_{n}": F.when(F.col(f"_{n}_digits").rlike(NUMBER), F.col(f"_{n}_digits").try_cast("double"))
        for n in numbers
    }).withColumns({
        f"_{n}_ok": F.col(n).isNull() | F.col(f"_{n}").isNotNull() for n in numbers
    }).withColumn("_years", F.col("_age").cast("long"))
    issues = F.array_compact(F.array(
        F.when(F.col("record_id").isNull(), "Missing Record ID."),
        F.when(~F.col("_age_ok"), "Age could not be interpreted as a number."),
        F.when(~F.col("_income_ok"), "Income could not be interpreted as a number."),
    ))
    gender, marital = F.col("gender"), F.col("marital_status")
    warnings = F.array_compact(F.array(
        F.when(~F.col("_years").between(0, 120), F.concat(
            F.lit("Age "), F.col("_years").cast("string"),
            F.lit(" is outside the plausible range."))),
        F.when(F.col("district").isNull(), "District was not detected."),
        F.when(F.col("_age_ok") & F.col("_years").isNull(), "Age was not detected."),
        F.when(~F.lower(gender).isin(*KNOWN_GENDERS),
               F.concat(F.lit("Unrecognized gender value: '"), gender, F.lit("'."))),
        F.when(~F.lower(marital).isin(*KNOWN_MARITAL),
               F.concat(F.lit("Unrecognized marital status value: '"), marital, F.lit("'."))),
    ))
    total = reduce(lambda a, b: a + b, [F.coalesce(f"s_{f}", F.lit(0.0)) for f in FIELDS], F.lit(0.0))
    some = reduce(lambda a, b: a + b, [F.col(f"s_{f}").isNotNull().cast("int") for f in FIELDS])
    mean = F.try_divide(total, some)
    low = reduce(lambda a, b: a | b, [
        F.col(f).isNotNull() & (score_band(F.col(f"s_{f}")) == "low") for f in FIELDS])
    plain = [f for f in FIELDS if f not in ("age", "income")]
    return typed.withColumns({"issues": issues, "warnings": warnings}).select(
        "doc_id", "block", "page", *plain, F.col("_years").alias("age"),
        F.col("_income").alias("income"), "issues", "warnings",
        F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"s_{f}"))])
        .alias("field_confidence"),
        F.create_map(*[x for f in FIELDS for x in (F.lit(f), score_band(F.col(f"s_{f}")))])
        .alias("field_confidence_band"),
        mean.alias("record_confidence"), score_band(mean).alias("record_confidence_band"),
        ((F.size("issues") > 0) | low).alias("needs_review"),
    )


def flag_duplicates(records: DataFrame) -> DataFrame:
    """Warn about record ids that occur more than once in a document."""
    repeated = (
        records.where(F.col("record_id").isNotNull()).groupBy("doc_id", "record_id")
        .agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)
    )
    joined = lookup_join(records, materialize(repeated), ["doc_id", "record_id"],
                         weight="_copies")
    return _warned(joined, records.columns)


def _warned(joined: DataFrame, columns: list[str]) -> DataFrame:
    warning = F.concat(F.lit("Duplicate Record ID '"), F.col("record_id"),
                       F.lit("' within this upload."))
    again = F.col("_copies").isNotNull()
    return joined.withColumns({
        "warnings": F.when(again, F.concat("warnings", F.array(warning)))
        .otherwise(F.col("warnings")),
        "needs_review": F.col("needs_review") | again,
    }).select(*columns)


def _flag_within(records: DataFrame) -> DataFrame:
    """``flag_duplicates`` where every document's records lie in one task."""
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "record_id"))
    copies = F.when(F.col("doc_id").isNotNull() & F.col("record_id").isNotNull() & (same > 1), same)
    return _warned(records.withColumn("_copies", copies), records.columns)


def long_documents(lines: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose lines lie in more than one block."""
    spans = lines.groupBy("doc_id").agg(
        F.min(_span()).alias("lo"), F.max(_span()).alias("hi"),
        F.count_if(F.col("line_no").isNull()).alias("gone"))
    return materialize(spans.where("lo < hi or (gone > 0 and lo is not null)").select("doc_id"))


def read_forms(lines: DataFrame) -> DataFrame:
    cut = long_documents(lines)
    size = cut.count()
    if size > BROADCAST_ROWS:
        return flag_duplicates(normalize_records(form_records(lines)))
    short, parts = lines, []
    if size:
        known = F.broadcast(cut.withColumn("_cut", F.lit(True)))
        split = null_safe_join(lines, known, ["doc_id"], "left")
        short = split.where(F.col("_cut").isNull()).drop("_cut")
        parts = [flag_duplicates(normalize_records(form_records(
            split.where(F.col("_cut")).drop("_cut"))))]
    parts.append(_flag_within(normalize_records(form_records(short, whole=True))))
    return reduce(DataFrame.unionByName, parts)


def preview(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, pages, records_detected, records_needing_review)."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    found = records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("records_detected"),
        F.count_if("needs_review").alias("records_needing_review"))
    return pages.join(found, "doc_id", "left").fillna(
        0, ["records_detected", "records_needing_review"])


def import_frame(records: DataFrame) -> DataFrame:
    """Record columns only, as input of the standardiser."""
    return records.select(*FIELDS)
