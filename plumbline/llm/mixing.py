"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id. Words are summed by source and the top
12 bits; a running sum over at most 4096 buckets finds the bucket in which the
source's budget ends. Only documents of that bucket are summed again by the next 12
bits, and so on, so that a threshold per source is found and documents are chosen by
a filter, without sorting. Thresholds are nested: a larger budget takes all that a
smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import hot_join, need, ranked, written

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 48, 12
MOST_COPIES = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., ``cycle`` in turn over the sources by code point, null last."""
    held = ranked(sources, [F.col("source").asc_nulls_last()])
    return held.withColumn("weight", F.col("_rank") % cycle + 1).drop("_rank")


def mix(docs: DataFrame, weights: DataFrame | None = None,
        most_copies: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, part_words) per row.

    ``weights`` has (source, weight) with positive whole weights, for each source
    once; a source without one takes nothing. All words are shared by weight, a
    source gets at most ``most_copies`` times its own, and what it leaves is shared
    by the others. A document is taken ``copies`` times whole and once up to its
    first ``part_words`` words; only the document on the threshold is cut. Null text
    counts no words; a null source is a source; null ids share one hash. Rows of one
    hash on the threshold share what is left in proportion to their sizes.
    """
    rows = written(_measured(docs, need(docs, "doc_id", "source").columns), "sizes")
    out = _decided(rows, _plan(rows, weights, most_copies))
    return out.select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "copies",
                      "part_words")


def _key() -> Column:
    """A key that a null source has too."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, source, key, size, hash); ``row`` holds the columns to keep."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
                                      .cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "source",
                       _key().alias("key"), word_count("text").alias("size"), hashed.alias("hash"))


def _plan(rows: DataFrame, weights: DataFrame | None, most_copies: int) -> DataFrame:
    """Budget and threshold of each source."""
    sources = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"),
                                                F.count("*").alias("n"))
    if weights is None:
        sources = cyclic_weights(sources)
    else:
        named = need(weights, "source", "weight").withColumn("key", _key()).drop("source")
        sources = sources.join(named, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    budgets = written(_budgets(written(sources, "sources"), most_copies), "budgets")
    return written(budgets.join(_thresholds(rows, budgets), "key", "left").drop("source"), "mix_plan")


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    out = hot_join(rows, plan, "key", "n")
    part = (F.when(F.col("hash") < F.col("cut"), F.col("size"))
            .when(F.col("hash") == F.col("cut"), F.expr("(rest - before) * size div tied"))
            .otherwise(F.lit(0)))
    out = out.withColumn("_part", F.when(F.col("before").isNull(), F.lit(0)).otherwise(part).cast("bigint"))
    whole = F.col("_part") >= F.col("size")
    return out.select(
        "row", "size", "source_size", "target",
        (F.col("times") * F.col("size") + F.col("_part")).alias("taken"),
        (F.col("times") + F.when(whole & (F.col("size") > 0), 1).otherwise(0)).cast("int").alias("copies"),
        F.when(whole, F.lit(0)).otherwise(F.col("_part")).cast("bigint").alias("part_words"))


def _budgets(sources: DataFrame, most: int) -> DataFrame:
    """target, whole ``times`` and the ``rest`` of words per source.

    The words of one unit of weight grow as sources reach their ceiling, until no
    source is above; each round is one sum over the sources.
    """
    ceiling = F.col("source_size") * most
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    unit, capped = 0.0, -1
    while True:
        full = ceiling.cast("double") < F.lit(unit) * F.col("weight")
        got = sources.agg(
            F.sum(F.when(full, ceiling).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(full).alias("capped")).first()
        if got.capped == capped or not got.weights:
            break
        capped, unit = got.capped, (everything - got.held) / got.weights
    target = F.when(full, ceiling.cast("double")).otherwise(F.lit(unit) * F.col("weight"))
    words = F.floor("target").cast("bigint")
    return sources.withColumn("target", target).withColumns({
        "times": F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size"))
        .otherwise(F.lit(0)).cast("bigint"),
        "rest": F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(F.lit(0)),
    })


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, cut, before, tied): the hash on which a source's rest ends, the words of
    smaller hashes and the words of that hash."""
    at = budgets.where("source_size > 0").select(
        "key", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    inside = rows.select("key", "size", "hash")
    run = W.partitionBy("key").orderBy("bucket")
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", shift)
        sums = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        found = (sums.join(at, "key")
                 .withColumn("upto", F.col("before") + F.sum("words").over(run))
                 .where(F.col("upto") > F.col("rest"))
                 .withColumn("_n", F.row_number().over(run)).where("_n = 1"))
        at = written(found.select("key", "rest", F.col("bucket").alias("prefix"),
                                  (F.col("upto") - F.col("words")).alias("before"), "words"), "cut")
        if shift:
            inside = written(inside.withColumn("prefix", bucket)
                             .join(at.select("key", "prefix"), ["key", "prefix"], "left_semi")
                             .select("key", "size", "hash"), "inside")
            at = at.drop("words")
    return at.select("key", F.col("prefix").alias("cut"), "before", F.col("words").alias("tied"))


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None,
               most_copies: int = MOST_COPIES) -> DataFrame:
    """The mix as documents: whole copies, and the cut one with its first words.

    Rows keep all columns of ``docs``; ``n_chars`` follows the text. A document without
    words weighs nothing in any budget and stays once.
    """
    narrow = written(_measured(docs, ["doc_id"]), "sizes")
    out = _decided(_measured(docs, docs.columns), _plan(narrow, weights, most_copies))
    copies = F.expr("if(size = 0, array(false), concat(array_repeat(false, copies), "
                    "if(part_words > 0, array(true), array())))")
    rows = out.select("row", "part_words", F.explode(copies).alias("cut"))
    first = F.expr(r"""array_join(slice(regexp_extract_all(row.text,
        '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(part_words as int)), '')""")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.when(F.col("cut"), first).otherwise(columns["text"])
    if "n_chars" in columns:
        cut_chars = F.char_length(first).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("cut"), cut_chars).otherwise(columns["n_chars"])
    return rows.select(*[v.alias(c) for c, v in columns.items()])
