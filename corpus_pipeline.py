"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read
back as the next one's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm import mixing, near_dup, packing, passages, quality, queries as llm_queries
from plumbline.llm.common import written
from plumbline.plans.session import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking puts below its threshold go.

    It learns from all labelled documents of the data set; a row is judged by its
    text, so rows of one id are judged each.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=None)
    return quality.filtered(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id
    (five-word shingles, similarity of 0.8 or more).

    Of several rows of one id one stays, that of the smallest text; all rows without an
    id stay.
    """
    kept = near_dup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # A struct has a field at least; this one's name is none of the table's.
    none = F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))
    rows = docs.select("doc_id", "text", F.struct(none, *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    rows = rows.join(kept, "doc_id", "left_semi").withColumn("n", first).where("n = 1")
    columns = [F.col(f"rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns]
    return rows.select(*columns).unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of the
    later one; what was its first occurrence stays. Every document stays."""
    found = written(passages.repeated_passages(docs), "passages")
    return passages.without_passages(docs, found)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a repeated document comes as several rows.

    A null source is one of its own, a null text has no words and stays once; rows equal
    in all cells are documents each. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every document in one piece of a sequence of at most 1024. A null text is
    empty and has the end id only; repeated rows are packed each; no rows give no pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter), ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup), ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]
# Learned scores, minimum hashes, chains and token ids have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return llm_queries.QUERIES | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return dict(llm_queries.SQL) | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
