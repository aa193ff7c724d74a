"""Profiles of a batch: dataset, variables, records, groups.

Variables are profiled from counted (variable, value) pairs, so copies of a
value shrink before the one shuffle. Groups are profiled for all three scopes in
one pass. No window runs over a whole group of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.answers import employed, field_number, missing_cells
from plumbline.functions.order_stats import exact_quantiles, rank_table
from plumbline.functions.values import as_text
from plumbline.operators.roles import (
    Roles, concept, detect_roles, id_columns, role_text, row_order,
)
from plumbline.operators.standardize import unpivot_measures
from plumbline.plans.lookup import empty_frame, lookup_join, materialize, maybe_in

TOP_VALUES = 10


def row_copies(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """(_copies, *extra) per distinct row of ``df``, however wide its rows are.

    Rows are first counted by a 128-bit digest, a narrow shuffle; only rows whose digest
    comes more than once, and the few that share a mark with one, are grouped by all their
    cells. The others are alone and are not moved. ``extra`` columns follow from the cells.
    """
    extra = extra or {}
    kinds = ("map<", "variant")  # no key of any grouping
    cells = [F.col(f"`{c}`") for c, kind in df.dtypes if not any(k in kind for k in kinds)]
    digest = F.struct(F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells))
    # A digest is told apart from one with other nulls: nulls are skipped by the hash.
    shape = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    rows = df.withColumns({"_digest": F.struct(digest.alias("h"), F.xxhash64(shape).alias("s")),
                           **{f"_x_{n}": c for n, c in extra.items()}})
    repeated = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest")
    some, alone = maybe_in(rows, materialize(repeated), "_digest")
    named = [F.first(f"_x_{n}").alias(n) for n in extra]
    met = some.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"), *named).select("_copies", *extra)
    return met.unionByName(alone.select(F.lit(1).cast("bigint").alias("_copies"),
                                        *[F.col(f"_x_{n}").alias(n) for n in extra]))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicate_count): every copy but the first."""
    return row_copies(df).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_count"),
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row. Copies are counted by digest; missing cells ride along."""
    roles = detect_roles(df)
    width = len(df.columns)
    numeric = [f.name for f in df.schema.fields
               if f.name in roles.numeric_measures
               or (f.name in roles.identifiers and f.dataType.typeName() != "string")]
    copies = row_copies(df, {"_missing": missing_cells(df.columns)})
    missing = F.sum(F.col("_missing") * F.col("_copies"))
    cells = F.sum("_copies") * width
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("record_count"),
        F.lit(width).cast("long").alias("column_count"),
        F.lit(len(numeric)).cast("long").alias("numeric_column_count"),
        F.lit(width - len(numeric)).cast("long").alias("categorical_column_count"),
        F.coalesce(missing / cells, F.lit(0.0)).alias("missing_rate"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumns({
        "identifier_columns": F.array(*[F.lit(c) for c in roles.identifiers]).cast("array<string>"),
        "numeric_measures": F.array(*[F.lit(c) for c in roles.numeric_measures])
        .cast("array<string>"),
        "categorical_columns": F.array(*[F.lit(c) for c in roles.categoricals])
        .cast("array<string>"),
    })


def numeric_profiles(
    df: DataFrame, measures: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """One row per numeric column.

    ``approx`` replaces exact distinct counts and quantiles by sketches.
    """
    measures = list(detect_roles(df).numeric_measures) if measures is None else measures
    probs = [0.25, 0.5, 0.75, 0.95]
    long = unpivot_measures(df, [], measures)
    if approx:
        stats = long.groupBy("variable").agg(
            F.count(F.lit(1)).alias("_n"), F.count("value").alias("_valid"),
            F.approx_count_distinct("value").alias("unique_count"),
            F.min("value").alias("min"), F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("standard_deviation"),
            F.percentile_approx("value", probs).alias("_q"),
        )
    else:
        counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("copies"))
        weight = F.when(F.col("value").isNotNull(), F.col("copies"))
        stats = counts.groupBy("variable").agg(
            F.sum("copies").alias("_n"), F.coalesce(F.sum(weight), F.lit(0)).alias("_valid"),
            F.count("value").alias("unique_count"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        )
        spread = df.select(*[F.col(m).cast("double").alias(m) for m in measures]).agg(
            *[F.struct(F.lit(m).alias("variable"), F.avg(m).alias("mean"),
                       F.stddev_samp(m).alias("standard_deviation")).alias(f"_{i}")
              for i, m in enumerate(measures)]
        ).select(F.explode(F.array(*[f"_{i}" for i in range(len(measures))])).alias("s")) \
            .select("s.*")
        quantiles = exact_quantiles(df, {m: F.col(m) for m in measures}, probs)
        tops = df.sparkSession.createDataFrame(
            [(m, q or [None] * 4) for m, q in quantiles.items()],
            "variable string, _q array<double>",
        )
        # All three sides have one row per column of the table.
        stats = stats.join(F.broadcast(spread), "variable").join(F.broadcast(tops), "variable")
    return stats.select(
        F.col("variable").alias("variable_name"),
        F.lit("numeric").alias("kind"),
        (F.col("_n") - F.col("_valid")).alias("missing_count"),
        ((F.col("_n") - F.col("_valid")) / F.col("_n")).alias("missing_rate"),
        "unique_count", "min", "max", "mean",
        F.get("_q", F.lit(1)).alias("median"),
        "standard_deviation",
        F.get("_q", F.lit(0)).alias("p25"),
        F.get("_q", F.lit(2)).alias("p75"),
        F.get("_q", F.lit(3)).alias("p95"),
    )


def category_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., variable, value, count) of text columns; null value = missing."""
    by = by or []
    wide = df.select(
        *[F.col(b) for b in by],
        *[as_text(F.col(c), df.schema[c].dataType).alias(f"_c{i}")
          for i, c in enumerate(columns)],
    )
    named = wide.unpivot(by, [f"_c{i}" for i in range(len(columns))], "_v", "value")
    label = reduce(
        lambda acc, ic: acc.when(F.col("_v") == f"_c{ic[0]}", F.lit(ic[1])), enumerate(columns), F
    )
    return (
        named.groupBy(*by, "_v", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(*by, label.alias("variable"), "value", "count")
    )


def top_values(counts: DataFrame, by: list[str], limit: int = TOP_VALUES) -> DataFrame:
    """Most frequent values; ties go to the smaller text.

    The rank filter lets Spark keep only ``limit`` rows per key before it
    shuffles, so a key with very many values does not fill one task.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc("value"))
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= limit)
    )


def categorical_profiles(
    df: DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES
) -> DataFrame:
    """One row per text column with its most frequent values."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    counts = materialize(category_counts(df, columns))
    sums = counts.groupBy("variable").agg(
        F.sum("count").alias("_n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0))
        .alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    tops = (
        top_values(counts, ["variable"], top)
        .groupBy("variable")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "value", "count"))),
            lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count")),
        ).alias("top_values"))
    )
    return sums.join(F.broadcast(tops), "variable", "left").select(
        F.col("variable").alias("variable_name"),
        F.lit("categorical").alias("kind"),
        "missing_count",
        (F.col("missing_count") / F.col("_n")).alias("missing_rate"),
        "unique_count",
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>"))
        .alias("top_values"),
    )


def variable_profiles(df: DataFrame, approx: bool = False) -> DataFrame:
    """All columns, numeric and text, in one relation."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    numeric = [c for c in df.columns if c not in text]
    parts = []
    if numeric:
        parts.append(numeric_profiles(df, numeric, approx))
    if text:
        parts.append(categorical_profiles(df, text))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # A table without numbers has these columns too.
    return out.withColumns({c: F.lit(None).cast("double") for c in ("mean", "standard_deviation")
                            if c not in out.columns})


def scope_rows(df: DataFrame, roles: Roles, columns: list) -> DataFrame:
    """Each record once per scope: (scope, group_id, columns...)."""
    scopes = F.array(*[
        F.struct(F.lit(s).alias("scope"), role_text(df, roles, f"{s}_id").alias("group_id"))
        for s in roles.scopes
    ]).cast("array<struct<scope:string,group_id:string>>")
    return df.select(F.explode(scopes).alias("_s"), *columns).select(
        "_s.scope", "_s.group_id", *[F.col(c) for c in _names(df, columns)]
    )


def scope_sums(df: DataFrame, roles: Roles, order: Column, columns: list[Column],
               sums: list[Column]) -> DataFrame:
    """``sums`` of each combination of group ids, once per scope: (scope, group_id, _district,
    _first, sums...), where ``_first`` holds the least ``order``.

    Records are combined before they are dealt to scopes, so none is copied for each scope.
    The scope of a whole table is ``dataset``.
    """
    ids = [role_text(df, roles, f"{s}_id").alias(f"_g_{s}") for s in roles.scopes]
    keys = [*[f"_g_{s}" for s in roles.scopes], "_district"]
    combined = (
        df.select(*ids, role_text(df, roles, "district_id").alias("_district"),
                  F.struct(order.alias("o")).alias("_order"), *columns)
        .groupBy(*keys).agg(F.min("_order").alias("_first"), *sums))
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"_g_{s}").alias("group_id"))
                       for s in roles.scopes],
                     F.struct(F.lit("dataset").alias("scope"), F.lit("all").alias("group_id")))
    return combined.withColumn("_s", F.explode(scopes)).select(
        "_s.scope", "_s.group_id", *[c for c in combined.columns if not c.startswith("_g_")])


def _names(df: DataFrame, columns: list) -> list[str]:
    return df.select(*columns).columns


def entity_profiles(
    df: DataFrame, order: str | None = None, distributions: bool = True
) -> DataFrame:
    """One row per enumerator, cluster and district (``scope``, ``id``).

    A missing key is kept as the text ``null``. ``related_id`` is the first
    district of a cluster. Distributions keep the ten most frequent values.
    """
    roles = detect_roles(df)
    measures = list(roles.numeric_measures)
    width = len(df.columns)
    status = concept(df, "employment")
    answer = F.col(status).cast("string") if status else F.lit(None).cast("string")
    rows = scope_sums(
        df, roles, row_order(df, roles, order),
        [*[field_number(df, m).alias(f"_m{i}") for i, m in enumerate(measures)],
         missing_cells(df.columns).alias("_missing"),
         employed(answer).cast("double").alias("_employed")],
        [F.count(F.lit(1)).alias("_rows"),
         *[f(c).alias(f"{c}_{n}") for c in (*[f"_m{i}" for i in range(len(measures))], "_employed")
           for n, f in (("n", F.count), ("sum", F.sum))],
         F.sum("_missing").alias("_missing")],
    ).where("scope <> 'dataset'").withColumn("id", F.coalesce("group_id", F.lit("null")))

    def mean(c: str, where: Column = F.lit(True)) -> Column:
        return F.try_divide(F.sum(F.when(where, F.col(f"{c}_sum"))), F.sum(F.when(where, F.col(f"{c}_n"))))

    groups = rows.groupBy("scope", "id").agg(
        F.sum("_rows").alias("record_count"),
        (F.sum("_missing") / (F.sum("_rows") * width)).alias("missingness_rate"),
        F.map_from_arrays(
            F.array(*[F.lit(m) for m in measures]).cast("array<string>"),
            F.array(*[mean(f"_m{i}") for i in range(len(measures))]).cast("array<double>"),
        ).alias("numeric_means"),
        # A group whose key is missing has no rate of its own.
        mean("_employed", F.col("group_id").isNotNull()).alias("employment_rate"),
        F.min(F.when((F.col("scope") == "cluster") & F.col("_district").isNotNull(),
                     F.struct("_first", "_district"))).alias("_first"),
    ).select(
        "scope", "id", "record_count", "missingness_rate", "numeric_means",
        "employment_rate", F.col("_first._district").alias("related_id"),
    )
    if not distributions or not roles.categoricals:
        return groups
    tops = group_distributions(df)
    packed = (
        tops.groupBy("scope", "id", "variable")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("_counts"))
        .groupBy("scope", "id")
        .agg(F.map_from_entries(F.collect_list(F.struct("variable", "_counts")))
             .alias("categorical_distributions"))
    )
    return groups.join(packed, ["scope", "id"], "left")


def group_distributions(df: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """(scope, id, variable, value, count, position): ten values per group."""
    roles = detect_roles(df)
    text = list(roles.categoricals)
    rows = scope_rows(df, roles, [F.col(c).cast("string").alias(c) for c in text])
    rows = rows.withColumn("id", F.coalesce("group_id", F.lit("null"))).drop("group_id")
    counts = category_counts(rows, text, ["scope", "id"])
    return top_values(counts, ["scope", "id", "variable"], top)


def measure_moments(df: DataFrame, measures: list[str]) -> dict[str, tuple]:
    """{measure: (n, mean, population std)}, one row to the driver."""
    if not measures:
        return {}
    row = df.agg(*[
        F.struct(F.count(m).alias("n"), F.avg(m).alias("mean"),
                 F.stddev_pop(m).alias("std")).alias(f"m{i}")
        for i, m in enumerate(measures)
    ]).first()
    return {m: tuple(row[f"m{i}"]) for i, m in enumerate(measures)}


def record_zscores(df: DataFrame) -> DataFrame:
    """(record_id, missing_count, missing_rate, z_<measure>..., outlier_features)."""
    roles = detect_roles(df)
    measures = list(roles.numeric_measures)
    numbers = df.select(*[field_number(df, m).alias(m) for m in measures])
    moments = measure_moments(numbers, measures)

    def z(m):
        _, mean, std = moments[m]
        if not std:
            return F.lit(None).cast("double")
        return (field_number(df, m) - F.lit(mean)) / F.lit(std)

    cells = missing_cells(df.columns)
    return df.select(
        role_text(df, roles, "record_id"),
        cells.cast("long").alias("missing_count"),
        (cells / len(df.columns)).alias("missing_rate"),
        *[z(m).alias(f"z_{m}") for m in measures],
        F.array_compact(F.array(*[
            F.when(F.abs(z(m)) >= 3, F.lit(m)) for m in measures
        ])).alias("outlier_features"),
    )


def record_percentiles(df: DataFrame) -> DataFrame:
    """(record_id, variable, value, percentile): average rank of ties over n."""
    roles = detect_roles(df)
    if not roles.numeric_measures:
        return empty_frame(df.sparkSession, "record_id string, variable string, value double, "
                                            "percentile double")
    long = unpivot_measures(
        df, [role_text(df, roles, "record_id")], list(roles.numeric_measures)
    ).where(F.col("value").isNotNull())
    ranks = materialize(
        rank_table(long, "variable", "value").select(
            "variable", "value",
            "copies",
            ((F.col("first_rank") + F.col("last_rank")) / (2.0 * F.col("total")))
            .alias("percentile"),
        )
    )
    return lookup_join(long, ranks, ["variable", "value"], weight="copies").select(
        "record_id", "variable", "value", "percentile"
    )


def record_deviations(df: DataFrame) -> DataFrame:
    """(record_id, <scope>_dev_<measure>...): value minus its group's mean."""
    roles = detect_roles(df)
    measures = list(roles.numeric_measures)
    base = df.select(
        *id_columns(df, roles), *[field_number(df, m).alias(m) for m in measures]
    )
    out = base
    for scope in roles.scopes:
        key = f"{scope}_id"
        means = materialize(
            base.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.avg(m).alias(f"_{scope}_{m}") for m in measures])
        )
        out = lookup_join(out, means, [key], weight="_rows").drop("_rows")
    return out.select("record_id", *[
        (F.col(m) - F.col(f"_{s}_{m}")).alias(f"{s}_dev_{m}")
        for s in roles.scopes for m in measures
    ])
