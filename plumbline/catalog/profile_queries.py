"""Profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.views import SV, SURVEY_COLUMNS, query, survey, table, with_
from plumbline.operators.profile import (
    category_counts, dataset_profile, duplicate_rows, entity_profiles, group_distributions,
    numeric_profiles, record_deviations, record_percentiles, record_zscores, top_values,
)

MEASURES = ("age", "household_size", "income", "working_hours")
TEXTS = tuple(c for c in SURVEY_COLUMNS if c not in MEASURES)
CATEGORICALS = ("household_id", "sex", "education", "marital_status", "household_role",
                "employment_status", "survey_round")
MISSING = " + ".join(f"CAST({c} IS NULL AS INT)" for c in SURVEY_COLUMNS)
WIDTH = len(SURVEY_COLUMNS)
LONG = "lng AS (" + " UNION ALL ".join(
    f"SELECT record_id, enumerator_id, cluster_id, district_code, '{m}' AS variable, "
    f"CAST({m} AS DOUBLE) AS value FROM sv" for m in MEASURES) + ")"
SCOPED = "scoped AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS scope, {c} AS id, * FROM sv" for s, c in (
        ("enumerator", "enumerator_id"), ("cluster", "cluster_id"),
        ("district", "district_code"))) + ")"


def rounded(df):
    return df.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("profile_dataset", with_(SV) + f"""
 SELECT count(*) AS record_count, CAST({WIDTH} AS BIGINT) AS column_count,
  CAST(4 AS BIGINT) AS numeric_column_count, CAST({WIDTH - 4} AS BIGINT) AS categorical_column_count,
  round(sum({MISSING}) / (count(*) * {WIDTH}.0), 6) AS missing_rate,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sv)) AS duplicate_count FROM sv""")
def _dataset(spark, sf_dir):
    return rounded(dataset_profile(survey(spark, sf_dir)).drop(
        "identifier_columns", "numeric_measures", "categorical_columns"))


@query("profile_duplicates", """
 WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0
  UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 0)
 SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_count FROM t""")
def _duplicates(spark, sf_dir):
    """Whole rows, some of them two and three times."""
    df = table(spark, sf_dir, "lineitem")
    return duplicate_rows(df.unionAll(df.where("l_orderkey % 50 = 0")).unionAll(df.where("l_orderkey % 100 = 0")))


@query("profile_numeric", with_(SV, LONG) + """
 SELECT variable AS variable_name, 'numeric' AS kind, count(*) - count(value) AS missing_count,
  round((count(*) - count(value)) * 1.0 / count(*), 6) AS missing_rate,
  count(DISTINCT value) AS unique_count, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(stddev_samp(value), 6) AS standard_deviation, round(quantile_cont(value, 0.25), 6) AS p25,
  round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95
 FROM lng GROUP BY variable""")
def _numeric(spark, sf_dir):
    return rounded(numeric_profiles(survey(spark, sf_dir)))


@query("profile_numeric_lineitem", " UNION ALL ".join(f"""
 SELECT '{c}' AS variable_name, count(DISTINCT {c}) AS unique_count, round(avg({c}), 8) AS mean,
  round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.95), 6) AS p95
 FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _numeric_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = numeric_profiles(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    # Means of cents over 60,000 rows can end in a tie at the sixth digit.
    return found.select("variable_name", "unique_count", F.round("mean", 8).alias("mean"),
                        F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


_TEXT_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value FROM sv" for c in TEXTS)


@query("profile_categorical_topn", with_(SV, f"""t AS ({_TEXT_LONG}),
 c AS (SELECT variable, value, count(*) AS count FROM t WHERE value IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value) AS position
       FROM c)""") + " SELECT variable, value, count, position FROM r WHERE position <= 10")
def _categorical(spark, sf_dir):
    counts = category_counts(survey(spark, sf_dir), list(TEXTS))
    return top_values(counts, ["variable"]).withColumn("position", F.col("position").cast("long"))


def _entity_sql(scope: str) -> str:
    related = ("min_by(district_code, record_id)" if scope == "cluster"
               else "CAST(NULL AS VARCHAR)")
    return with_(SV, SCOPED) + f"""
 SELECT id, count(*) AS record_count,
  round(sum({MISSING}) / (count(*) * {WIDTH}.0), 6) AS missingness_rate,
  round(avg(age), 6) AS mean_age, round(avg(income), 6) AS mean_income,
  round(avg(CASE WHEN employment_status LIKE '%employ%'
     AND employment_status NOT LIKE '%unemploy%' THEN 1.0 ELSE 0.0 END), 6) AS employment_rate,
  {related} AS related_id FROM scoped WHERE scope = '{scope}' GROUP BY id"""


def _entity(scope: str):
    def run(spark, sf_dir):
        rows = entity_profiles(survey(spark, sf_dir), distributions=False)
        return rounded(rows.where(F.col("scope") == scope).select(
            "id", "record_count", "missingness_rate",
            F.try_element_at("numeric_means", F.lit("age")).alias("mean_age"),
            F.try_element_at("numeric_means", F.lit("income")).alias("mean_income"),
            "employment_rate", "related_id"))
    return run


for _scope in ("enumerator", "cluster", "district"):
    query(f"profile_{_scope}", _entity_sql(_scope))(_entity(_scope))


_GROUP_LONG = " UNION ALL ".join(
    f"SELECT scope, id, '{c}' AS variable, {c} AS value FROM scoped" for c in CATEGORICALS)


@query("profile_group_distributions", with_(SV, SCOPED, f"""t AS ({_GROUP_LONG}),
 c AS (SELECT scope, id, variable, value, count(*) AS count FROM t WHERE value IS NOT NULL
       GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY scope, id, variable
       ORDER BY count DESC, value) AS position FROM c)""")
       + " SELECT scope, id, variable, value, count, position FROM r WHERE position <= 10")
def _distributions(spark, sf_dir):
    rows = group_distributions(survey(spark, sf_dir))
    return rows.withColumn("position", F.col("position").cast("long"))


def _z_sql(m: str) -> str:
    return (f"round(({m} - (SELECT avg({m}) FROM sv)) / (SELECT stddev_pop({m}) FROM sv), 6) "
            f"AS z_{m}")


@query("record_zscores", with_(SV) + f"""
 SELECT record_id, CAST({MISSING} AS BIGINT) AS missing_count,
  round(({MISSING}) / {WIDTH}.0, 6) AS missing_rate, {', '.join(_z_sql(m) for m in MEASURES)}
 FROM sv""")
def _zscores(spark, sf_dir):
    return rounded(record_zscores(survey(spark, sf_dir)).drop("outlier_features"))


@query("record_percentile_rank", with_(SV, LONG) + """
 SELECT record_id, variable, round(value, 6) AS value,
  round((rank() OVER w + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0)
        / count(*) OVER (PARTITION BY variable), 6) AS percentile
 FROM lng WHERE value IS NOT NULL WINDOW w AS (PARTITION BY variable ORDER BY value)""")
def _percentiles(spark, sf_dir):
    return rounded(record_percentiles(survey(spark, sf_dir)))


@query("record_group_deviation", with_(SV) + " SELECT record_id, " + ", ".join(
    f"round({m} - avg({m}) OVER (PARTITION BY {c}), 6) AS {s}_dev_{m}"
    for s, c in (("enumerator", "enumerator_id"), ("cluster", "cluster_id"),
                 ("district", "district_code")) for m in MEASURES) + " FROM sv")
def _deviation(spark, sf_dir):
    return rounded(record_deviations(survey(spark, sf_dir)))
