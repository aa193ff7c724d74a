"""Rules and standardisation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.views import (
    REFERENCES, SV, query, survey, table, with_,
)
from plumbline.functions.values import as_text
from plumbline.operators.roles import detect_roles, role_text
from plumbline.operators.rules import (
    Predicate, Rule, built_in_rules, evaluate_rules, rule_summary,
)
from plumbline.operators.standardize import canonical_names, standardize, unpivot_measures

# Broken-rule conditions of the built-in rules, written out as SQL.
_BUILT_IN = [
    ("AGE_MIN", "HIGH", "age", "age < 0", "age >= 0", "Age must be at least 0."),
    ("AGE_MAX", "HIGH", "age", "age > 100", "age <= 100", "Age must be at most 100."),
    ("WORKING_HOURS_MIN", "HIGH", "working_hours", "working_hours < 0", "working_hours >= 0",
     "Working hours must be at least 0."),
    ("WORKING_HOURS_MAX", "CRITICAL", "working_hours", "working_hours > 168",
     "working_hours <= 168", "Working hours must be at most 168 (hours in a week)."),
    ("INCOME_NON_NEGATIVE", "HIGH", "income", "income < 0", "income >= 0",
     "Income must be at least 0."),
    ("HOUSEHOLD_SIZE_MIN", "HIGH", "household_size", "household_size < 1",
     "household_size >= 1", "Household size must be at least 1 when the field is present."),
    ("ENUMERATOR_REQUIRED", "HIGH", "enumerator_id", "coalesce(trim(enumerator_id), '') = ''",
     "enumerator_id is not blank", "Enumerator identifier must exist."),
    ("CLUSTER_REQUIRED", "HIGH", "cluster_id", "coalesce(trim(cluster_id), '') = ''",
     "cluster_id is not blank", "Cluster identifier must exist."),
    ("DISTRICT_REQUIRED", "HIGH", "district_code", "coalesce(trim(district_code), '') = ''",
     "district_code is not blank", "District code must exist."),
    ("EMPLOYED_HAS_HOURS", "MEDIUM", "working_hours",
     "employment_status = 'employed' AND (working_hours IS NULL OR working_hours <= 0)",
     "when employment_status = employed then working_hours > 0",
     "If employment_status is employed, working_hours must be greater than 0."),
    ("UNEMPLOYED_ZERO_HOURS", "MEDIUM", "working_hours",
     "employment_status = 'unemployed' AND (working_hours IS NULL OR working_hours <> 0)",
     "when employment_status = unemployed then working_hours = 0",
     "If employment_status is unemployed, working_hours should be 0."),
    ("CLUSTER_IN_REFERENCE", "MEDIUM", "cluster_id",
     "CAST(substr(cluster_id, 2) AS INT) > 47", "cluster_id in reference set clusters",
     "cluster_id must be in the sample cluster list."),
    ("DISTRICT_IN_REFERENCE", "MEDIUM", "district_code",
     "CAST(substr(district_code, 2) AS INT) > 3", "district_code in reference set districts",
     "district_code must be in the sample district list."),
    ("ENUMERATOR_IN_REFERENCE", "MEDIUM", "enumerator_id",
     "CAST(substr(enumerator_id, 2) AS INT) > 23",
     "enumerator_id in reference set enumerators",
     "enumerator_id must be in the sample enumerator list."),
]


def violations_sql(source: str = "sv", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra} record_id, enumerator_id, cluster_id, district_code AS district_id, "
        f"'{code}' AS rule_code, '{severity}' AS severity, '{fld}' AS field, "
        f"CAST({fld} AS VARCHAR) AS observed_value, '{text}' AS expected_condition, "
        f"'{message}' AS message FROM {source} WHERE {test}"
        for code, severity, fld, test, text, message in _BUILT_IN)


RULES = f"rv AS ({violations_sql()})"


@query("rule_violations_detail", with_(SV, RULES) + " SELECT * FROM rv")
def _detail(spark, sf_dir):
    return evaluate_rules(survey(spark, sf_dir), references=REFERENCES).violations.drop("rule_id")


@query("rule_violations_by_severity",
       with_(SV, RULES) + " SELECT severity, count(*) AS violations FROM rv GROUP BY severity")
def _by_severity(spark, sf_dir):
    found = evaluate_rules(survey(spark, sf_dir), references=REFERENCES).violations
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("violations"))


@query("rule_summary", with_(SV, RULES) + """
 SELECT CAST(14 AS BIGINT) AS rules_evaluated, (SELECT count(*) FROM sv) AS records_checked,
  count(*) AS violations, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low FROM rv""")
def _summary(spark, sf_dir):
    df = survey(spark, sf_dir)
    return rule_summary(df, evaluate_rules(df, references=REFERENCES))


@query("rule_conditional", with_(SV, RULES) + """
 SELECT rule_code, observed_value IS NULL AS missing, count(*) AS violations FROM rv
 WHERE rule_code IN ('EMPLOYED_HAS_HOURS', 'UNEMPLOYED_ZERO_HOURS') GROUP BY ALL""")
def _conditional(spark, sf_dir):
    rules = [r for r in built_in_rules() if r.when is not None]
    found = evaluate_rules(survey(spark, sf_dir), rules, REFERENCES).violations
    return found.groupBy("rule_code", F.col("observed_value").isNull().alias("missing")).agg(
        F.count(F.lit(1)).alias("violations"))


_CROSS = [
    ("EQ", "l_returnflag", "field_equals_field", "l_linestatus", "l_returnflag = l_linestatus"),
    ("NE", "l_returnflag", "field_not_equals_field", "l_linestatus",
     "l_returnflag <> l_linestatus"),
    ("GT", "l_discount", "field_greater_than_field", "l_tax", "l_discount > l_tax"),
    ("LT", "l_discount", "field_less_than_field", "l_tax", "l_discount < l_tax"),
    ("GE", "l_quantity", "field_greater_than_or_equal_field", "l_linenumber",
     "l_quantity >= l_linenumber"),
    ("LE", "l_quantity", "field_less_than_or_equal_field", "l_linenumber",
     "l_quantity <= l_linenumber"),
]


@query("rule_cross_field", " UNION ALL ".join(
    f"SELECT 'X_{code}' AS rule_code, count(*) AS violations FROM lineitem WHERE NOT ({test}) "
    "HAVING count(*) > 0"
    for code, _, _, _, test in _CROSS))
def _cross(spark, sf_dir):
    rules = [Rule(f"X_{code}", a, op, second_field=b) for code, a, op, b, _ in _CROSS]
    found = evaluate_rules(table(spark, sf_dir, "lineitem"), rules, {}).violations
    return found.groupBy("rule_code").agg(F.count(F.lit(1)).alias("violations"))


@query("rule_reference_miss", """
 SELECT CAST(l_partkey AS VARCHAR) AS observed_value, count(*) AS violations FROM lineitem
 WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY l_partkey""")
def _reference(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size <= 40").select(
        F.lit("parts").alias("set_code"), F.col("p_partkey").cast("string").alias("value"))
    rule = Rule("PART_IN_REFERENCE", "l_partkey", "in_reference", "parts")
    found = evaluate_rules(table(spark, sf_dir, "lineitem"), [rule], parts).violations
    return found.groupBy("observed_value").agg(F.count(F.lit(1)).alias("violations"))


_BLANK = """CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN '  '
 WHEN event_id % 19 = 0 THEN NULL ELSE concat('E', CAST(user_id AS {text})) END"""


@query("rule_blank_ids", f"""
 WITH b AS (SELECT {_BLANK.format(text='VARCHAR')} AS enumerator_id FROM events)
 SELECT 'NOT_BLANK' AS rule_code, count(*) AS violations FROM b
  WHERE coalesce(trim(enumerator_id), '') = ''
 UNION ALL SELECT 'BLANK', count(*) FROM b WHERE coalesce(trim(enumerator_id), '') <> ''
 UNION ALL SELECT 'NOT_NULL', count(*) FROM b WHERE enumerator_id IS NULL
 UNION ALL SELECT 'NULL', count(*) FROM b WHERE enumerator_id IS NOT NULL""")
def _blank(spark, sf_dir):
    df = spark.sql(f"SELECT event_id AS record_id, {_BLANK.format(text='STRING')} "
                   "AS enumerator_id FROM {events}", events=table(spark, sf_dir, "events"))
    rules = [Rule(op.removeprefix("is_").upper(), "enumerator_id", op)
             for op in ("is_not_blank", "is_blank", "is_not_null", "is_null")]
    found = evaluate_rules(df, rules, {}).violations
    return found.groupBy("rule_code").agg(F.count(F.lit(1)).alias("violations"))


# One rule per operator; the SQL says where it is broken (null breaks nothing).
_MATRIX = [
    ("equals", Rule("equals", "sex", "equals", "F"), "sex <> 'F'"),
    ("equals_number", Rule("equals_number", "household_size", "equals", 3),
     "household_size <> 3"),
    ("not_equals", Rule("not_equals", "education", "not_equals", "primary"),
     "education = 'primary'"),
    ("greater_than", Rule("greater_than", "age", "greater_than", 30), "age <= 30"),
    ("greater_than_or_equal", Rule("greater_than_or_equal", "age", "greater_than_or_equal", 30),
     "age < 30"),
    ("less_than", Rule("less_than", "income", "less_than", 5000), "income >= 5000"),
    ("less_than_or_equal", Rule("less_than_or_equal", "income", "less_than_or_equal", 5000.5),
     "income > 5000.5"),
    ("in", Rule("in", "education", "in", ["primary", "secondary"]),
     "education NOT IN ('primary', 'secondary')"),
    ("in_scalar", Rule("in_scalar", "household_size", "in", 2), "household_size <> 2"),
    ("not_in", Rule("not_in", "education", "not_in", ["primary", "postgraduate"]),
     "education IN ('primary', 'postgraduate')"),
    ("between", Rule("between", "age", "between", [18, 65]), "age NOT BETWEEN 18 AND 65"),
    ("not_between", Rule("not_between", "age", "not_between", [18, 65]),
     "age BETWEEN 18 AND 65"),
    ("is_null", Rule("is_null", "income", "is_null"), "income IS NOT NULL"),
    ("is_not_null", Rule("is_not_null", "income", "is_not_null"), "income IS NULL"),
    ("conditional", Rule("conditional", "income", "greater_than", 1000,
                         when=Predicate("sex", "equals", "F")),
     "sex = 'F' AND (income IS NULL OR income <= 1000)"),
]


@query("rule_operators_matrix", with_(SV) + " UNION ALL ".join(
    f" SELECT '{name}' AS rule_code, count(*) AS violations FROM sv WHERE {test}"
    for name, _, test in _MATRIX))
def _matrix(spark, sf_dir):
    found = evaluate_rules(survey(spark, sf_dir), [r for _, r, _ in _MATRIX], {}).violations
    return found.groupBy("rule_code").agg(F.count(F.lit(1)).alias("violations"))


_MESSY = """
 CASE event_id % 11 WHEN 0 THEN ' NA ' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NULL' WHEN 3 THEN ' - '
  WHEN 4 THEN '.' WHEN 5 THEN 'NaN' WHEN 6 THEN '' WHEN 7 THEN 'None'
  ELSE concat('  ', event_type, ' ') END"""
_TOKENS = "('', 'na', 'n/a', 'null', 'none', 'nan', '-', '.')"


@query("standardize_missing_tokens", f"""
 WITH m AS (SELECT event_id, trim({_MESSY}) AS t FROM events)
 SELECT event_id, CASE WHEN lower(t) NOT IN {_TOKENS} THEN t END AS answer FROM m""")
def _tokens(spark, sf_dir):
    raw = spark.sql(f"SELECT event_id AS ` Event-ID `, {_MESSY} AS Answer FROM {{events}}",
                    events=table(spark, sf_dir, "events"))
    return standardize(raw).frame


_RAW = """
 lpad(CAST(event_id % 900 AS {text}), 4, '0') AS code,
 CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id % 77 AS {text}) END AS whole,
 CASE WHEN event_id % 8 = 0 THEN '' ELSE concat(CAST(event_id % 50 AS {text}), '.5') END AS half,
 CASE WHEN event_id % 7 = 0 THEN 'NULL' ELSE concat(CAST(event_id % 5 AS {text}), 'e1') END
  AS power,
 CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag,
 CASE WHEN event_id % 1000 = 999 THEN '12d' ELSE CAST(event_id AS {text}) END AS mixed,
 CASE WHEN event_id % 3 = 0 THEN 'NA' ELSE ' - ' END AS empty"""
_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_KINDS = ("code", "whole", "half", "power", "flag", "mixed", "empty")


@query("standardize_numeric_inference", f"""
 WITH r AS (SELECT {_RAW.format(text='VARCHAR')} FROM events),
 l AS (UNPIVOT r ON {', '.join(_KINDS)} INTO NAME column_name VALUE cell),
 c AS (SELECT column_name, CASE WHEN lower(trim(cell)) NOT IN {_TOKENS} THEN trim(cell) END AS v
       FROM l),
 k AS (SELECT column_name, count(v) AS non_null,
   coalesce(bool_and(regexp_full_match(v, '{_NUMBER}')), false) AS num,
   coalesce(bool_and(TRY_CAST(v AS DOUBLE) % 1 = 0), false) AS whole,
   coalesce(bool_and(lower(v) IN ('true', 'false')), false) AS flag,
   round(sum(CASE WHEN lower(v) = 'true' THEN 1.0 WHEN lower(v) = 'false' THEN 0.0
        WHEN regexp_full_match(v, '{_NUMBER}') THEN TRY_CAST(v AS DOUBLE) END), 6) AS s,
   count(DISTINCT CASE WHEN regexp_full_match(v, '{_NUMBER}') THEN
     CAST(TRY_CAST(v AS DOUBLE) AS VARCHAR) ELSE v END) AS values
   FROM c GROUP BY column_name)
 SELECT column_name, non_null, values AS distinct_values,
  CASE WHEN non_null = 0 THEN 'string' WHEN num AND whole THEN 'bigint' WHEN num THEN 'double'
   WHEN flag THEN 'bigint' ELSE 'string' END AS kind,
  CASE WHEN num OR flag THEN s END AS total FROM k""")
def _inference(spark, sf_dir):
    raw = spark.sql(f"SELECT {_RAW.format(text='STRING')} FROM {{events}}",
                    events=table(spark, sf_dir, "events"))
    result = standardize(raw)
    df, kinds = result.frame, result.dtypes
    facts = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("non_null"),
            F.count_distinct(c).alias("distinct_values"), F.lit(kinds[c]).alias("kind"),
            (F.round(F.sum(F.col(c).cast("double")), 6) if kinds[c] != "string"
             else F.lit(None).cast("double")).alias("total"),
        ).alias(c) for c in df.columns])
    return facts.select(F.explode(F.array(*df.columns)).alias("_f")).select("_f.*")


@query("unpivot_measures", with_(SV) + """
 , l AS (SELECT record_id, 'age' AS variable, CAST(age AS DOUBLE) AS value FROM sv
  UNION ALL SELECT record_id, 'household_size', household_size FROM sv
  UNION ALL SELECT record_id, 'income', income FROM sv
  UNION ALL SELECT record_id, 'working_hours', working_hours FROM sv)
 SELECT record_id, variable, round(value, 6) AS value FROM l""")
def _unpivot(spark, sf_dir):
    df = survey(spark, sf_dir)
    roles = detect_roles(df)
    long = unpivot_measures(df, [role_text(df, roles, "record_id")],
                            sorted(roles.numeric_measures))
    return long.withColumn("value", F.round("value", 6))


@query("observed_value_text", """
 SELECT o_orderkey, CAST(o_totalprice * 1000 AS VARCHAR) AS shown,
  CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS whole FROM orders""")
def _observed(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("big", F.col("o_totalprice") * 1000)
    return df.select(
        "o_orderkey", as_text(F.col("big"), df.schema["big"].dataType).alias("shown"),
        F.bround("o_totalprice").cast("bigint").cast("string").alias("whole"))


@query("column_names_cleaned", "SELECT c_custkey AS customer_key, c_name AS column, "
       "c_nationkey AS column_2 FROM customer")
def _names(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" Customer-Key "), F.col("c_name").alias("??"),
        F.col("c_nationkey").alias("--"))
    return df.toDF(*canonical_names(df.columns))
