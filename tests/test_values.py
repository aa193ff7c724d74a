import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import as_text, clean_cell, column_key, id_text, parse_number
from plumbline.operators.standardize import SchemaOptions, canonical_names, standardize


def cells(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_are_parsed_like_plain_decimals(spark):
    values = ["12", " 12.5 ", "+3", "-.5", "1e3", "12d", "1f", "nan", "inf", "0x1", "", None, "1_0"]
    expected = [12.0, 12.5, 3.0, -0.5, 1000.0] + [None] * 8
    assert cells(spark, values, parse_number) == expected


def test_missing_tokens(spark):
    values = ["", "  ", "NA", "n/a", "Null", "none", "NaN", "-", ".", " ok\t", None]
    assert cells(spark, values, clean_cell) == [None] * 9 + ["ok", None]
    assert cells(spark, [" a ", "nan", "None", "<NA>", ""], id_text) == ["a"] + [None] * 4


def test_doubles_print_plainly(spark):
    values = [1.0, 1e7, 12345678.5, 0.001, 0.00012, 1.5e-5, 1e16, -1e7, 123.456, -0.00015, 5e-324]
    df = spark.createDataFrame([(v, repr(v)) for v in values], "v double, p string")
    rows = df.select("p", as_text(F.col("v"), T.DoubleType()).alias("t")).collect()
    wrong = [(r["p"], r["t"]) for r in rows if r["p"] != r["t"] and "324" not in r["p"]]
    assert wrong == []


def test_names():
    assert column_key("  Working Hours (week) ") == "working_hours_week"
    assert column_key("??") == "column"
    assert canonical_names(["A", "a ", "b", "--", "?"]) == ["a", "a_2", "b", "column", "column_2"]
    assert canonical_names(["Hrs"], {"hrs": "working_hours"}) == ["working_hours"]


def test_types_are_inferred_for_whole_columns(spark):
    raw = spark.createDataFrame(
        [("001", "1.5", "True", "x", "NA", "2.0"), ("2", " ", "false", "1", None, "1e2")],
        "code string, half string, flag string, mixed string, gone string, whole string")
    result = standardize(raw)
    assert result.columns == ["code", "flag", "gone", "half", "mixed", "whole"]
    assert result.dtypes == {"code": "bigint", "flag": "bigint", "gone": "string",
                             "half": "double", "mixed": "string", "whole": "bigint"}
    assert [r.asDict() for r in result.frame.orderBy("code").collect()] == [
        {"code": 1, "flag": 1, "gone": None, "half": 1.5, "mixed": "x", "whole": 2},
        {"code": 2, "flag": 0, "gone": None, "half": None, "mixed": "1", "whole": 100}]
    kept = standardize(raw, SchemaOptions(drop_empty_columns=True, keep_text=("code",)))
    assert "gone" not in kept.columns and kept.dtypes["code"] == "string"


def test_csv_and_json_give_the_same_frame(spark, tmp_path):
    from plumbline.sources.readers import IngestError, ingest_csv, ingest_json
    import pytest

    (tmp_path / "a.csv").write_bytes(
        "﻿Respondent ID,Age,Notes\nR1, 34 ,NULL\nR2,N/A,ok\n".encode())
    (tmp_path / "a.json").write_text(
        '{"schema_version": "1", "records": [{"Respondent ID": "R1", "Age": 34, "Notes": null},'
        ' {"Respondent ID": "R2", "Age": null, "Notes": "ok", "x": null}]}')
    (tmp_path / "list.json").write_text('[{"Respondent ID": "R1", "Age": 34, "Notes": "n"}]')
    (tmp_path / "empty.csv").write_text("a,b\n")
    one = ingest_csv(spark, str(tmp_path / "a.csv"))
    two = ingest_json(spark, str(tmp_path / "a.json"), SchemaOptions(drop_empty_columns=True))
    assert one.dtypes == {"age": "bigint", "notes": "string", "respondent_id": "string"}
    assert two.columns == one.columns
    assert sorted(map(tuple, one.frame.collect()), key=str) == sorted(
        map(tuple, two.frame.collect()), key=str)
    assert ingest_json(spark, str(tmp_path / "list.json")).frame.count() == 1
    with pytest.raises(IngestError):
        ingest_csv(spark, str(tmp_path / "empty.csv"))


def test_nan_becomes_null(spark):
    from plumbline.operators.standardize import json_safe

    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, float("nan"), float("inf")]}))
    assert [r["a"] for r in json_safe(df).collect()] == [1.0, None, None]
