"""Expressions over survey answers: employment, signatures, missing cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import as_text, is_numeric, strip, to_number

NOT_WORKING = "unemploy|nilf|not working|inactive"


def field_text(df: DataFrame, name: str) -> Column:
    """Lower-case trimmed answer, empty when missing."""
    text = as_text(F.col(name), df.schema[name].dataType)
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def field_number(df: DataFrame, name: str) -> Column:
    return to_number(F.col(name), df.schema[name].dataType)


def employed(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("employ") & ~low.contains("unemploy")


def unemployed(text: Column) -> Column:
    return F.lower(text).contains("unemploy")


def not_working(lower_text: Column) -> Column:
    return lower_text.rlike(NOT_WORKING)


def missing_cells(columns: list[str]) -> Column:
    flags = [F.col(c).isNull().cast("int") for c in columns]
    return reduce(lambda a, b: a + b, flags) if flags else F.lit(0)


def _band(number: Column, step: int) -> Column:
    return (F.floor(number / F.lit(step)) * step).cast("long").cast("string")


def signature(df: DataFrame, fields: list[str]) -> Column:
    """One text per record; ages, hours and incomes in bands, joined by pipes."""
    parts = []
    for name in fields:
        dtype = df.schema[name].dataType
        text = as_text(F.col(name), dtype)
        number = field_number(df, name)
        if name == "income":
            label, value = "income", F.coalesce(_band(number, 5000), text)
        elif name in ("working_hours", "hours"):
            nearest = (F.bround(number / F.lit(5.0), 0) * 5).cast("long").cast("string")
            value = nearest if is_numeric(dtype) else F.coalesce(nearest, text)
            label = None
        elif name == "age":
            label, value = "age", F.coalesce(_band(number, 5), text)
        else:
            label, value = name, F.lower(strip(text))
        if label is None:
            # Hours that are no number keep their own column name as the label.
            tag = F.when(number.isNotNull(), "hours:").otherwise(f"{name}:")
        else:
            tag = F.lit(f"{label}:")
        parts.append(F.when(text.isNull(), F.lit(f"{name}:")).otherwise(F.concat(tag, value)))
    return F.concat_ws("|", *parts)
