"""Raw text table -> canonical table: names, missing cells, inferred types."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import SCHEMA_VERSION
from plumbline.functions.values import (
    NUMBER, as_text, clean_cell, column_key, is_numeric, stripped_number,
)

BOOLEAN_TEXT = ("true", "false")
LONG_LIMIT = float(2**63)


@dataclass(frozen=True)
class Standardized:
    frame: DataFrame
    columns: list[str]
    dtypes: dict[str, str]
    schema_version: str = SCHEMA_VERSION


@dataclass(frozen=True)
class SchemaOptions:
    schema_version: str = SCHEMA_VERSION
    drop_empty_columns: bool = False
    aliases: dict[str, str] = field(default_factory=dict)
    keep_text: tuple[str, ...] = ()


def canonical_names(names: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Clean names, apply aliases, number repeats from 2 on."""
    renamed = dict(aliases or {})
    keys = [renamed.get(k, k) for k in map(column_key, names)]
    places = defaultdict(lambda: count(1))
    numbered = [(k, next(places[k])) for k in keys]
    return [k if n == 1 else f"{k}_{n}" for k, n in numbered]


def _cells(df: DataFrame) -> list[Column]:
    """Every column as cleaned text."""
    return [
        clean_cell(as_text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name)
        for f in df.schema.fields
    ]


def _whole(c: Column) -> Column:
    number = stripped_number(c)
    return (number % 1 == 0) & (F.abs(number) < LONG_LIMIT)


def infer_types(text: DataFrame) -> dict[str, str | None]:
    """bigint, double, boolean or string per column, None for no values.

    One aggregate over the table; a single row reaches the driver.
    """
    checks = []
    for i, c in enumerate(text.columns):
        cell = F.col(c)
        checks += [
            F.count(cell).alias(f"n{i}"),
            F.coalesce(F.bool_and(cell.rlike(NUMBER)), F.lit(False)).alias(f"num{i}"),
            F.coalesce(F.bool_and(_whole(cell)), F.lit(False)).alias(f"int{i}"),
            F.coalesce(F.bool_and(F.lower(cell).isin(*BOOLEAN_TEXT)), F.lit(False))
            .alias(f"bool{i}"),
        ]
    row = text.agg(*checks).first()
    kinds: dict[str, str | None] = {}
    for i, c in enumerate(text.columns):
        if not row[f"n{i}"]:
            kinds[c] = None
        elif row[f"num{i}"]:
            kinds[c] = "bigint" if row[f"int{i}"] else "double"
        elif row[f"bool{i}"]:
            kinds[c] = "boolean"
        else:
            kinds[c] = "string"
    return kinds


def _typed(c: str, kind: str | None) -> Column:
    cell = F.col(c)
    if kind == "bigint":
        # Plain digits stay exact; 1e3 or 2.0 go through double.
        exact = F.when(cell.rlike(r"^[+-]?\d+$"), cell.try_cast("bigint"))
        return F.coalesce(exact, stripped_number(cell).try_cast("bigint")).alias(c)
    if kind == "double":
        return stripped_number(cell).alias(c)
    if kind == "boolean":
        return (F.lower(cell) == "true").cast("bigint").alias(c)
    return cell.alias(c)


def standardize(raw: DataFrame, options: SchemaOptions = SchemaOptions()) -> Standardized:
    if not raw.columns:
        raise ValueError("dataset has no columns")
    named = raw.toDF(*canonical_names(raw.columns, options.aliases))
    text = named.select(*_cells(named)).select(*sorted(named.columns))
    kinds = infer_types(text)
    for c in options.keep_text:
        if c in kinds:
            kinds[c] = "string"
    kept = [c for c in text.columns if not (options.drop_empty_columns and kinds[c] is None)]
    frame = text.select(*[_typed(c, kinds[c]) for c in kept])
    return Standardized(frame, frame.columns, dict(frame.dtypes), options.schema_version)


def unpivot_measures(df: DataFrame, ids: list[Column], measures: list[str]) -> DataFrame:
    """(ids, variable, value): one scan for all measures instead of one each."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    keep = [c for c in wide.columns if c not in measures]
    return wide.unpivot(keep, measures, "variable", "value")


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    from plumbline.functions.values import finite

    return df.select(*[
        finite(F.col(f.name)).alias(f.name)
        if is_numeric(f.dataType) and isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ])
