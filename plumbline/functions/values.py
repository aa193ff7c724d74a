"""Column expressions for messy cells: missing tokens, numbers, ids, text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import MISSING_TOKENS

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
EDGE_SPACE = r"^\s+|\s+$"
NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def strip(c: Column) -> Column:
    """Drop every kind of white space at both ends, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def strip_cell(c: Column) -> Column:
    """``strip`` for a plain column, which it names several times: a pattern costs far more
    than two comparisons, which most cells pass."""
    bare = (F.substring(c, 1, 1) > " ") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(strip(c))


def clean_cell(c: Column) -> Column:
    """Trimmed text, or null for any missing token."""
    text = strip_cell(c)
    return F.when(~F.lower(text).isin(*MISSING_TOKENS), text)


def finite(c: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parse_number(text: Column) -> Column:
    """Plain decimal text as double; anything else null. Never fails under ANSI."""
    return stripped_number(strip(text))


def stripped_number(text: Column) -> Column:
    """``parse_number`` of text that has no white space at its ends."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_number(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    return parse_number(c.cast("string"))


def _plain_double(c: Column) -> Column:
    """A double as the shortest plain text: 10000000.0, not 1.0E7."""
    text = c.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(text, r"([0-9.]+)E", 1), r"\.", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    significant = F.regexp_replace(digits, r"0+$", "")
    head = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    tail = F.regexp_replace(F.substring(digits, power + 2, F.length(digits)), r"0+$", "")
    large = F.concat(sign, head, F.lit("."), F.when(tail == "", "0").otherwise(tail))
    small = F.concat(sign, F.lit("0.000"), significant)
    mantissa = F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(significant) > 1,
               F.concat(F.lit("."), F.substring(significant, F.lit(2), F.length(significant))))
        .otherwise(""),
    )
    exponent = F.concat(
        F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    # Two digits at least; longer exponents keep all of theirs.
    exponent = F.when(F.abs(power) > 99,
                      F.concat(F.when(power < 0, "-").otherwise("+"),
                               F.abs(power).cast("string"))).otherwise(exponent)
    scientific = F.concat(sign, mantissa, F.lit("e"), exponent)
    return (
        F.when(~text.contains("E"), text)
        .when((power >= 0) & (power < 16), large)
        .when(power == -4, small)
        .otherwise(scientific)
    )


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Value as text; NaN and infinities are null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _plain_double(finite(c.cast("double")))
    return c.cast("string")


def id_text(c: Column) -> Column:
    """Identifier as text; blank and textual nulls are null."""
    t = strip_cell(c.cast("string"))
    return F.when(~t.isin("", "nan", "None", "<NA>"), t)


def column_key(name: object) -> str:
    """The letters and digits of a name, lower-case, in runs joined by underscores."""
    return "_".join(re.findall("[a-z0-9]+", str(name).lower())) or "column"
