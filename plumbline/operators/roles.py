"""Which column plays which part in a survey table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import CONCEPT_CANDIDATES, ROLE_CANDIDATES
from plumbline.functions.values import as_text, column_key, is_numeric


@dataclass(frozen=True)
class Roles:
    record_id: str | None
    enumerator_id: str | None
    cluster_id: str | None
    district_id: str | None
    numeric_measures: tuple[str, ...]
    categoricals: tuple[str, ...]

    @property
    def identifiers(self) -> tuple[str, ...]:
        ids = (self.record_id, self.enumerator_id, self.cluster_id, self.district_id)
        return tuple(c for c in ids if c)

    def column(self, role: str) -> str | None:
        return getattr(self, role)

    @property
    def scopes(self) -> dict[str, str]:
        """Group scope -> column, for the groupings this table has."""
        pairs = {
            "enumerator": self.enumerator_id,
            "cluster": self.cluster_id,
            "district": self.district_id,
        }
        return {k: v for k, v in pairs.items() if v}


def _best_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The column of the foremost candidate; an equal name beats one that only agrees
    in its letters and digits, a later column an earlier one."""
    runs = {name: column_key(name).replace("_", "") for name in [*columns, *candidates]}
    hits = [
        (place, name.lower() != candidate, -at, name)
        for place, candidate in enumerate(candidates)
        for at, name in enumerate(columns)
        if name.lower() == candidate or runs[name] == runs[candidate]
    ]
    return min(hits)[-1] if hits else None


def detect_roles(df: DataFrame) -> Roles:
    found = {role: _best_column(df.columns, names) for role, names in ROLE_CANDIDATES.items()}
    taken = set(found.values())
    numbers = {f.name: is_numeric(f.dataType) for f in df.schema.fields if f.name not in taken}
    return Roles(
        **found,
        numeric_measures=tuple(n for n, number in numbers.items() if number),
        categoricals=tuple(n for n, number in numbers.items() if not number),
    )


def concept(df: DataFrame, name: str) -> str | None:
    """Column holding a survey concept; exact, case-insensitive names only."""
    exact = {c.lower(): c for c in df.columns}
    return next((exact[c] for c in CONCEPT_CANDIDATES[name] if c in exact), None)


def role_text(df: DataFrame, roles: Roles, role: str) -> Column:
    name = roles.column(role)
    if not name:
        return F.lit(None).cast("string").alias(role)
    return as_text(F.col(name), df.schema[name].dataType).alias(role)


def id_columns(df: DataFrame, roles: Roles) -> list[Column]:
    """record_id, enumerator_id, cluster_id, district_id as text, null kept."""
    return [role_text(df, roles, role) for role in ROLE_CANDIDATES]


def eligible_measures(
    roles: Roles, profiled_numeric: set[str] | None = None
) -> list[str]:
    """Numeric measures; with a stored profile, only those numeric there too."""
    return [m for m in roles.numeric_measures
            if profiled_numeric is None or m in profiled_numeric]


def measure_matrix(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Measures as doubles; an absent column becomes a null column."""
    from plumbline.functions.values import to_number

    cells = [
        (to_number(F.col(n), df.schema[n].dataType) if n in df.columns
         else F.lit(None).cast("double")).alias(n)
        for n in names
    ]
    return df.select(*(keep or []), *cells)


def row_order(df: DataFrame, roles: Roles, order: str | None = None) -> Column:
    """What "first record" means: a given column, else the record id as text."""
    if order:
        return F.col(order)
    if roles.record_id:
        return F.col(roles.record_id).cast("string")
    return F.xxhash64(*df.columns)
