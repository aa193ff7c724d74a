"""Run registered queries next to their SQL in DuckDB and compare values.

    python -m tests.oracle_check [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import time

import duckdb
import pandas as pd

from plumbline.catalog import registry
from plumbline.plans.session import session

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    ordered = df[sorted(df.columns)]
    out = []
    for values in ordered.itertuples(index=False, name=None):
        cells = []
        for v in values:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
                cells.append("NULL")
            elif isinstance(v, (bool,)) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif isinstance(v, float):
                cells.append(repr(float(v) + 0.0))
            elif hasattr(v, "isoformat"):
                cells.append(pd.Timestamp(v).isoformat())
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark_df, expected: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    kinds = {c: t for c, t in spark_df.dtypes}
    found = spark_df.toPandas()
    # Nullable integers come back as floats from either side; show them alike.
    for c, t in kinds.items():
        if t in ("bigint", "int", "smallint", "tinyint"):
            found[c] = found[c].astype("Int64").astype(object).where(found[c].notna(), None)
            if c in expected:
                if not pd.api.types.is_integer_dtype(expected[c]) and expected[c].notna().any() \
                        and not pd.api.types.is_float_dtype(expected[c]):
                    return f"{c}: {t} against {expected[c].dtype}"
                expected[c] = expected[c].astype("Int64").astype(object).where(
                    expected[c].notna(), None)
        elif t == "double" and c in expected and pd.api.types.is_integer_dtype(expected[c]):
            return f"{c}: double against {expected[c].dtype}"
    if sorted(found.columns) != sorted(expected.columns):
        return f"columns {sorted(found.columns)} against {sorted(expected.columns)}"
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    a, b = rows(found), rows(expected)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    sf_dir = f"{TESTDATA}/sf{args.sf}"
    spark = session("oracle-check", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = registry.load()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                expected = con.execute(sql[name]).df()
                problem = compare(df, expected)
                note = f"{len(expected)} rows"
            else:
                problem, note = None, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s "
              f"{note} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
