"""Compare the training-data queries that have SQL with DuckDB: python -m tests.llm.check_sql [sf] [name ...]"""

import sys
import time

from plumbline.llm.queries import QUERIES, SQL
from plumbline.plans.session import session
from tests.oracle_check import TESTDATA, compare, connect


def main() -> None:
    sf_dir = f"{TESTDATA}/sf{(sys.argv[1:] or ['0.01'])[0]}"
    spark = session("sql-check", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[2:] or SQL:
        start = time.time()
        expected = con.execute(SQL[name]).df()
        between = time.time()
        print(name, compare(QUERIES[name](spark, sf_dir), expected) or "ok", len(expected), "rows",
              f"SQL {between - start:.1f} s, Spark {time.time() - between:.1f} s", flush=True)


if __name__ == "__main__":
    main()
