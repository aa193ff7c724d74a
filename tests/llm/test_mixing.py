from collections import defaultdict

import duckdb
import pytest

from plumbline.llm import mixing
from plumbline.llm.queries import SQL
from tests.llm.helpers import AWKWARD, SCHEMA, prose, table, words


def rows_of(sizes):
    """{source: sizes of its documents}"""
    out, i = [], 0
    for source, each in sizes.items():
        for n in each:
            out.append((i, prose(i, n), "en", source))
            i += 1
    return out


@pytest.mark.parametrize("sizes", [
    {"a": [100] * 30, "b": [50] * 10, "c": [7] * 4, None: [300]},
    {"a": [1000], "b": [1], "c": [0, 0], "d": [20] * 50},
    {"only": [3, 4, 5]},
    {"a": [0, 0], "b": [0]},
])
def test_equals_the_sorted_version(spark, sizes):
    rows = rows_of(sizes)
    names = ("size", "source_size", "target", "taken", "copies", "part_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in mixing.mix(table(spark, rows)).collect()}
    base = duckdb.connect()
    documents = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).toPandas()  # noqa: F841
    base.sql("CREATE TABLE documents AS SELECT * FROM documents")
    sql = next(v for k, v in SQL.items() if k.startswith("op5_"))
    assert got == {d: tuple(v) for d, *v in base.sql(f"SELECT doc_id, {', '.join(names)} FROM ({sql})").fetchall()}
    taken, target = defaultdict(int), {}
    for d, _, _, source in rows:
        taken[source] += got[d][3]
        target[source] = got[d][2]
    assert all(0 <= target[s] - taken[s] < 2 for s in taken)
    assert all(n <= 3 * size for size, _, _, n, *_ in got.values())


def test_thresholds_are_nested_and_reruns_agree(spark):
    docs = table(spark, rows_of({"a": [20] * 60, "b": [20] * 60}))
    got = []
    for share in (1, 2, 4, 8):
        w = spark.createDataFrame([("a", share), ("b", 20)], "source string, weight bigint")
        got.append({r.doc_id: r.taken for r in mixing.mix(docs, w).where("source = 'a'").collect()})
    for low, high in zip(got, got[1:]):
        assert all(low[d] <= high[d] for d in low) and sum(low.values()) < sum(high.values())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7), w).where("source = 'a'").collect()}
    assert again == got[-1]


def test_mixed_rows_hold_the_words_taken(spark):
    rows = rows_of({"a": [40] * 20, "b": [5] * 5, "c": [9] * 3}) + AWKWARD
    rows += [(5000 + i, "  xD 0x ñ\n9-x\tD,x 20 09 " * (5 + i), "en", "b") for i in range(9)]
    docs = table(spark, rows)
    taken = mixing.mix(docs).groupBy().sum("taken").first()[0]
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sum(len(words(r.text)) for r in kept) == taken
    text = {r[0]: r[1] for r in rows}
    assert all((text[r.doc_id] or "").startswith(r.text or "") for r in kept if r.doc_id is not None)
    assert any(r.text != text[r.doc_id] for r in kept)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    assert sum(r.text is None for r in kept) == 2


def test_awkward_rows(spark):
    got = mixing.mix(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.taken <= 3 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[903] == 0
    assert not mixing.mix(table(spark, [])).collect()
    assert not mixing.mixed_rows(table(spark, [])).collect()
