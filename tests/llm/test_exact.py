import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact
from tests.llm.helpers import AWKWARD, prose, table


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    out = []
    for r in rows:
        t = fold(r[1])
        keep = max((i for i in groups[t] if i is not None), default=None)
        out.append((r[0], keep, len(groups[t]), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


ROWS = [
    *[(i, prose(i % 40, 60).upper() if i % 3 else prose(i % 40, 60), "en", "s") for i in range(120)],
    *[(1000 + i, "The SAME text", "en", "hot") for i in range(400)],
    (2000, "É", "fr", "s"), (2001, "é", "fr", "s"), (2002, "ÉA", "fr", "s"), (2003, "Éa", "fr", "s"),
    (2004, "a", "en", "s"), (2005, "a ", "en", "s"), (2006, "Straße İI", "de", "s"), (2007, "straße İi", "de", "s"),
    (None, "nobody's", "en", "s"), (None, "Nobody's", "en", "s"), (None, "the same text", "en", "s"),
]


@pytest.mark.parametrize("capacity", [exact.BUCKET_BYTES, 64])
def test_equals_grouping_by_text(spark, capacity):
    rows = ROWS + AWKWARD
    assert got(exact.exact_duplicates(table(spark, rows), capacity)) == expected(rows)


@pytest.mark.parametrize("key", ["7L", "pmod(xxhash64(t), 5)", "bigint(length(t))"])
def test_different_texts_of_one_hash_are_chained(spark, key):
    """Hashes that collide leave chains, of hot and of other keys, told apart by bytes."""
    out = exact.exact_duplicates(table(spark, ROWS), 256, key).cache()
    assert got(out) == expected(ROWS)
    assert out.agg(F.max("chain")).first()[0] > 2
    assert out.groupBy("text_sha256").agg(F.countDistinct("chain").alias("n")).where("n > 1").count() == 0


def test_buckets_are_split_only_where_they_are_overfull(spark):
    """Depths against an extendible hash table that splits one bucket at a time."""
    depth, capacity = 6, 100
    held = {i: (i * 37) % 23 if i % 5 else 0 for i in range(64)} | {3: 500, 40: 90, 41: 90}
    keys = spark.createDataFrame([((i << 58) - (1 << 64) * (i >= 32) + 5, n) for i, n in held.items() if n],
                                 "h bigint, bytes bigint")
    buckets, todo = {}, [(0, 0)]
    while todo:
        start, bits = todo.pop()
        width = 1 << (depth - bits)
        if sum(held[i] for i in range(start, start + width)) <= capacity or bits == depth:
            buckets |= {i: (start, bits) for i in range(start, start + width)}
        else:
            todo += [(start, bits + 1), (start + width // 2, bits + 1)]
    found = {r.slot: (r.bucket, r.bits) for r in exact.directory(keys, depth, capacity).collect()}
    assert found == {i: buckets[i] for i in range(64) if held[i]}


def test_empty_table_and_native_plan(spark):
    out = exact.exact_duplicates(table(spark, []))
    assert not out.collect()
    plan = exact.exact_duplicates(table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
