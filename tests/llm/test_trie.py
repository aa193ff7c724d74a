import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from plumbline.llm import trie
from plumbline.llm.queries import SQL
from tests.llm.helpers import words

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("path", "words", "n", "base", "head", "key", "skeleton", "shard", "digest"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def expected(rows):
    held = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            tie = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            held[c].append(((t is not None, t or 0), tie, (r, x)))
    held = {c: [v[2] for v in sorted(turns)] for c, turns in held.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        path = tuple(held.get(base, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        return [p, *[q for k in kids[p] for q in under(k)]]

    out = []
    for p, m in members.items():
        below = under(p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]),
                    sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(words(q[-1][1])) for q in below if q),
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in trie.COLUMNS) for r in df.collect()), key=str)


def talk(seed, convs, turns, variety):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.randrange(turns + 1)):
            rows.append((c, t, ("user", "assistant")[t % 2], f"line {pick.randrange(variety)} of it"))
    return rows


AWKWARD = [
    (None, 1, "user", "no id"), (-3, None, None, None), (-3, 2, "user", ""), (7, None, "a", "b"), (7, None, "ab", ""),
    (7, 1, "x", "y" * 50000), (7, 1, "x", "y" * 50000), (45, 1, "user", "only"), (66, 5, "system", "  spaced\tout \n "),
]


@pytest.mark.parametrize("cuts,parts", [(16384, 1), (3, 1), (40, 1), (0, 10)])
def test_equals_the_plain_trie(spark, cuts, parts):
    rows = talk(cuts, 300, 6, 3) + AWKWARD
    df = trie.prefix_trie(table(spark, rows), shard_paths=parts, max_splitters=cuts)
    assert got(df) == expected(rows)


def test_long_hot_and_equal_conversations(spark):
    rows = [(40, t, "user", f"w{t} x") for t in range(300)]
    rows += [(c, t, "user", f"w{t} x") for c in range(100, 400) for t in range(4)]
    rows += [(c, t, "user", f"w{t} x") for c in range(500, 520) for t in range(40)]
    assert got(trie.prefix_trie(table(spark, rows), shard_paths=5)) == expected(rows)


def test_equals_the_sql_version(spark):
    rows = talk(9, 120, 5, 2) + AWKWARD
    base = duckdb.connect()
    conversations = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    base.sql("CREATE TABLE conversations AS SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, role, text FROM conversations")
    sql = next(v for k, v in SQL.items() if k.startswith("op12_"))
    names = ", ".join(trie.COLUMNS)
    found = [tuple(r) for r in base.sql(f"SELECT {names} FROM ({sql})").fetchall()]
    assert sorted(found, key=str) == expected(rows)


def test_empty_tables(spark):
    assert not trie.prefix_trie(table(spark, [])).collect()
    assert not trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).collect()


def test_ends_of_many_members_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    rows = [(c, 0, "u", "same") for c in range(1000, 1100)] + [(c, 1, "u", "same") for c in range(1000, 1100)]
    assert got(trie.prefix_trie(table(spark, rows))) == expected(rows)
