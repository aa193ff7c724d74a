from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import near_dup
from plumbline.llm.common import components
from tests.llm.helpers import AWKWARD, edited, prose, table, words


def brute(rows, k, percent):
    sets = {}
    for d, text, *_ in rows:
        w = words(text)
        sets[d] = frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in posted[s])
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for s in sets[d]:
            posted[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_all_pairs(spark, k):
    rows = []
    for g in range(12):
        base = prose(g, 80 + 10 * g)
        rows += [(100 * g + i, edited(base, i, 0.01 * i), "en", "s") for i in range(9)]
        rows += [(100 * g + 50, base.upper(), "en", "s"), (100 * g + 51, prose(1000 + g, 60), "en", "s")]
    rows += [(5000 + i, f"short {i % 3}", "en", "s") for i in range(9)]
    got = near_dup.near_duplicates(table(spark, rows), shingle_words=k).collect()
    want = brute(rows, k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert 20 < sum(r.kept for r in got) < len(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "POSTING_BLOCK", 8)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 8)
    base = prose(3, 120)
    rows = [(i, edited(base, i, 0.004 * (i % 40)), "en", "s") for i in range(120)]
    got = near_dup.near_duplicates(table(spark, rows), shingle_words=2).collect()
    want = brute(rows, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rows_without_an_id_link_others(spark):
    """1 and 2 are each like a row without an id, but not like each other; near copies without
    ids are one class of their own."""
    base = prose(1, 200).split(" ")
    ends = [" ".join(base[:90] + [f"{x}{i}" for i in range(9)] + base[99:]) for x in "ab"]
    left, right = " ".join([f"p{i}" for i in range(20)] + base[20:]), " ".join(base[:180] + [f"q{i}" for i in range(20)])
    middle = " ".join(base)
    other = [prose(7, 150), edited(prose(7, 150), 1, 0.02)]
    rows = [(1, left, "en", "s"), (2, right, "en", "s"), (None, middle, "en", "s"), (None, ends[0], "en", "s"),
            *[(None, t, "en", "s") for t in other], (9, prose(8, 90), "en", "s")]
    assert brute([(1, left), (2, right)], 2, 80)[2][1] == 2
    assert {v[1] for v in brute([(1, left), (2, right), (3, middle)], 2, 80).values()} == {1}
    got = near_dup.near_duplicates(table(spark, rows), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 9: 9}
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [
        (0, True), (0, True), (1, False), (1, False)]


def test_awkward_rows(spark):
    got = near_dup.near_duplicates(table(spark, AWKWARD), shingle_words=2).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[d].n_shingles for d in (901, 902, 903)] == [0, 0, 0]
    assert [by[d].component_id for d in (901, 902, 903, 904, 905)] == [901, 902, 903, 904, 904]
    assert not by[905].kept and by[907].n_shingles == 1
    assert [r.kept for r in got if r.doc_id is None] == [True, True]
    empty = near_dup.near_duplicates(table(spark, []))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and not empty.collect()


def test_components_of_a_long_chain_and_a_star(spark):
    pick = np.random.default_rng(1).permutation(300)
    edges = [(int(pick[i]), int(pick[i + 1])) for i in range(0, 149)] + [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    chain = {int(x) for x in pick[:150]}
    assert all(got[x] == min(chain) for x in chain)
    assert all(got[x] == 1000 for x in range(1000, 1200)) and len(got) == 350
