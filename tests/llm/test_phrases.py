import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import phrases
from tests.llm.helpers import AWKWARD, prose, table


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def expected(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = defaultdict(int)
    for (lang, *w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[(lang, *w[i:i + m])] = max(a, inside[(lang, *w[i:i + m])])
    out = []
    for (lang, *w), a in cand.items():
        if 100 * inside[(lang, *w)] >= 80 * a:
            continue
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    pick = random.Random(3)
    stock = ["in spite of", "new york city", "San Jose", "a b c d e", "of the", "à côté de", "word"]
    rows = []
    for i in range(240):
        parts = []
        for _ in range(30):
            parts += [pick.choice(stock), *(f"v{pick.randrange(40)}" for _ in range(pick.randrange(3))),
                      pick.choice([" ", ".", ", ", "\t", "\n", " "])]
        rows.append((i, " ".join(parts), pick.choice(["en", "fr", None, "und"]), "s"))
    return rows + [(900 + i, "the very same line of text again and again. " * 3, "en", "s") for i in range(80)]


@pytest.mark.parametrize("owner_suffixes,pair_cells", [(1 << 19, 1 << 24), (50, 1 << 16), (7, 1 << 16)])
def test_equals_counting_all_phrases(spark, owner_suffixes, pair_cells):
    rows = corpus() + AWKWARD
    df = phrases.collocations(table(spark, rows, 7), owner_suffixes=owner_suffixes, pair_cells=pair_cells)
    assert got(df) == expected(rows)


def test_limit_and_other_parameters(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 100)
    rows = corpus()
    assert got(phrases.collocations(table(spark, rows), least=5, top=9)) == expected(rows, 5, 9)


def test_nothing_to_find(spark):
    assert not phrases.collocations(table(spark, [])).collect()
    assert not phrases.collocations(table(spark, [(1, prose(1, 50, 10 ** 6), "en", "s"), (2, None, None, None)])).collect()


def test_quicksort_finds_equal_runs_and_gives_up_rare_ones():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 4, (3000, 4)).astype(np.uint64)
    keys[rng.random(3000) < 0.2, 3] = 0
    n = rng.integers(1, 5, 3000)
    want = Counter()
    for row, w in zip(keys.tolist(), n.tolist()):
        for d in (2, 3, 4):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    for least in (1, 30, 200):
        found = {tuple(keys[at, :d].tolist()): w for at, d, w in
                 phrases.quicksort(keys, np.zeros(3000, dtype=bool), n, least)}
        assert found == {k: v for k, v in want.items() if v >= least}


def test_scores_are_exact_beyond_64_bits(spark):
    """2000000 * a passes 2**63; counts are given, not counted."""
    big = 10 ** 15 + 7
    some = spark.createDataFrame([(1, 2, 0, 0, big), (1, 3, 0, 0, 40)], "w0 bigint, w1 bigint, w2 bigint, w3 bigint, a bigint")
    known = spark.createDataFrame([(1, "en", "x", 3 * big), (2, "en", "y", big + 5), (3, "en", "z", 41)],
                                  "w0 bigint, lang string, word string, a bigint")
    out = {tuple(r.key): (r.l, r.r, r.score) for r in phrases._scored(phrases._whole(some), some, known).collect()}
    assert out == {(1, 2): (3 * big, big + 5, 2000000 * big // (4 * big + 5)), (1, 3): (3 * big, 41, 0)}
