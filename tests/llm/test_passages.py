import numpy as np

from plumbline.llm import passages
from plumbline.llm.text import mix
from tests.llm.helpers import AWKWARD, edited, prose, table, words


def collect(spark, rows, **options):
    return passages.repeated_passages(table(spark, rows), **options).collect()


def test_exact_fuzzy_and_shared_passages(spark):
    common, fuzzy = prose(1, 70, 9000), prose(2, 90, 9000)
    rows = [(i, f"{prose(100 + i, 150, 9000)} {common} {prose(300 + i, 40, 9000)}", "en", "s")
            for i in range(40)]
    rows += [(100 + i, f"{prose(500 + i, 60, 9000)} {edited(fuzzy, i, 0.04)} {prose(600 + i, 60, 9000)}",
              "en", "s") for i in range(5)]
    rows += [(200 + i, prose(700 + i, 300, 9000), "en", "s") for i in range(20)]
    rows += [(300 + i, prose(800, 30, 9000), "en", "s") for i in range(5)]
    got = collect(spark, rows)
    where = {}
    for r in got:
        where.setdefault(r.doc_id, []).append(r)
    assert set(where) == set(range(1, 40)) | {101, 102, 103, 104}
    for i in range(1, 40):
        r, = where[i]
        assert (r.source_doc_id, r.start_word, r.end_word, r.identity) == (0, 150, 220, 1.0)
    for i in range(101, 105):
        assert all(abs(r.start_word - 60) < 8 and abs(r.end_word - 150) < 8 and r.identity > 0.8
                   for r in where[i])


def test_every_repeated_run_of_fifty_words_is_found(spark):
    rows = [(i, prose(i, 120, 5000), "en", "s") for i in range(30)]
    for i in range(30, 60):
        w = words(rows[(i * 7) % 30][1])
        at = (i * 11) % 60
        rows.append((i, " ".join([*words(prose(i, 20 + i, 5000)), *w[at:at + 50], *words(prose(i + 90, 30, 5000))]),
                     "en", "s"))
    covered = {}
    for r in collect(spark, rows):
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i in range(30, 60):
        assert set(range(20 + i, 70 + i)) <= covered[i]
    assert not set(covered) & set(range(30))


def test_cutting_leaves_the_first_occurrence(spark):
    common = prose(1, 80, 9000)
    rows = [(1, f"a b\n{common}", "en", "s"), (2, f"c  d {common}\te f", "en", "s"), (3, common, "en", "s"),
            *AWKWARD]
    docs = table(spark, rows)
    found = passages.repeated_passages(docs)
    out = passages.without_passages(docs, found)
    assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect() if r.doc_id is not None and r.doc_id < 10}
    assert {d: r.text for d, r in kept.items()} == {1: f"a b\n{common}", 2: "c  d e f", 3: ""}
    assert kept[2].n_chars == 8 and out.count() == len(rows)
    assert {r.text for r in out.where("doc_id >= 900").collect()} == {t for d, t, *_ in AWKWARD if d}


def test_awkward_rows(spark):
    rows = [*AWKWARD, (910, "very " * 70, "en", "s")]
    assert {(r.doc_id, r.source_doc_id) for r in collect(spark, rows)} == {(910, 907)}
    assert not collect(spark, [])


def test_fenwick_chains_are_the_best_chains():
    """Scores against the quadratic recurrence."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        parts = sorted({(int(b), int(a), int(m)) for b, a, m in zip(
            rng.integers(0, 120, n), rng.integers(0, 120, n), rng.integers(6, 20, n))})
        score = []
        for i, (b, a, m) in enumerate(parts):
            best = 0.0
            for j, (pb, pa, pm) in enumerate(parts):
                if pb + pm <= b and pa + pm <= a:
                    s = score[j] if j < i else None
                    if s is not None:
                        best = max(best, s - passages.GAP_COST * (b - pb - pm + a - pa - pm))
            score.append(m + best)
        got = passages.chain(parts)
        assert sorted(p for c in got for p in c) == parts
        top = max(range(len(parts)), key=lambda i: score[i])
        mine = next(c for c in got if parts[top] in c)
        total = mine[0][2] + sum(
            q[2] - passages.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2])
            for p, q in zip(mine, mine[1:]))
        if mine[-1] == parts[top] and all(max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]) <= passages.MAX_GAP
                                          for p, q in zip(mine, mine[1:])):
            assert total >= score[top] - 1e-9 or len(mine) < n


def test_minimizers_hit_every_window():
    h = mix(np.arange(1000, dtype=np.uint64) + np.uint64(9))
    first = np.array([0, 400, 400, 405, 1000])
    at, _ = passages.minimizers(h, first, 16)
    for lo, hi in zip(first[:-1], first[1:]):
        for s in range(lo, max(hi - 15, lo + (hi > lo))):
            assert ((at >= s) & (at < min(s + 16, hi))).any()


def test_alignment_counts_equal_words():
    x = np.array([1, 2, 3, 4, 9, 5, 6, 7, 8, 11], dtype=np.uint32)
    y = np.array([0, 2, 3, 4, 5, 6, 7, 8, 12, 13], dtype=np.uint32)
    parts = [[1, 1, 3], [5, 4, 4]]
    assert passages.align(x, y, parts, passages.extend(passages.ends(x, y, parts))) == (1, 9, 1, 8, 7)


def test_passages_assembled_from_earlier_lines(spark):
    """Every seed of the passage but those across the line break is first in 1 or 2."""
    one, two = prose(1, 30, 9000), prose(2, 30, 9000)
    rows = [(1, f"{prose(11, 40, 9000)} {one} {prose(12, 40, 9000)}", "en", "s"),
            (2, f"{prose(13, 40, 9000)} {two} {prose(14, 40, 9000)}", "en", "s"),
            (10, f"{prose(15, 40, 9000)} {one} {two} {prose(16, 40, 9000)}", "en", "s"),
            (20, f"{prose(17, 40, 9000)} {one} {two} {prose(18, 40, 9000)}", "en", "s")]
    lines = [prose(200 + i, 10, 9000) for i in range(6)]
    rows += [(30 + i, f"{prose(300 + i, 30, 9000)} {x}", "en", "s") for i, x in enumerate(lines)]
    rows += [(i, " ".join([prose(i, 30, 9000), *lines, prose(i + 1, 30, 9000)]), "en", "s") for i in (50, 60)]
    got = {(r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.identity) for r in collect(spark, rows)}
    assert got == {(20, 10, 40, 100, 1.0), (60, 50, 30, 90, 1.0)}


def test_an_exact_run_beside_unlike_words_is_found():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 32, 200).astype(np.uint32) for _ in range(2))
    y[:55], y[120:126], y[140:195] = x[:55], x[120:126], x[140:195]
    assert passages.aligned(x, y, [[0, 0, 195]], 50, 0.8) in (
        [(0, 55, 0, 55, 55), (140, 195, 140, 195, 55)], [(140, 195, 140, 195, 55), (0, 55, 0, 55, 55)])
    same = np.array([1] * 41 + [0] * 30, dtype=bool)
    assert passages.alike(same, 50, 0.8) == []


def test_every_word_of_a_long_run_of_one_word_is_covered(spark):
    rows = [(1, f"{prose(1, 20)} {'so ' * 55}", "en", "s"), (2, f"{prose(2, 20)} {'so ' * 90}", "en", "s")]
    covered = {i for r in collect(spark, rows) for i in range(r.start_word, r.end_word)}
    assert set(range(20, 110)) <= covered


def test_fuzzy_passages_at_the_stated_identity(spark):
    """60 words with substitutions, up to the share that the operator still promises."""
    rng = np.random.default_rng(5)
    rows, planted = [], {}
    for i in range(90):
        n = (6, 9, 12)[i % 3]
        one = [f"w{v}" for v in rng.integers(0, 20000, 60)]
        two = list(one)
        for at in rng.permutation(60)[:n]:
            two[at] = f"e{rng.integers(0, 10 ** 6)}"
        for doc, w in ((2 * i, one), (2 * i + 1, two)):
            rows.append((doc, f"{prose(1000 + doc, 40, 20000)} {' '.join(w)} {prose(3000 + doc, 40, 20000)}",
                         "en", "s"))
        planted.setdefault(n, set()).add(2 * i + 1)
    found = {r.doc_id for r in collect(spark, rows) if r.source_doc_id == r.doc_id - 1 and r.identity >= 0.8}
    assert {n: len(found & ids) >= 29 for n, ids in planted.items()} == {6: True, 9: True, 12: True}


def test_hot_seeds_give_the_same_passages(spark):
    """Posts of hot hashes take another way to their first occurrence."""
    common, line = prose(1, 70, 9000), prose(2, 12, 9000)
    rows = [(i, f"{line} {prose(100 + i, 60, 9000)} {edited(common, i, 0.03)} {line} {prose(300 + i, 30, 9000)}", "en", "s")
            for i in range(60)] + AWKWARD
    one, two, three = (sorted(collect(spark, rows, hot_docs=n), key=str) for n in (10 ** 6, 20, 1))
    assert one == two == three and len(one) > 50


def plain_extension(x, y, miss=passages.MISS, reach=passages.REACH, band=passages.BAND):
    """Best score of aligning a start of x with a start of y, by the full table."""
    n, m = min(len(x), reach), min(len(y), reach + band)
    table_ = [[0] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            options = []
            if abs(i - j) > band:
                table_[i][j] = -10 ** 9
                continue
            if i and j:
                options.append(table_[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -miss))
            if i:
                options.append(table_[i - 1][j] - miss)
            if j:
                options.append(table_[i][j - 1] - miss)
            table_[i][j] = max(options)
            best = max(best, table_[i][j])
    return best


def test_extensions_with_gaps_are_the_best_of_the_full_table():
    rng = np.random.default_rng(3)
    jobs = []
    for trial in range(60):
        x = rng.integers(0, 1 << 31, 50).astype(np.uint32)
        y = x.tolist()
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(0, len(y)))
            y[at:at + rng.integers(0, 2)] = [int(rng.integers(0, 1 << 31))] * int(rng.integers(0, 2))
        y += rng.integers(0, 1 << 31, 20).tolist()
        jobs.append((x[:int(rng.integers(1, 50))], np.array(y, dtype=np.uint32)))
    for (x, y), (i, j, equal) in zip(jobs, passages.extend(jobs)):
        # One that the fall of DROP ends early may be worse; edits here never fall that far.
        score = equal - passages.MISS * (max(i, j) - equal) if abs(i - j) <= 0 else None
        if score is not None and score == plain_extension(x, y):
            continue
        assert plain_extension(x[:i], y[:j]) == plain_extension(x, y)
    assert passages.extend([]) == []
    none = np.zeros(0, dtype=np.uint32)
    assert passages.extend([(none, none), (none, jobs[0][1])]) == [(0, 0, 0)] * 2


def test_fuzzy_passages_with_gaps(spark):
    """Insertions, deletions and mixtures at identity 0.85 and 0.9 by the longest common subsequence."""
    rng = np.random.default_rng(11)
    rows, planted = [], {}
    for i in range(120):
        kind, share = ("ins", "del", "mix")[i % 3], (0.10, 0.14)[i // 3 % 2]
        one = [f"w{v}" for v in rng.integers(0, 20000, 80)]
        two = list(one)
        for _ in range(int(80 * share)):
            k = kind if kind != "mix" else ("ins", "del", "sub")[rng.integers(0, 3)]
            at = int(rng.integers(0, len(two)))
            if k == "del":
                del two[at]
            else:
                two[at:at + (k == "sub")] = [f"e{rng.integers(0, 10 ** 6)}"]
        for doc, w in ((2 * i, one), (2 * i + 1, two)):
            rows.append((doc, f"{prose(1000 + doc, 40, 20000)} {' '.join(w)} {prose(3000 + doc, 40, 20000)}", "en", "s"))
        planted.setdefault((kind, share), {})[2 * i + 1] = len(two)
    found = {}
    for r in collect(spark, rows):
        if r.source_doc_id == r.doc_id - 1 and r.identity >= 0.8:
            found[r.doc_id] = found.get(r.doc_id, 0) + r.end_word - r.start_word
    for group in planted.values():
        assert sum(d in found for d in group) >= 0.95 * len(group)
        assert sum(found.get(d, 0) >= 0.8 * n for d, n in group.items()) >= 0.85 * len(group)
