import hashlib
import random

import numpy as np

from plumbline.llm import lz
from tests.llm.helpers import AWKWARD, prose, table


def phrases(text):
    seen, run = set(), ""
    for c in text:
        run += c
        if run not in seen:
            seen.add(run)
            run = ""
    return seen


def test_phrases_of_both_texts():
    pick = random.Random(1)
    for _ in range(500):
        a, b = ("".join(pick.choice("abé中") for _ in range(pick.randrange(50))) for _ in "12")
        own, other, text = lz.both_phrases(a, b)
        keep = len(a) - len(a) // 3
        assert text == a[:keep] + b[:len(a) // 3]
        assert len(set(own.tolist())) == len(phrases(a)) and len(set(other.tolist())) == len(phrases(text))
        assert set(other.tolist()) == set(lz.phrase_hashes(text, lz.parse(text)[0]).tolist())


def test_likeness_estimates_shared_phrases():
    a, b = prose(1, 900), prose(1, 900)[:4000] + prose(2, 300)
    x, y = phrases(a), phrases(b)
    got = lz._rows([(2, a, b), (1, b, "")], 64)
    assert abs(got["near_next"][0] - len(x & y) / len(x | y)) < 0.2


def test_neighbours_and_edits(spark, monkeypatch):
    monkeypatch.setattr(lz, "RANGES_ROWS", 10)
    rows = [(7 * i, prose(i % 70, 5 + i % 40), "en", "s") for i in range(150)] + AWKWARD
    got = {}
    for r in lz.fingerprints(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(((d is None, -(d or 0), t or "", d) for d, t, *_ in rows))
    seen = {}
    for (_, _, text, d), following in zip(order, order[1:] + order[:1]):
        tail = following[2]
        edit = text[:len(text) - len(text) // 3] + tail[:len(text) // 3]
        sha = hashlib.sha256(edit.encode()).hexdigest()
        mine = [r for r in got[d] if r.n_chars == len(text) and r.edited_sha256 == sha]
        assert mine, (d, len(text))
        r = mine[0]
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == "") == (text == "")
        want = lz._rows([(d, text, tail)], lz.COORDINATES)
        assert (r.near_edited, r.near_next) == (want["near_edited"][0], want["near_next"][0])
        if len(text) > 100 and d is not None and d < 900:
            assert r.near_edited > r.near_next or text == tail
    assert sum(len(v) for v in got.values()) == len(rows)
    assert not lz.fingerprints(table(spark, [])).collect()


def test_one_row_follows_itself(spark):
    r, = lz.fingerprints(table(spark, [(5, "abcabcabc", "en", "s")])).collect()
    assert r.near_next == 1.0 and r.n_chars == 9
    assert r.edited_sha256 == hashlib.sha256(b"abcabcabc").hexdigest()
    assert np.isclose(r.near_edited, 1.0)
