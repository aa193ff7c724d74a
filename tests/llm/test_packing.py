import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing
from tests.llm.helpers import AWKWARD, prose, table


def token_ids(texts):
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: np.array([*code.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
            for d, t in texts.items()}


def check(got, texts, length):
    ids = token_ids(texts)
    by, packs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        packs[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            part = ids[d][r.start:r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[d]), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids[d])
    for rows in packs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return packs


def test_every_id_is_in_one_piece(spark):
    rows = [(i, prose(i, random.Random(i).randrange(0, 900)), "en", "s") for i in range(120)]
    packs = check(packing.pack(table(spark, rows)).collect(), {r[0]: r[1] for r in rows}, 1024)
    total = sum(r.length for p in packs.values() for r in p)
    assert total >= 0.97 * 1024 * (len(packs) - 1)


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    rows = rows[:8] + rows[9:]  # a repeated row is tested below
    check(packing.pack(table(spark, rows)).collect(), {r[0]: r[1] for r in rows}, 1024)
    got = packing.pack(table(spark, AWKWARD)).collect()
    assert Counter(r.doc_id for r in got)[904] == 2
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert not packing.pack(table(spark, [])).collect()


def test_histogram_packs_hold_all_lengths():
    for seed in range(30):
        pick = random.Random(seed)
        counts = Counter(pick.randrange(1, 65) for _ in range(pick.randrange(0, 400)))
        packs = packing.pack_histogram(dict(counts), 64)
        seen = Counter()
        for pattern, n in packs:
            assert sum(pattern) <= 64 and n > 0
            for size in pattern:
                seen[size] += n
        assert seen == counts
        if counts:
            assert sum(n for _, n in packs) <= 1.25 * sum(k * v for k, v in counts.items()) / 64 + 1


def test_added_tokens_are_one_id_wherever_they_stand(spark):
    """As the vocabulary file has it: at the start, middle and end, doubled, and cut by a letter."""
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark} x", f"x{mark}", f"é{mark}{mark}中", f"<|endof text|> {mark[:-1]}",
             f"<|endoftexto|>{mark}1", f"  {mark}\n\n{mark}  "]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = packing.pack(table(spark, rows)).collect()
    check(got, dict(enumerate(texts)), 1024)
    assert packing.added_tokens(packing.VOCABULARY) == {mark: 50256}
