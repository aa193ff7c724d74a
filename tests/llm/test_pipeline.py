"""The pipeline against plain versions of its decisions."""

import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import quality
from plumbline.llm.common import written
from plumbline.llm.text import words as word_spans
from tests.llm.helpers import words
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import token_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage kept, in turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return [{"frame": d, "rows": d.collect()} for d in out]


def test_columns_stay_until_the_last_stage(kept):
    for k in kept[1:-1]:
        assert k["frame"].columns == kept[0]["frame"].columns
        assert all(r.n_chars == len(r.text) for r in k["rows"])


def test_quality_rejects_by_score(spark, kept):
    model = quality.train(kept[0]["frame"], spark.read.parquet(f"{SF}/labels.parquet"), folds=None)
    want = set()
    for r in kept[0]["rows"]:
        w, = word_spans(pa.array([r.text]))
        if quality.score(quality.features(w), model)[0] >= quality.THRESHOLD:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept[1]["rows"]} == want
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & want) <= 0.1 * len(bad)


def test_one_of_each_near_duplicate_group_stays(kept):
    groups = brute([(r.doc_id, r.text) for r in kept[1]["rows"]], 5, 80)
    assert {r.doc_id for r in kept[2]["rows"]} == {d for d, (_, c) in groups.items() if c == d}


def test_repeated_passages_are_cut(kept):
    before, after = ({r.doc_id: r.text for r in k["rows"]} for k in kept[2:4])
    assert set(before) == set(after)
    seen, left = set(), 0
    for d in sorted(after):
        w = words(after[d])
        mine = {tuple(w[i:i + 50]) for i in range(len(w) - 49)}
        left += len(mine & seen)
        seen |= mine
    assert left == 0
    # Nothing but words that an earlier document has goes.
    runs = set()
    for d in sorted(before):
        w = words(before[d])
        if after[d] != before[d]:
            lost = Counter(w) - Counter(words(after[d]))
            known = {x for i in range(len(w) - 5) if tuple(w[i:i + 6]) in runs for x in w[i:i + 6]}
            assert sum(n for x, n in lost.items() if x not in known) <= 0.2 * sum(lost.values())
        runs |= {tuple(w[i:i + 6]) for i in range(len(w) - 5)}


def test_sources_reach_their_targets(kept):
    size, got = Counter(), Counter()
    for r in kept[3]["rows"]:
        size[r.source] += len(words(r.text))
    for r in kept[4]["rows"]:
        got[r.source] += len(words(r.text))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    target, capped = {}, set()
    while True:
        unit = ((sum(size.values()) - sum(3 * size[s] for s in capped))
                / sum(weight[s] for s in size if s not in capped))
        target = {s: 3 * size[s] if s in capped else unit * weight[s] for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert {s: round(got[s] - target[s]) for s in size if not 0 <= target[s] - got[s] < 2} == {}


def test_packs_hold_the_mixed_rows(kept):
    rows = {}
    for r in kept[4]["rows"]:
        rows.setdefault(r.doc_id, []).append(r.text)
    once = {d: t[0] for d, t in rows.items() if len(t) == 1}
    packs = defaultdict(int)
    for r in kept[5]["rows"]:
        packs[r.sequence_id] += r.length
    assert max(packs.values()) <= 1024
    assert Counter(r.doc_id for r in kept[5]["rows"] if r.start == 0) == {d: len(t) for d, t in rows.items()}
    ids = token_ids(once)
    for r in kept[5]["rows"]:
        if r.doc_id in once:
            part = ids[r.doc_id][r.start:r.start + r.length]
            assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(part.tobytes()))


def test_awkward_column_names_stay(spark):
    """A dot in a name, and the name that the stages might use themselves."""
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, text, 1, "a"), (2, text, 2, "b"), (3, f"x {text} y", 3, None), (None, None, 4, "d")],
        "doc_id bigint, text string, `_` int, `a.b` string")
    deduped = corpus_pipeline.near_dedup(spark, docs, SF)
    assert deduped.columns == docs.columns
    assert {(r.doc_id, r["_"], r["a.b"]) for r in deduped.collect()} == {(1, 1, "a"), (None, 4, "d")}
    cut = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert cut.columns == docs.columns
    assert {r["_"]: (r.text, r["a.b"]) for r in cut.collect()} == {1: (text, "a"), 2: ("", "b"), 3: ("x y", None), 4: (None, "d")}
