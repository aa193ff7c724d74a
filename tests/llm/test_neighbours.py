import numpy as np
import pytest

from plumbline.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, n string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good.items()
                          if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_lists_agree_with_all_distances(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(400)]
    got = neighbours.nearest(frame(spark, rows), k=10, every=50, leaf_rows=128).collect()
    want = brute(rows, 10, 50)
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(lists) == set(want)
    hits = sum(len({i for _, i in lists[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(len(v) for v in want.values())
    # Copies: all ten at distance 0, smallest ids first.
    assert lists[3000] == [(0.0, 7)] + [(0.0, i) for i in range(3001, 3010)]
    exact = {q: dict((i, d) for d, i in brute(rows, 4000, 50)[q]) for q in list(want)[:5]}
    assert all(d == exact[q][i] for q in exact for d, i in lists[q])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]),
            (500, [inf, 1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]), (700, []), (1, [1.0, 0.0]),
            (1, [1.0, 0.0]), (2, [2.0, 0.0]), (800, [1.0, 2.0, 3.0])]
    got = neighbours.nearest(frame(spark, rows)).collect()
    lists = {q: [(r.vec_id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
             for q in {r.query_id for r in got}}
    assert lists == {0: [(1, 1), (2, 2), (100, 3)], 100: [(0, 1), (1, 2), (2, 3)]}
    assert not neighbours.nearest(frame(spark, [])).collect()


@pytest.mark.parametrize("m", [1, 2, 5, 8])
def test_chi_square_law(m):
    draws = (np.random.default_rng(m).normal(size=(200_000, m)) ** 2).sum(axis=1)
    for x in (0.5, 2.0, 6.0, 15.0):
        assert abs(float(neighbours.chi_square(np.array(x), m)) - (draws <= x).mean()) < 0.005
    assert abs(float(neighbours.chi_square(neighbours.stop_ratio(0.9, m), m)) - 0.9) < 1e-6


def test_leaf_boxes_bound_distances():
    x = np.random.default_rng(2).normal(size=(500, 3))
    tree = neighbours.grow(x, 4)
    leaf, box = tree.leaves(x), tree.box_distances(x)
    assert (box[np.arange(500), leaf] == 0).all() and len(set(leaf)) == 16
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for b in range(16):
        assert (box[:, b] <= apart[:, leaf == b].min(axis=1) + 1e-12).all()
