"""Quality by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of what its whole text measures. Weights come
from preference pairs (a good document over a bad one) by logistic loss on feature
differences; a quantile of the scores of all labelled documents is the threshold.
Every labelled document outside the held-out fold is learned from: knots and threshold
are exact quantiles over all of them, and each is in at least one pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.order_stats import exact_quantiles, rank_table
from plumbline.functions.sequences import running_sum
from plumbline.llm.common import arrow_batches, map_batches, need, written
from plumbline.llm.linear import fold, labelled, newton_over, sigmoid, sums_over
from plumbline.llm.text import Words, shingles, words
from plumbline.plans.lookup import maybe_in
from plumbline.plans.workers import ship

ship(__name__)
PAIRS = 40_000  # at least; more where there are more documents of a label
BUCKETS = 256
THRESHOLD = 0.3
KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
_KINDS = np.zeros((7, 256), dtype=np.int32)
for _row, _of in enumerate((
        range(65, 91), range(97, 123), range(48, 58), b".,;:?'\"()-", b"!#$%&*|<>{}[]=+/\\@^~_`",
        range(128, 256), b"\n")):
    _KINDS[_row, list(_of)] = 1


def features(w: Words) -> np.ndarray:
    """One row per text: shares of byte kinds, shapes of words, and repetition."""
    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[at[1:]] - total[at[:-1]]

    count = np.diff(w.first).astype(float)
    some = np.maximum(count, 1)
    size = np.maximum(np.diff(w.offsets), 1)
    kinds = np.stack([per_text(k[w.data], w.offsets) for k in _KINDS])
    length = w.end - w.start
    last = w.data[w.end - 1] if len(w.end) else w.data[:0]
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    marks = _KINDS[4][w.data]
    mark_total = np.concatenate([[0], np.cumsum(marks)])
    marked = (mark_total[w.end] - mark_total[w.start]) > 0
    mean = per_text(length, w.first) / some
    columns = [
        np.log1p(count), mean, np.sqrt(np.maximum(per_text(length ** 2, w.first) / some - mean ** 2, 0)),
        *(kinds / size), kinds[0] / np.maximum(kinds[0] + kinds[1], 1), kinds[6] / some,
        per_text(same, w.first) / some, per_text(length <= 3, w.first) / some,
        per_text(length >= 15, w.first) / some, per_text(marked, w.first) / some,
        per_text(_KINDS[3][last], w.first) / some,
    ]
    spread = np.zeros((4, w.texts))
    runs = [shingles(w, k) for k in (1, 2, 4)]
    for i in range(w.texts):
        for r, (h, first) in enumerate(runs):
            mine = h[first[i]:first[i + 1]]
            if len(mine):
                new, n = np.unique(mine, return_counts=True)
                spread[r, i] = len(new) / len(mine)
                if r == 0:
                    spread[3, i] = n.max() / len(mine)
    return np.column_stack([*columns, *spread])


def hinges(x: np.ndarray, knots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each feature and its excess over each knot, so that weights bend along it."""
    parts = [x[:, :, None], np.maximum(x[:, :, None] - knots[None], 0)]
    return np.concatenate(parts, axis=2).reshape(len(x), -1) / scale


def stacked(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of a batch as a matrix."""
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def column_quantiles(known: DataFrame, probs: tuple[float, ...]) -> np.ndarray:
    """Exact quantiles of every feature over all rows, a row per feature."""
    values = known.select(F.posexplode("x").alias("i", "v"))
    ranks = rank_table(values, "i", "v")
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("total") - 1)).alias("at"))
                       for k, p in enumerate(probs)])
    # A wanted place lies between two ranks, each of which one value holds.
    ends = F.explode(F.flatten(F.transform(places, lambda s: F.array(
        F.struct(s["k"].alias("k"), s["at"].alias("at"), (F.floor(s["at"]) + 1).alias("rank")),
        F.struct(s["k"].alias("k"), s["at"].alias("at"), (F.ceil(s["at"]) + 1).alias("rank"))))))
    hits = ranks.select("i", "v", "first_rank", "last_rank", ends.alias("e")).where(
        F.col("e.rank").between(F.col("first_rank"), F.col("last_rank"))).select("i", "v", "e.*").collect()
    out = np.zeros((1 + max(r["i"] for r in hits), len(probs)))
    near = {(r["i"], r["k"], r["rank"]): r["v"] for r in hits}
    for r in hits:
        low = near[r["i"], r["k"], math.floor(r["at"]) + 1]
        high = near[r["i"], r["k"], math.ceil(r["at"]) + 1]
        out[r["i"], r["k"]] = low + (high - low) * (r["at"] - math.floor(r["at"]))
    return out


def paired(known: DataFrame, good: int, bad: int, least: int = PAIRS) -> DataFrame:
    """(won, lost): features of pairs of a good and a bad document, every document in at
    least one; pairs are dealt in turn by the documents' numbers, which follow a hash."""
    round_ = math.lcm(good, bad)  # so many pairs differ before the turns shift by one
    deal = known.sparkSession.range(max(least, good, bad)).select(
        (F.col("id") % good).alias("g"), F.expr(f"(id + id div {round_}L) % {bad}").alias("b"))
    won = known.where("label = 1").select((F.col("_n") - 1).alias("g"), F.col("x").alias("won"))
    lost = known.where("label = 0").select((F.col("_n") - 1).alias("b"), F.col("x").alias("lost"))
    return deal.join(won, "g").join(lost, "b").select("won", "lost")


def fit(rows: DataFrame, pairs: int = PAIRS) -> dict | None:
    """A ranking from all rows (label, _h, x); None where a label has no document.

    ``_h`` orders the rows. Every step is a pass over stored rows that sums on the way.
    """
    known = written(running_sum(
        rows.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS))), ["label"], "_bucket", ["_h", "x"],
        F.lit(1), "_n").select("label", "x", "_n"), "quality_rows")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        return None
    knots = column_quantiles(known, KNOTS)
    plain = np.ones(1)

    def moments(b: pa.RecordBatch) -> list[np.ndarray]:
        raw = hinges(stacked(b, "x"), knots, plain) - middle
        return [raw.sum(axis=0), (raw ** 2).sum(axis=0)]

    # Sums around the mean, which takes a pass of its own, keep small spreads.
    middle = np.zeros(knots.size + len(knots))
    middle = sums_over(known, moments)[0] / (good + bad)
    scale = np.maximum(np.sqrt(sums_over(known, moments)[1] / (good + bad)), 1e-9)

    def differences(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        wins = hinges(stacked(b, "won"), knots, scale) - hinges(stacked(b, "lost"), knots, scale)
        return wins, np.ones(len(wins))

    w = newton_over(written(paired(known, good, bad, pairs), "quality_pairs"), differences, len(scale), ridge=10.0)
    scores = written(map_batches(known.select("label", "x"), lambda b: {
        "label": b.column("label"), "s": hinges(stacked(b, "x"), knots, scale) @ w,
    }, "label int, s double"), "quality_ranked")
    cut = exact_quantiles(scores, {"s": F.col("s")}, [bad / (good + bad)])["s"][0]

    def margins(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        s = b.column("s").to_numpy(zero_copy_only=False) - cut
        return np.column_stack([s, np.ones(len(s))]), b.column("label").to_numpy(zero_copy_only=False).astype(float)

    slope = newton_over(scores, margins, 2)[0]
    return {"knots": knots, "scale": scale, "weights": w, "cut": cut, "slope": max(float(slope), 0.05)}


def score(x: np.ndarray, model: dict | None, threshold: float = THRESHOLD) -> np.ndarray:
    """0 to 1; the quantile cut has the score ``threshold``."""
    if model is None:
        return np.full(len(x), 0.5)
    s = hinges(x, model["knots"], model["scale"]) @ model["weights"]
    return sigmoid(model["slope"] * (s - model["cut"]) + np.log(threshold / (1 - threshold)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every whole text."""
    arrow_batches(docs.sparkSession)
    return map_batches(need(docs, "doc_id", "text"), lambda b: {
        "doc_id": b.column("doc_id"),
        "x": [r.tolist() for w in words(b.column("text")) for r in features(w)],
    }, "doc_id bigint, x array<double>")


def learn(held: DataFrame, labels: DataFrame, folds: int | None = 5, held_out: int = 0) -> dict | None:
    """A model from all labelled rows of stored ``measured`` documents outside the held-out fold."""
    keep = F.lit(True) if folds is None else fold("doc_id", folds) != held_out
    rows = held.join(labelled(labels, "quality", keep), "doc_id").select(
        F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id", "quality").alias("_h"), "x")
    return fit(rows)


def train(docs: DataFrame, labels: DataFrame, folds: int | None = 5, held_out: int = 0) -> dict | None:
    """``learn`` where only labelled documents need be measured."""
    some, _ = maybe_in(need(docs, "doc_id", "text"), need(labels, "doc_id"), "doc_id")
    return learn(written(measured(some), "quality_features"), labels, folds, held_out)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    A null text is an empty one and has a score. With no labelled pair to learn from
    every score is 0.5. Only ``doc_id`` and ``text`` are read, and measured once.
    """
    held = written(measured(docs), "quality_features")
    model = learn(held, labels, folds, held_out)
    scored = map_batches(held, lambda b: {
        "doc_id": b.column("doc_id"), "score": score(stacked(b, "x"), model, threshold),
    }, "doc_id bigint, score double")
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.concatenate([score(features(w), model, threshold) for w in words(b.column(at))])
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
