"""Language identification by sparse multinomial logistic regression.

Character n-grams (1 to 3 bytes of the lower-cased text, white space as one blank)
are hashed into buckets and weighted by TF-IDF, with document frequencies over all
learning documents. Weights are learned by follow-the-regularised-leader with
elastic-net penalties on a bounded sample per language, then a temperature
calibrates the probabilities on rows kept from the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, map_batches, need
from plumbline.llm.linear import fold
from plumbline.llm.text import chunks, mix
from plumbline.plans.workers import ship

ship(__name__)
BUCKETS = 1 << 13
ROWS_PER_LANGUAGE = 500
UNDETERMINED = "und"
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x09, 0x0E)]] = 0x20
_FOLD[48:58] = 48


def gram_counts(texts: pa.Array, buckets: int = BUCKETS):
    """(index, bucket ids, counts) of each text."""
    for at, data, offsets in chunks(texts):
        x = _FOLD[data].astype(_U)
        two = (x[:-1] << _U(8)) | x[1:]
        three = (two[:-1] << _U(8)) | x[2:]
        codes = [(mix(g + _U(n << 32)) % _U(buckets)).astype(np.int32)
                 for n, g in ((1, x), (2, two), (3, three))]
        for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            parts = [c[lo:max(hi - n, lo)] for n, c in enumerate(codes)]
            count = np.bincount(np.concatenate(parts), minlength=buckets)
            ids = np.flatnonzero(count)
            yield at + i, ids, count[ids]


def weighted(ids: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[ids]
    return v / max(float(np.sqrt(v @ v)), 1e-12) if len(v) else v


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Documents per bucket over all rows; a task sends one row per bucket, the driver
    gets ``buckets`` numbers."""
    def run(batches):
        total, n = np.zeros(buckets, dtype=np.int64), 0
        for b in batches:
            for _, ids, _ in gram_counts(b.column("text"), buckets):
                total[ids] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([*at, -1], pa.int32()),
                                          "n": pa.array([*total[at], n], pa.int64())})

    got = need(docs, "text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n"))
    out, n = np.zeros(buckets, dtype=np.int64), 0
    for bucket, count in (tuple(r) for r in got.collect()):
        if bucket < 0:
            n = count
        else:
            out[bucket] = count
    return out, n


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, buckets: int,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3,
         epochs: int = 4) -> np.ndarray:
    """Weights (buckets + 1, classes); the last row is the bias."""
    z = np.zeros((buckets + 1, classes))
    n = np.zeros((buckets + 1, classes))
    order = np.random.default_rng(3)

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1)
                        / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            ids, v = rows[r]
            at, value = np.append(ids, buckets), np.append(v, 1.0)
            w = weights(at)
            p = softmax(value @ w)
            p[label[r]] -= 1
            g = value[:, None] * p[None]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(slice(None))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits under which the held-back labels are likeliest."""
    if not len(label):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, buckets: int = BUCKETS, rows: int = ROWS_PER_LANGUAGE) -> dict | None:
    """A model of the languages in ``docs`` (text, lang, doc_id); None without any.

    The fit takes at most ``rows`` documents per language, those of smallest id hash;
    every fifth of them only calibrates. Document frequencies cover all rows.
    """
    arrow_batches(docs.sparkSession)
    docs = need(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    df, total = document_frequencies(docs, buckets)
    by = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = (docs.select("doc_id", "lang").withColumn("n", F.row_number().over(by))
              .where(F.col("n") <= rows))
    sample = need(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "lang", "n")

    def run(b: pa.RecordBatch) -> dict:
        grams = list(gram_counts(b.column("text"), buckets))
        return {"lang": b.column("lang"), "n": b.column("n"), "ids": [g[1].tolist() for g in grams],
                "count": [g[2].tolist() for g in grams]}

    got = map_batches(sample, run, "lang string, n int, ids array<int>, count array<int>").toArrow()
    got = got.sort_by([("n", "ascending"), ("lang", "ascending")])
    if not got.num_rows:
        return None
    langs = sorted(set(got.column("lang").to_pylist()))
    label = np.array([langs.index(x) for x in got.column("lang").to_pylist()])
    idf = np.log((1 + total) / (1 + df)) + 1
    grams = [(np.array(i, dtype=np.int32), weighted(np.array(i, dtype=np.int32), np.array(c), idf))
             for i, c in zip(_lists(got, "ids"), _lists(got, "count"), strict=True)]
    back = got.column("n").to_numpy() % 5 == 0
    fit = [i for i in range(len(grams)) if not back[i]] or list(range(len(grams)))
    w = ftrl([grams[i] for i in fit], label[fit], len(langs), buckets)
    held = [i for i in range(len(grams)) if back[i]]
    logits = np.array([grams[i][1] @ w[grams[i][0]] + w[-1] for i in held]).reshape(len(held), -1)
    return {"langs": langs, "idf": idf, "weights": w, "temperature": temperature(logits, label[held])}


def _lists(table: pa.Table, name: str):
    for chunk in table.column(name).chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield values[lo:hi]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row; ``und`` with score 0 for null texts, texts
    without a letter, and where there is no model."""
    arrow_batches(docs.sparkSession)
    buckets = len(model["idf"]) if model else BUCKETS

    def run(b: pa.RecordBatch) -> dict:
        lang, score = [], []
        texts = b.column("text")
        known = [model is not None and has_letter(t) for t in texts.to_pylist()]
        for i, ids, count in gram_counts(texts, buckets):
            if not known[i]:
                lang.append(UNDETERMINED)
                score.append(0.0)
                continue
            x = weighted(ids, count, model["idf"]) @ model["weights"][ids] + model["weights"][-1]
            p = softmax(x / model["temperature"])
            best = int(np.argmax(p))
            lang.append(model["langs"][best])
            score.append(float(p[best]))
        return {"doc_id": b.column("doc_id"), "lang_pred": lang, "score": score}

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def languages(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, learned outside the held-out fold.

    Rows of null lang are predicted but teach nothing; an empty table gives no rows.
    """
    model = train(docs.where(fold("doc_id", folds) != held_out))
    return identify(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
