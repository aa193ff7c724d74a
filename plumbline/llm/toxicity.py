"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: look-alike letters of other scripts and digits or signs
inside words become the letters they stand for. The lexicon is learned from labelled
documents: folded words and beginnings of words that toxic documents hold far more
often than clean ones, weighted by that log ratio. A word counts once, by the
heaviest entry. Exception phrases (given, or learned as pairs in which a listed word
is harmless) cancel the matches inside them. The sum of the weights, absolute and by
length, gives the score through a logistic curve.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, map_batches, need, written
from plumbline.llm.linear import fold, labelled_sample, newton, sigmoid
from plumbline.llm.text import min_hashes, shingles, words
from plumbline.plans.workers import ship

ship(__name__)
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
LEAST_TOXIC = 5
LEAST_RATIO = 1.5
STEMS = range(4, 10)
# Phrases in which a listed word is no insult.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "white trash bag")
# Look-alike letters of Cyrillic and Greek, and signs used as letters.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝкмтвнαοενικρτυχηωβμ",
    "aeopcyxijshdqwkmtbhaoevikptyxnwbu")
SIGNS = str.maketrans("013457@$!|+", "oieastasiit")
_INNER = re.compile(r"(?<=[^\W_])[@$!|+](?=[^\W_])")
_TOKEN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"[0-9]")


def fold_tokens(text: str) -> list[str]:
    """Folded words of a text. ``l`` and ``i`` are one letter, since 1 stands for both;
    a word without letters keeps its digits."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.casefold()).translate(LOOK_ALIKES)
    else:
        text = text.lower()
    if any(c in text for c in "@$!|+"):
        text = _INNER.sub(lambda m: m[0].translate(SIGNS), text)
    tokens = _TOKEN.findall(text)
    if _DIGIT.search(text):
        tokens = [t if t.isdigit() or t.isalpha() else t.translate(SIGNS) for t in tokens]
    return [t.replace("l", "i") for t in tokens]


def _entries(batch: pa.RecordBatch) -> dict:
    """Distinct words (between blanks) and beginnings (after a blank) of each text,
    counted over the batch."""
    toxic, every = Counter(), Counter()
    for y, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
        found = set()
        for word in set(text.split()):
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in STEMS if n < len(word))
        every.update(found)
        if y:
            toxic.update(found)
    return {"entry": list(every), "toxic": [toxic[e] for e in every], "n": list(every.values())}


def _shortest(weight: dict[str, float]) -> dict[str, float]:
    """Entries that are no lighter than every beginning of theirs that is listed."""
    return {e: w for e, w in sorted(weight.items())
            if all(weight.get(e[:n], 0) < w for n in range(5, len(e)))}


def automaton(model: dict) -> ahocorasick.Automaton | None:
    """Entries of the lexicon, and exception phrases between blanks."""
    if not model["weights"]:
        return None
    machine = ahocorasick.Automaton()
    for entry, w in model["weights"].items():
        machine.add_word(entry, (len(entry), w))
    for phrase in model["exceptions"]:
        machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
    machine.make_automaton()
    return machine


def evidence(folded: list[str], machine: ahocorasick.Automaton | None) -> np.ndarray:
    """log of the weight sum, weight by length, and log of the number of matches."""
    out = np.zeros((len(folded), 3))
    for i, text in enumerate(folded if machine else []):
        hits, safe = {}, []
        for end, (size, w) in machine.iter(f" {text} "):
            start = end - size + 1
            if w is None:
                safe.append((start, end))
            elif hits.get(start, 0) < w:
                hits[start] = w
        if safe:
            hits = {p: w for p, w in hits.items() if not any(a <= p < b for a, b in safe)}
        total = sum(hits.values())
        n = text.count(" ") + 1
        out[i] = np.log1p(total), total / np.sqrt(n + 20.0), np.log1p(len(hits))
    return out


def score(folded: list[str], model: dict | None, machine: ahocorasick.Automaton | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(folded))
    x = evidence(folded, machine) / model["scale"]
    return sigmoid(np.column_stack([x, np.ones(len(x))]) @ model["curve"])


def folded_sample(docs: DataFrame, labels: DataFrame, folds: int | None = 3, held_out: int = 1,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, text) of at most ``sample_rows`` labelled documents outside the held-out
    fold, folded. Near copies count once: of rows with one label whose three-word
    shingles have one minimum hash, that of the smallest id stays.
    """
    arrow_batches(docs.sparkSession)
    keep = F.lit(True) if folds is None else fold("doc_id", folds) != held_out
    sample = labelled_sample(docs, labels, "toxic", keep, sample_rows)
    rows = map_batches(sample, lambda b: {
        "doc_id": b.column("doc_id"), "label": b.column("label"),
        "copy": [int(min_hashes([h[lo:hi]], 1)[0, 0]) for w in words(b.column("text"))
                 for h, first in [shingles(w, 3)]
                 for lo, hi in zip(first[:-1], first[1:], strict=True)],
        "text": [" ".join(fold_tokens(t or "")) for t in b.column("text").to_pylist()],
    }, "doc_id bigint, label int, copy bigint, text string")
    one = rows.groupBy("copy", "label").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return written(one.select("label", F.col("r.text").alias("text")), "toxic_sample")


def learn(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS,
          least_toxic: int = LEAST_TOXIC, least_ratio: float = LEAST_RATIO) -> dict | None:
    """Lexicon, exceptions and curve from folded documents; None without both labels.

    Words and pairs are counted by Spark. A listed word is in 1 % of the toxic
    documents or more, which bounds the list.
    """
    sizes = dict(tuple(r) for r in sample.groupBy("label").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    counts = map_batches(sample, _entries, "entry string, toxic bigint, n bigint").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    weight = {}
    for r in counts.where(F.col("toxic") >= max(least_toxic, 0.01 * n1)).collect():
        ratio = np.log((r.toxic + 0.5) / (n1 + 1)) - np.log((r.n - r.toxic + 0.5) / (n0 + 1))
        if ratio >= least_ratio:
            weight[r.entry] = float(ratio)
    weight = _shortest(weight)

    def listed(word: str) -> bool:
        return f" {word} " in weight or any(f" {word[:n]}" in weight for n in STEMS)

    def around(batch: pa.RecordBatch) -> dict:
        found = [(y, " ".join(p)) for y, t in zip(batch.column("label").to_pylist(),
                                                  batch.column("text").to_pylist(), strict=True)
                 for tokens in [t.split()]
                 for p in sorted({(a, b) for a, b in zip(tokens, tokens[1:])
                                  if listed(a) or listed(b)})]
        return {"label": [y for y, _ in found], "pair": [p for _, p in found]}

    pairs = map_batches(sample, around, "label int, pair string").groupBy("pair").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    learned = [r.pair for r in pairs.where("good >= 3 and good > 4 * bad").collect()]
    given = [" ".join(fold_tokens(p)) for p in exceptions]
    model = {"weights": weight, "exceptions": sorted({*learned, *given})}
    got = map_batches(sample, lambda b: {
        "label": b.column("label"),
        "x": evidence(b.column("text").to_pylist(), automaton(model)).tolist(),
    }, "label int, x array<double>").toPandas()
    x, label = np.array(got["x"].tolist()), got["label"].to_numpy()
    order = np.lexsort([*x.T, label])
    x, label = x[order], label[order]
    model["scale"] = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([x / model["scale"], np.ones(len(x))])
    model["curve"] = newton(z, (label == 1).astype(float), ridge=0.5)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1,
             threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS,
             exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts match nothing and get the lowest score. Without both labels
    to learn from, every score is 0. Only ``doc_id`` and ``text`` are read.
    """
    model = learn(folded_sample(docs, labels, folds, held_out, sample_rows), exceptions)

    def run(batch: pa.RecordBatch) -> dict:
        folded = [" ".join(fold_tokens(t or "")) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"),
                "score": score(folded, model, automaton(model) if model else None)}

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id bigint, score double").select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
