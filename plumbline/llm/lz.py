"""Lempel-Ziv phrase fingerprints.

Each text is parsed into LZ78 phrases: the shortest run of code points not yet in the
dictionary becomes a new phrase. The hashed phrase set is summed up by minimum
hashes; the share of equal coordinates estimates how similar two dictionaries are,
much as a compressor that knew one text would do on the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, need
from plumbline.llm.text import _powers, min_hashes, mix
from plumbline.plans.workers import ship

ship(__name__)
COORDINATES = 64
RANGES_ROWS = 4096
_U = np.uint64


def parse(text: str, start: int = 0, seen: set[str] | None = None,
          stop: int | None = None) -> tuple[list[int], int]:
    """Ends of the phrases of ``text`` that end by ``stop``, and where the next begins.

    ``seen`` is the dictionary, to which the phrases are added.
    """
    seen = set() if seen is None else seen
    add, ends = seen.add, []
    for end in range(start + 1, (len(text) if stop is None else stop) + 1):
        run = text[start:end]
        if run not in seen:
            add(run)
            start = end
            ends.append(end)
    return ends, start


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """Hashes of the phrases; a last run that repeats a phrase adds nothing."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    up, down = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=_U)
    np.cumsum((points + _U(1)) * up[:len(points)], out=total[1:])
    hi = np.array(ends, dtype=np.int64)
    lo = np.concatenate([[0], hi])[:len(hi)].astype(np.int64)
    return mix((total[hi] - total[lo]) * down[lo])


def both_phrases(text: str, tail: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Phrase hashes of a text, and of the text whose last third is replaced by the
    beginning of ``tail``; the common part is parsed once."""
    n = len(text)
    keep = n - n // 3
    edited = text[:keep] + tail[:n // 3]
    seen: set[str] = set()
    head, at = parse(text, 0, seen, keep)
    before = set(seen) if keep < n else seen
    rest, _ = parse(text, at, seen)
    changed, _ = parse(edited, at, before)
    return phrase_hashes(text, head + rest), phrase_hashes(edited, head + changed), edited


def _hex(signature: np.ndarray, empty: np.ndarray) -> list[str]:
    """16 bits of each coordinate; an empty text has the empty fingerprint."""
    return ["" if e else (row >> np.uint32(16)).astype(">u2").tobytes().hex()
            for row, e in zip(signature, empty, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal coordinates; two empty texts are alike, one and another are not."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint16) for s in (a, b))
    return float((x == y).mean())


def _rows(held: list[tuple], coordinates: int) -> dict:
    """Output of (doc_id, text, next text or None for the last of all) rows."""
    own, edited, texts = [], [], []
    for _, text, following in held:
        a, b, e = both_phrases(text, following)
        own.append(a)
        edited.append(b)
        texts.append(e)
    nexts = [phrase_hashes(f, parse(f)[0]) for f in [held[-1][2]]] if held else []
    prints = []
    for sets in (own, edited, nexts):
        prints.append(_hex(min_hashes(sets, coordinates), np.array([not len(s) for s in sets])))
    follow = prints[0][1:] + prints[2]
    return {
        "doc_id": [h[0] for h in held], "n_chars": [len(h[1]) for h in held],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
        "fingerprint": prints[0], "edited_fingerprint": prints[1],
        "near_edited": [likeness(a, b) for a, b in zip(prints[0], prints[1], strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(prints[0], follow, strict=True)],
    }


SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Fingerprint of every text and of its edited text, with the likeness of both and
    of the next document in descending doc_id (the first follows the last).

    Null texts are empty; rows of one id come in the order of their texts, rows
    without an id last. Documents are dealt to ranges of ids; the first row of each
    range also goes, marked, to the range before it, so each task streams its rows
    once and holds a batch. Equal texts have equal fingerprints.
    """
    spark = arrow_batches(docs.sparkSession)
    rows = need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    ids = rows.select("doc_id")
    count = ids.count()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    parts = max(1, min(4000, count // RANGES_ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)
                   .alias("c")).first().c or []
    cuts = sorted(set(cuts), reverse=True) if parts > 1 else []
    edges = np.array(cuts[::-1], dtype=np.int64)

    def part_of(batch: pa.RecordBatch) -> pa.Array:
        """Ranges in descending order of ids; a cut opens the range above it."""
        ids_ = batch.column("doc_id")
        values = ids_.fill_null(0).to_numpy()
        part = len(edges) - np.searchsorted(edges, values, "right")
        part = np.where(ids_.is_null().to_numpy(zero_copy_only=False), len(edges) + 1, part)
        return pa.array(part.astype(np.int32))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, part_of(b)], [*b.schema.names, "part"])

    # The first row of each range: its largest id and the smallest text of that id.
    heads = (ids.mapInArrow(tagged, "doc_id bigint, part int").groupBy("part")
             .agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).orderBy("part").collect())
    before = {heads[i].part: heads[i - 1].part for i in range(len(heads))}
    tops = {r.part: (r.top, before[r.part]) for r in heads}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = part_of(b)
            values = b.column("doc_id").to_pylist()
            at = np.array([i for i, (v, p) in enumerate(zip(values, part.to_pylist(), strict=True))
                           if v == tops[p][0]], dtype=np.int64)
            names = ["doc_id", "text", "part", "tail"]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, part, pa.array(np.zeros(len(values), dtype=np.int32))], names)
            if len(at):
                other = pa.array([tops[p][1] for p in part.take(pa.array(at)).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*b.take(pa.array(at)).columns, other,
                     pa.array(np.ones(len(at), dtype=np.int32))], names)

    dealt = (rows.mapInArrow(spread, "doc_id bigint, text string, part int, tail int")
             .repartition(len(heads), "part")
             .sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range in order, then its tail, whose smallest text follows."""
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()),
                            *((n, pa.string()) for n in ("edited_sha256", "fingerprint",
                                                         "edited_fingerprint")),
                            ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held, waiting, size = [], None, 0
        for b in batches:
            for doc_id, text, part, tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting is not None and waiting[2] == part:
                    held.append((waiting[0], waiting[1], text))
                    size += len(text)
                waiting = None if tail else (doc_id, text, part)
                if held and (tail or size > 1 << 20):
                    yield pa.RecordBatch.from_pydict(_rows(held, coordinates), schema)
                    held, size = [], 0

    return dealt.mapInArrow(run, SCHEMA)
