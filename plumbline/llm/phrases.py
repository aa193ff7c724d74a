"""Collocations by multikey three-way quicksort of suffix pointers.

A suffix is a place in a piece and the words from there on, at most ``MOST_WORDS``. What
cannot be frequent is left out before anything is sorted: words and pairs are counted
in a table of fixed size by hash, and a pair whose cell holds fewer than ``least`` is
rare. The other suffixes, equal ones of a task counted once, are routed by their two
leading words to owners. An owner splits its pointers by three-way quicksort, word by
word: the pointers equal to the pivot are the occurrences of a phrase, so their weight
is its count, and parts that weigh less than ``least`` are given up. Pairs with very
many occurrences are spread by their further words as well; their parts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import _emit, _runs, arrow_batches, hot_join, map_groups, need, written
from plumbline.llm.text import _BASE, _LOWER, _powers, chunks, mix
from plumbline.plans.workers import ship

ship(__name__)
LEAST, MOST_WORDS, TOP, INSIDE_PERCENT = 30, 4, 2000, 80
# Cells of the count table, words first; what tasks share is one byte per cell.
WORD_CELLS, PAIR_CELLS, CELL_BLOCK = 1 << 21, 1 << 24, 1 << 16
# Suffixes of an owner, and of a pair from which on it is spread.
OWNER_SUFFIXES = 1 << 19
# Entries that a task holds before it passes them on.
HELD = 1 << 21
_U = np.uint64
_CUT = np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
WORDS = [f"w{i}" for i in range(MOST_WORDS)]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, owner_suffixes: int = OWNER_SUFFIXES,
                 pair_cells: int = PAIR_CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Words are cut at blanks inside pieces, pieces at ``.,;:!?`` and line ends; A-Z are
    lower-cased. Null text is empty, null lang is "und"; doc_id plays no part and
    repeated rows count again. Phrases have 2 to 4 words and at least ``least``
    occurrences; those inside a longer one that has 80 % of their occurrences go. Ties
    come by a, then by the phrase's bytes. Without words a language, and an empty table,
    has no rows. Words are known by 64-bit hashes of their bytes and language.
    """
    spark = arrow_batches(docs.sparkSession)
    docs = need(docs, "lang", "text").withColumn("lang", F.coalesce("lang", F.lit("und")))
    cells = _cells(docs, least, owner_suffixes, pair_cells)
    shared = spark.sparkContext.broadcast(cells[0])
    words = written(_words(docs, shared), "phrase_words")
    total = words.where("word is null").groupBy("lang").agg(F.sum("n").alias("n"))
    known = written(words.where("word is not null").groupBy("w0").agg(
        F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("a"))
        .where(F.col("a") >= least), "known_words")
    owners = 1 << max(0, int(cells[1] // owner_suffixes).bit_length())
    phrases = written(_phrases(docs, shared, least, owners).groupBy(*WORDS).agg(F.sum("a").alias("a"))
                      .where(F.col("a") >= least), "phrases")
    return _ranked(_scored(_whole(phrases), phrases, known), known, total, top)


# --- words of texts ------------------------------------------------------------------

def tokens(lang: np.ndarray, texts: pa.Array) -> Iterator[tuple]:
    """(hash of each word and its text's language, pieces, texts, bytes, starts, ends)."""
    for at, data, offsets in chunks(texts):
        n = len(data)
        inner = ~_GAP[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inner[:-1], inner[1:]
        start = np.flatnonzero(inner & (~before | edge[:-1]))
        end = np.flatnonzero(inner & (~after | edge[1:])) + 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[:n], out=sums[1:])
        piece = np.zeros(n + 1, dtype=np.int64)
        piece[1:] = np.cumsum(_CUT[data])
        doc = np.searchsorted(offsets, start, "right") - 1
        h = mix(((sums[end] - sums[start]) * down[start]) ^ lang[at + doc])
        # 0 stands for the end of a piece.
        yield np.where(h == 0, _U(1), h), piece[start] + doc, at + doc, data, start, end


def lang_key(lang: str) -> int:
    key = 0
    for byte in lang.encode("utf-8"):
        key = (key + byte + 1) * _BASE % (1 << 64)
    return key


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
    langs = batch.column("lang").to_pylist()
    return tokens(np.array([lang_key(v) for v in langs], dtype=_U), batch.column("text"))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(_BASE) + second)


# --- the count table -----------------------------------------------------------------

def _cells(docs: DataFrame, least: int, owner_suffixes: int, pair_cells: int) -> tuple[np.ndarray, int]:
    """(a byte per cell: 0 rare, else 1 + log2 of the parts that its suffixes are dealt to;
    the suffixes of cells that are not rare). The table has a fixed size, so it may meet on
    the driver and be sent to all tasks."""
    size = WORD_CELLS + pair_cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.uint32)
        for b in batches:
            for h, piece, *_ in _tokens(b) if b.num_rows else ():
                for cell in (h & _U(WORD_CELLS - 1), _pair_cells(h, piece, pair_cells)):
                    at, n = np.unique(cell, return_counts=True)
                    held[at] += n.astype(np.uint32)
        for lo in range(0, size, CELL_BLOCK):
            at = np.flatnonzero(held[lo:lo + CELL_BLOCK])
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([lo // CELL_BLOCK], pa.int32()),
                    "at": [at.astype(np.uint16).tobytes()], "n": [held[lo + at].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order; one is held."""
        at, held = None, None

        def done() -> pa.RecordBatch:
            parts = np.ceil(np.log2(np.maximum(held / owner_suffixes, 1))).astype(np.uint8)
            kept = np.where(held >= least, 1 + parts, 0).astype(np.uint8)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([at], pa.int32()), "marks": [kept.tobytes()],
                "n": pa.array([int(held[held >= least].sum()) if at * CELL_BLOCK >= WORD_CELLS else 0], pa.int64())})

        for b in batches:
            for block, where, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, held = block, np.zeros(CELL_BLOCK, dtype=np.int64)
                held[np.frombuffer(where, dtype=np.uint16)] += np.frombuffer(n, dtype=np.uint32)
        if at is not None:
            yield done()

    counted = docs.mapInArrow(run, "block int, at binary, n binary")
    summed = counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, marks binary, n bigint")
    out, kept = np.zeros(size, dtype=np.uint8), 0
    for r in summed.collect():
        out[r.block * CELL_BLOCK:(r.block + 1) * CELL_BLOCK] = np.frombuffer(r.marks, dtype=np.uint8)
        kept += r.n
    return out, kept


def _pair_cells(h: np.ndarray, piece: np.ndarray, pair_cells: int) -> np.ndarray:
    near = piece[1:] == piece[:-1]
    return _U(WORD_CELLS) + (pair_hash(h[:-1][near], h[1:][near]) & _U(pair_cells - 1))


# --- words and suffixes --------------------------------------------------------------

def _words(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(lang, w0, word, n): words of cells that are not rare, counted per task, and all
    words of a language (word null)."""
    schema = pa.schema([("lang", pa.string()), ("w0", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def out(held: dict) -> dict:
        return {"lang": [v[0] for v in held.values()], "w0": np.array(list(held), dtype=_U).view(np.int64),
                "word": [v[1].translate(_FOLD).decode("utf-8") for v in held.values()],
                "n": [v[2] for v in held.values()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            langs = b.column("lang").to_pylist()
            for h, _, doc, data, start, end in _tokens(b):
                for d, n in zip(*np.unique(doc, return_counts=True), strict=True):
                    totals[langs[d]] = totals.get(langs[d], 0) + int(n)
                place = np.flatnonzero(shared.value[h & _U(WORD_CELLS - 1)])
                keys, first, n = np.unique(h[place], return_index=True, return_counts=True)
                for key, i, count in zip(keys.tolist(), place[first].tolist(), n.tolist(), strict=True):
                    if key in held:
                        held[key][2] += count
                    else:
                        held[key] = [langs[doc[i]], data[start[i]:end[i]].tobytes(), count]
            if len(held) > HELD // 4:
                yield from _emit([out(held)], schema)
                held = {}
        if held:
            yield from _emit([out(held)], schema)
        if totals:
            yield from _emit([{"lang": list(totals), "w0": [None] * len(totals), "word": [None] * len(totals),
                               "n": list(totals.values())}], schema)

    return docs.mapInArrow(run, "lang string, w0 bigint, word string, n bigint")


_FOLD = bytes(_LOWER)


def suffixes(h: np.ndarray, piece: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(up to MOST_WORDS words of each suffix, the mark of its leading pair); a suffix ends
    with its piece or before the first rare pair."""
    n = len(h)
    mark = np.zeros(n + MOST_WORDS, dtype=np.uint8)
    if n > 1:
        near = np.flatnonzero(piece[1:] == piece[:-1])
        mark[near] = marks[_U(WORD_CELLS) + (pair_hash(h[near], h[near + 1]) & _U(len(marks) - WORD_CELLS - 1))]
    at = np.flatnonzero(mark)
    out = np.zeros((len(at), MOST_WORDS), dtype=_U)
    out[:, 0] = h[at]
    going = np.ones(len(at), dtype=bool)
    for d in range(1, MOST_WORDS):
        going &= mark[at + d - 1] > 0
        out[going, d] = h[at[going] + d]
    return out, mark[at]


def counted(keys: np.ndarray, marks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of ``keys`` once, with the sum of their ``n``."""
    if not len(keys):
        return keys, marks, n
    order = np.lexsort(keys.T[::-1])
    keys, marks, n = keys[order], marks[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[new], marks[new], np.add.reduceat(n, new)


def _phrases(docs: DataFrame, shared: Broadcast, least: int, owners: int) -> DataFrame:
    """(w0 to w3, a): phrases of two words or more with their counts; of spread pairs in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h, piece, *_ in _tokens(b) if b.num_rows else ():
                keys, marks = suffixes(h, piece, shared.value)
                held.append(counted(keys, marks, np.ones(len(keys), dtype=np.int64)))
                size += len(held[-1][0])
            if size > HELD:
                yield from _dealt(held, owners)
                held, size = [], 0
        yield from _dealt(held, owners)

    dealt = docs.mapInArrow(run, "owner int, keys binary, marks binary, n binary")
    ddl = ", ".join(f"{w} bigint" for w in WORDS) + ", a bigint"
    return map_groups(dealt, ["owner"], [], lambda key, t: _owner(t, least), ddl)


def _dealt(held: list, owners: int) -> Iterator[pa.RecordBatch]:
    """A task's suffixes, those of one owner in one row."""
    if not held:
        return
    keys, marks, n = counted(*(np.concatenate(v) for v in zip(*held, strict=True)))
    spread = mix(keys[:, 2] * _U(_BASE) + keys[:, 3]) % (_U(1) << np.maximum(marks, 1).astype(_U) - _U(1))
    owner = (mix(pair_hash(keys[:, 0], keys[:, 1]) + spread) % _U(owners)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    keys, marks, n, owner = keys[order], marks[order], n[order], owner[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            # Word by word, so that equal leading words lie together for compression.
            yield pa.RecordBatch.from_pydict({
                "owner": pa.array([owner[lo]], pa.int32()), "keys": [np.ascontiguousarray(keys[lo:hi].T).tobytes()],
                "marks": [marks[lo:hi].tobytes()], "n": [n[lo:hi].astype(np.uint32).tobytes()]})


def _owner(rows: pa.Table, least: int) -> Iterator[dict]:
    parts = [rows.column(c).to_pylist() for c in ("keys", "marks", "n")]
    keys = np.concatenate([np.frombuffer(x, dtype=_U).reshape(MOST_WORDS, -1).T for x in parts[0]])
    marks = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in parts[1]])
    n = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in parts[2]]).astype(np.int64)
    found = list(quicksort(keys, marks > 1, n, least))
    if found:
        words = np.zeros((len(found), MOST_WORDS), dtype=_U)
        for i, (place, depth, _) in enumerate(found):
            words[i, :depth] = keys[place, :depth]
        yield {**{w: np.ascontiguousarray(words[:, d]).view(np.int64) for d, w in enumerate(WORDS)},
               "a": [v for *_, v in found]}


def quicksort(keys: np.ndarray, spread: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a pointer, words, weight) of every phrase of two words or more that weighs
    ``least``, or of any weight where its pair is ``spread`` and this is a part of it.

    Pointers are split by the word at ``depth`` into those below, equal to and above the
    middle one's; the equal ones go on with the next word.
    """
    todo = [(np.arange(len(keys)), 0)]
    while todo:
        at, depth = todo.pop()
        weight = n[at]
        if weight.sum() < least and not spread[at].any():
            continue
        word = keys[at, depth]
        pivot = word[len(word) // 2]
        same = word == pivot
        equal = at[same]
        total = int(weight[same].sum())
        if pivot and (total >= least or spread[equal].any()):
            if depth and (total >= least or depth + 1 < MOST_WORDS):
                yield int(equal[0]), depth + 1, total
            if depth + 1 < MOST_WORDS:
                todo.append((equal, depth + 1))
        if len(equal) < len(at):
            below = word < pivot
            todo += [(p, depth) for p in (at[below], at[~(below | same)]) if len(p)]


# --- scores --------------------------------------------------------------------------

def _key(first: str, size: str) -> str:
    return f"slice(array({', '.join(WORDS)}), {first}, {size})"


def _whole(phrases: DataFrame) -> DataFrame:
    """Phrases without those inside a longer one that has most of their occurrences."""
    sized = phrases.withColumn("size", F.expr("2 + int(w2 <> 0) + int(w3 <> 0)"))
    spans = F.expr("""filter(flatten(transform(sequence(1, size - 1), i -> transform(sequence(2, size - 1),
        m -> struct(i AS i, m AS m)))), s -> s.i + s.m - 1 <= size)""")
    inside = sized.where("size > 2").withColumn("s", F.explode(spans)).select(
        F.expr(_key("s.i", "s.m")).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(
        F.max("longer").alias("longer"))
    return (sized.withColumn("key", F.expr(_key("1", "size"))).join(inside, "key", "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)")
                                               < INSIDE_PERCENT * F.col("a").cast("decimal(20,0)"))).drop("longer"))


def _scored(kept: DataFrame, phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(key, lang, a, l, r, score): the cut with the lowest score, then the shortest first part."""
    parts = kept.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumn("part", F.explode(F.expr(
        f"array(struct(true AS first, {_key('1', 'k')} AS key), struct(false AS first, {_key('k + 1', 'size - k')} AS key))")))
    parts = written(parts.select("key", "a", "k", "part.first", F.col("part.key").alias("part")), "phrase_parts")
    asked = parts.groupBy("part").agg(F.count("*").alias("asked"))
    counts = phrases.select(F.expr(_key("1", "2 + int(w2 <> 0) + int(w3 <> 0)")).alias("part"), F.col("a").alias("f"),
                            F.lit(None).cast("string").alias("lang")).unionByName(
        known.select(F.array("w0").alias("part"), F.col("a").alias("f"), "lang"))
    counts = written(counts.join(asked, "part"), "part_counts")
    cuts = hot_join(parts, counts, "part", "asked").groupBy("key", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"),
        F.max(F.when(F.col("first") & (F.col("k") == 1), F.col("lang"))).alias("lang"))
    score = F.expr("cast(2000000 * cast(a AS decimal(20,0)) div (l + r) AS bigint)")
    best = cuts.withColumn("score", score).groupBy("key", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"), F.max("lang").alias("lang"))
    return best.select("key", "lang", "a", "best.l", "best.r", "best.score")


def _ranked(scored: DataFrame, known: DataFrame, total: DataFrame, top: int) -> DataFrame:
    scored = written(scored, "scored_phrases")
    spelt = scored.select("key", F.posexplode("key").alias("i", "w0"))
    uses = written(known.join(spelt.groupBy("w0").agg(F.count("*").alias("uses")), "w0").select("w0", "word", "uses"),
                   "used_words")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ")
    named = scored.join(hot_join(spelt, uses, "w0", "uses").groupBy("key").agg(phrase.alias("phrase")), "key")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
