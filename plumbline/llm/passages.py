"""Repeated passages by collinear chaining of shared seeds.

Seeds are k-word runs chosen by minimizers, so any run of ``seed + window - 1`` equal
words has one. Each seed of a document is matched with the first occurrence of that
seed in the corpus (smallest doc_id), never with all others: a passage that very many
documents share costs one match per seed and document. Posts are dealt to owners by
hash in one shuffle, packed; hashes that a sample shows to be hot are dealt by document
and look their first occurrence up in a small table.

Matches of a document with one earlier document are chained in order: seeds that touch
on one diagonal are one stretch, and a Fenwick tree over the earlier positions gives each
stretch its best predecessor under gap costs. A chain of one seed is followed only if the
words around the seed are alike, by 32-bit sets that travel with the posts. Chains are
aligned on the words of both documents, over the gaps and beyond the ends, with gaps there
too, and kept when long and alike enough.

A seed inside a passage may have its first occurrence elsewhere, so exact repeats have a
way of their own: where all seeds of ``min_words`` words are shared, but not by one earlier
document on one diagonal, the run of all these words is posted too and matched with its own
first occurrence. Every exact repeat of ``min_words`` words is found that way, at one match
per word: where one earlier document has all the seeds, the chain with it is the match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import (
    _arrow, _ddl, _emit, arrow_batches, hot_join, map_batches, map_groups, need, written,
)
from plumbline.llm.text import mix, shingles, words
from plumbline.plans.lookup import maybe_in
from plumbline.plans.workers import ship

ship(__name__)
SEED_WORDS = 6
WINDOW = 4
MIN_WORDS = 50
MIN_IDENTITY = 0.8
MAX_GAP = 64
GAP_COST = 0.15
REACH = 64
# Words on each side of a seed whose set travels with it, and how many of the 32 bits may differ.
CONTEXT, CONTEXT_BITS = 22, 11
# Extensions: band of the alignment, points lost by an unequal word or a gap, fall that ends it.
BAND, MISS, DROP = 8, 2, 10
# Owners take about so many posts; a hash in HOT_DOCS of a sample of SAMPLE documents is hot.
OWNER_POSTS = 1 << 20
SAMPLE, HOT_DOCS, MOST_HOT = 20_000, 40, 65_536
HELD = 1 << 17
# Matches that are chained at a time; a document's are never parted.
CHAIN_ROWS = 1 << 16
POSTS = "owner int, hash binary, doc binary, pos binary, span binary, sides binary"
MATCH = ("hash bigint, doc_id bigint, a bigint, pos int, pos_a int, span int, span_a int, alike boolean, "
         "sides bigint, exact boolean")
CHAIN = "b bigint, b_lo int, b_hi int, a bigint, a_lo int, a_hi int, at array<int>, lo array<int>, hi array<int>"
PASSAGE = ("doc_id bigint, start_word bigint, end_word bigint, source_doc_id bigint, "
           "source_start bigint, source_end bigint, identity double")
_U = np.uint64


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY,
                      seed: int = SEED_WORDS, window: int = WINDOW, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document also has.

    One row per passage: words [start_word, end_word) of ``doc_id`` are those of
    ``source_doc_id`` (smaller) from source_start, with ``identity`` equal words over
    the longer side. Null, empty and short texts have none; rows without doc_id take
    no part; repeated rows of one doc_id are one document. An empty table has no
    passages; columns other than doc_id and text take no part. The sample of documents
    in which a hash is found to be hot decides how posts are dealt, no result.
    """
    arrow_batches(docs.sparkSession)
    docs = need(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # A word has six bytes or so, and two posts come from five words.
    owners = 1 + size.bytes // (15 * OWNER_POSTS)
    hot = _hot_hashes(docs, size.rows, seed, window, hot_docs)
    shared, firsts = _matches(docs, lambda b: _seeds(b, seed, window), hot, owners, "shared_seeds")
    known = docs.sparkSession.sparkContext.broadcast(firsts)
    one = written(_chained(shared, known, min_words, seed, window), "seed_chains")
    asked = one.where("lo is not null").select(F.col("b").alias("doc_id"), "lo", "hi")
    found = maybe_in(docs, asked, "doc_id")[0].join(asked, "doc_id")
    runs, _ = _matches(found, lambda b: _runs_of_words(b, min_words), [], owners, "shared_runs")
    two = map_groups(runs.where("a < doc_id"), ["doc_id"], ["a", "pos", "pos_a"], lambda key, t: _run_chains(key, t, min_words), CHAIN)
    columns = ["b", "b_lo", "b_hi", "a", "a_lo", "a_hi", "at"]
    chains = written(one.where("a is not null").select(*columns).unionByName(two.select(*columns)).distinct(), "chains")
    pairs = _with_slices(chains, written(_slices(docs, chains), "slices"))
    found = written(map_batches(pairs, lambda b: _align(b, min_words, min_identity), PASSAGE), "aligned")
    return map_groups(found, ["doc_id"], ["start_word", F.desc("end_word"), F.desc("identity"), "source_doc_id",
                                          "source_start", "source_end"], _outermost, PASSAGE)


# --- posts and first occurrences -------------------------------------------------------

def _hot_hashes(docs: DataFrame, rows: int, k: int, window: int, hot_docs: int) -> list[int]:
    """Hashes of ``hot_docs`` documents or more of a sample, the most frequent MOST_HOT."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 + rows // SAMPLE)) == 0)

    def run(batch: pa.RecordBatch) -> dict:
        return {"hash": np.unique(np.concatenate([p[0] for p in _seeds(batch, k, window)])).view(np.int64)}

    n = map_batches(sample, run, "hash bigint").groupBy("hash").count().where(F.col("count") >= hot_docs)
    return [r.hash for r in n.orderBy(F.desc("count"), "hash").limit(MOST_HOT).collect()]


def _matches(docs: DataFrame, posts_of, hot: list[int], owners: int, name: str) -> tuple[DataFrame, tuple | None]:
    """Posts of hashes that two documents have, each with the first occurrence (a, pos_a),
    that of the smallest doc_id; stored. Those of ``hot`` hashes come without it: their first
    occurrences are the second result, at most MOST_HOT of them, in the order of hashes."""
    hot_set = np.sort(np.array(hot, dtype=np.int64).view(_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in posts_of(b) if b.num_rows else ():
                held.append(part)
                size += len(part[0])
            if size > HELD:
                yield from _packed(held, owners, hot_set)
                held, size = [], 0
        if size:
            yield from _packed(held, owners, hot_set)

    packed = docs.mapInArrow(run, POSTS)
    met = written(map_groups(packed, ["owner"], [], _owner, MATCH), name)
    if not hot:
        return met, None
    post = F.min(F.struct("doc_id", "pos", "span", "sides"))
    firsts = met.where("a is null").groupBy("hash").agg(post.alias("f"), F.max("doc_id").alias("last"))
    rows = firsts.where("last > f.doc_id").select("hash", "f.*").collect()
    rows = sorted((tuple(r) for r in rows), key=lambda r: r[0] % (1 << 64))
    return met, tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else None


def _packed(held: list, owners: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Posts of a task, those of one owner in one row: owners from 0 by hash, hot ones below
    0 by document."""
    h, doc, pos, span, sides = (np.concatenate(v) for v in zip(*held, strict=True))
    owner = (h % _U(owners)).astype(np.int32)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        owner[is_hot] = -1 - (mix(doc[is_hot].view(_U)) % _U(owners)).astype(np.int32)
    order = np.lexsort((pos, doc, owner))
    columns = [v[order] for v in (h, doc, pos.astype(np.int32), span.astype(np.int32), sides)]
    owner = owner[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.RecordBatch.from_pydict({"owner": pa.array([owner[lo]], pa.int32()), **{
            n: [c[lo:hi].tobytes()] for n, c in zip(("hash", "doc", "pos", "span", "sides"), columns, strict=True)}})


def _owner(key: tuple, rows: pa.Table) -> Iterator[dict]:
    kinds = {"hash": _U, "doc": np.int64, "pos": np.int32, "span": np.int32, "sides": _U}
    h, doc, pos, span, sides = (np.frombuffer(b"".join(rows.column(n).to_pylist()), dtype=t) for n, t in kinds.items())
    order = np.lexsort((-span, pos, doc, h))
    h, doc, pos, span, sides = (v[order] for v in (h, doc, pos, span, sides))
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    # Repeated rows of one document post the same.
    once = new.copy()
    once[1:] |= (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    h, doc, pos, span, sides, new = (v[once] for v in (h, doc, pos, span, sides, new))
    if key[0] < 0:
        n = len(h)
        none = [None] * n
        yield {"hash": h.view(np.int64), "doc_id": doc, "a": none, "pos": pos, "pos_a": none, "span": span,
               "span_a": none, "alike": none, "sides": sides.view(np.int64), "exact": np.zeros(n, dtype=bool)}
        return
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    last = np.append(start[1:], len(h)) - 1
    at = np.flatnonzero((doc[last] != doc[start])[run])
    first = start[run[at]]
    if len(at):
        apart = sides[at] ^ sides[first]
        alike = (np.bitwise_count(apart & _U(0xFFFFFFFF)) <= CONTEXT_BITS) | (np.bitwise_count(apart >> _U(32)) <= CONTEXT_BITS)
        none = [None] * len(at)
        yield {"hash": none, "doc_id": doc[at], "a": doc[first], "pos": pos[at], "pos_a": pos[first], "span": span[at],
               "span_a": span[first], "alike": alike, "sides": none, "exact": np.zeros(len(at), dtype=bool)}


def _seeds(batch: pa.RecordBatch, k: int, window: int) -> Iterator[tuple]:
    ids = batch.column("doc_id").to_numpy()
    for w in words(batch.column("text")):
        h, first = shingles(w, k)
        # A text of fewer than k words has one shorter run, which is no seed.
        short = np.diff(w.first) < k
        pos, span = minimizers(h, first, window)
        doc = np.searchsorted(first, pos, "right") - 1
        keep = ~short[doc]
        pos, doc, span = pos[keep], doc[keep], span[keep]
        yield _posts(h[pos], ids[w.at + doc], pos - first[doc], span, k,
                     _sides(w.hash, w.first, pos - first[doc], doc, k))


def _sides(hashes: np.ndarray, first: np.ndarray, place: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Sets of the CONTEXT words before (low 32 bits) and behind the k words at ``place``."""
    texts = len(first) - 1
    pad = CONTEXT + k
    shift = np.repeat(np.arange(texts) + 1, np.diff(first)) * pad
    bits = np.zeros(len(hashes) + (texts + 2) * pad, dtype=np.uint32)
    bits[np.arange(len(hashes)) + shift] = np.uint32(1) << (hashes >> _U(59)).astype(np.uint32)
    wide = bits
    for step in (1, 2, 4, 8):
        wide = wide | np.concatenate([wide[step:], np.zeros(step, dtype=np.uint32)])
    rest = CONTEXT - 16
    wide = wide | np.concatenate([wide[rest:], np.zeros(rest, dtype=np.uint32)])
    at = first[doc] + place + (doc + 1) * pad
    return wide[at - CONTEXT].astype(_U) | (wide[at + k].astype(_U) << _U(32))


def _runs_of_words(batch: pa.RecordBatch, words_: int) -> Iterator[tuple]:
    """Posts of the runs of ``words_`` words that start in the asked places."""
    ids = batch.column("doc_id").to_numpy()
    lists = [batch.column(n).to_pylist() for n in ("lo", "hi")]
    for w in words(batch.column("text")):
        h, first = shingles(w, words_)
        wanted = np.zeros(len(h) + 1, dtype=np.int64)
        for i in np.flatnonzero(np.diff(w.first) >= words_):
            lo, hi = (np.minimum(np.array(v[w.at + i]), first[i + 1] - first[i]) + first[i] for v in lists)
            np.add.at(wanted, lo[lo < hi], 1)
            np.add.at(wanted, hi[lo < hi], -1)
        at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
        doc = np.searchsorted(first, at, "right") - 1
        # Of equal neighbours, as in periodic text, only the first stays.
        new = np.ones(len(at), dtype=bool)
        new[1:] = (h[at[1:]] != h[at[:-1]]) | (np.diff(at) > 1) | (doc[1:] != doc[:-1])
        kept = np.flatnonzero(new)
        span = at[np.append(kept[1:], len(at)) - 1] - at[kept] if len(kept) else at
        at, doc = at[kept], doc[kept]
        yield _posts(h[at], ids[w.at + doc], at - first[doc], span, words_, np.zeros(len(at), dtype=_U))


def _posts(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, span: np.ndarray, k: int,
           sides: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, doc_id, pos, words, sides) of the runs of ``k`` words, repeated for ``span`` words."""
    # Periodic text is also posted by the length it reaches, so that its first
    # occurrence is one as long, not the first short one.
    base = out = (hashes, doc, place, span, sides)
    level = max(MIN_WORDS, k + 1)
    while (long := base[3] + k >= level).any():
        longer = (mix(base[0][long] + _U(level)), *(v[long] for v in base[1:]))
        out = tuple(np.concatenate(v) for v in zip(out, longer, strict=True))
        level *= 2
    return (*out[:3], out[3] + k, out[4])


def minimizers(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest hash (the leftmost) of every window within a text, or of
    the whole text if it is shorter. Of equal neighbours, as in periodic text, only the
    first stays, with the words from it to the last."""
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    end = np.repeat(first[1:], np.diff(first))
    starts = np.arange(n)
    whole = starts == np.repeat(first[:-1], np.diff(first))
    starts = starts[(starts + window <= end) | whole]
    stop = end[starts]
    best, at = h[starts].copy(), starts.copy()
    for j in range(1, window):
        here = np.minimum(starts + j, n - 1)
        better = (starts + j < stop) & (h[here] < best)
        best[better] = h[here[better]]
        at[better] = here[better]
    at = np.unique(at)
    doc = np.searchsorted(first, at, "right")
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = (h[at[1:]] != h[at[:-1]]) | (doc[1:] != doc[:-1]) | (np.diff(at) >= window)
    kept = np.flatnonzero(keep)
    return at[kept], at[np.append(kept[1:], len(at)) - 1] - at[kept]


# --- chains --------------------------------------------------------------------------------

def _chained(shared: DataFrame, known: Broadcast, min_words: int, k: int, window: int) -> DataFrame:
    """Seed chains of all documents, many documents of a sorted partition at a time."""
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _ddl(CHAIN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, CHAIN_ROWS
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= enough:
                rows = pa.Table.from_batches(held)
                ids = rows.column("doc_id").to_numpy()
                cut = np.flatnonzero(ids[1:] != ids[:-1])
                if not len(cut):  # one document so far
                    enough = 2 * size
                    continue
                at = int(cut[-1]) + 1
                yield from _emit([_seed_chains(rows.slice(0, at), known.value, min_words, k, window)], out)
                held = rows.slice(at).to_batches()
                size, enough = rows.num_rows - at, CHAIN_ROWS
        if size:
            yield from _emit([_seed_chains(pa.Table.from_batches(held), known.value, min_words, k, window)], out)

    return shared.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, CHAIN)


def _resolved(rows: pa.Table, firsts: tuple | None) -> tuple[np.ndarray, ...]:
    """doc_id, a, pos, pos_a, span, span_a, alike of posts in the order of documents, a, pos, pos_a;
    hot ones look their first occurrence up, and those that no other document has go."""
    names = ("doc_id", "a", "pos", "pos_a", "span", "span_a", "sides", "hash")
    late = rows.column("a").is_null().to_numpy()
    doc, a, pos, pos_a, span, span_a, side, mine = (
        rows.column(n).fill_null(0).to_numpy().astype(np.int64) for n in names)
    alike = rows.column("alike").fill_null(False).to_numpy()
    keep = ~late
    if late.any() and firsts is not None:
        hashes, first, at, long, sides = firsts
        order = hashes.view(_U)
        place = np.minimum(np.searchsorted(order, mine.view(_U)), len(order) - 1)
        hit = late & (hashes[place] == mine)
        apart = (side ^ sides[place]).view(_U)
        close = ((np.bitwise_count(apart & _U(0xFFFFFFFF)) <= CONTEXT_BITS)
                 | (np.bitwise_count(apart >> _U(32)) <= CONTEXT_BITS))
        a, pos_a, span_a = (np.where(hit, v[place], w) for v, w in ((first, a), (at, pos_a), (long, span_a)))
        alike, keep = np.where(hit, close, alike), keep | hit
    held = np.flatnonzero(keep)
    order = held[np.lexsort((pos_a[held], pos[held], a[held], doc[held]))]
    return tuple(v[order] for v in (doc, a, pos, pos_a, span, span_a, alike))


def _seed_chains(rows: pa.Table, firsts: tuple | None, min_words: int, k: int, window: int) -> dict:
    """Chains of each document's seeds with each earlier document, and the places whose runs of
    ``min_words`` words are asked for."""
    doc, a, pos_b, pos_a, own, span_a, alike = _resolved(rows, firsts)
    span = np.minimum(own, span_a)
    out = {n.split()[0]: [] for n in CHAIN.split(", ")}
    if not len(doc):
        return out
    cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(doc) != 0)) + 1
    bounds = np.concatenate([[0], cuts, [len(a)]])
    first = bounds[:-1]
    # Most earlier documents share one seed by chance; those with an unlike surrounding go at once.
    worth = (np.diff(bounds) > 1) | alike[first] | (span[first] >= 2 * k)
    worth &= a[first] < doc[first]
    for i in np.flatnonzero(worth).tolist():
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        b = int(doc[lo])
        if hi - lo == 1:
            _add(out, b, int(a[lo]), [(int(pos_b[lo]), int(pos_a[lo]), int(span[lo]))])
            continue
        parts = stretches(pos_b[lo:hi], pos_a[lo:hi], span[lo:hi])
        near = set(zip(pos_b[lo:hi][alike[lo:hi]].tolist(), pos_a[lo:hi][alike[lo:hi]].tolist(), strict=True))
        for c in chain(parts):
            # One seed of k words, or as good as one: the words around it must be alike.
            if sum(n for *_, n in c) >= 2 * k or any(
                    (x + i, y + i) in near for x, y, n in c for i in range(n - k + 1)):
                _add(out, b, int(a[lo]), c)
    at, lo, hi = _asked(doc, pos_b, pos_b - pos_a, a, own, min_words, k, window)
    edges = np.flatnonzero(np.diff(at)) + 1
    for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
        if x < y:
            for n in out:
                out[n].append({"b": int(at[x]), "lo": lo[x:y].tolist(), "hi": hi[x:y].tolist()}.get(n))
    return out


def _asked(doc: np.ndarray, pos: np.ndarray, diagonal: np.ndarray, a: np.ndarray, span: np.ndarray, words_: int,
           k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, lo, hi): places where a run of ``words_`` words has shared seeds only, but is not
    within a stretch of seeds that one document has on one diagonal.

    Two equal runs have the same seeds at ``inner + 1`` windows, the first of them at
    most window - 1 behind the start of the run, neighbours at most ``window`` apart. So
    a run that another document has starts in a stretch of such neighbours. Equal runs
    are both inside such a stretch of the same document, or the other chain finds it.
    Documents come one behind the other on one line, far enough apart.
    """
    inner = max(words_ - (window + k - 1), 0)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    number = np.cumsum(new) - 1
    ids, far = doc[new], int((pos + span).max()) + 2 * (words_ + window + k)
    base = number * far
    pos = pos + base
    order = np.argsort(pos, kind="stable")
    pos, diagonal, a, span, base = (v[order] for v in (pos, diagonal, a, span, base))
    end = np.maximum.accumulate(pos + span - k)
    new[1:] = pos[1:] - end[:-1] > window
    at = np.flatnonzero(new)
    lo = np.maximum(pos[at] - window + 1, base[at])
    hi = end[np.append(at[1:], len(pos)) - 1] - inner + 1
    lo, hi = lo[lo < hi], hi[lo < hi]
    # Seeds that follow each other on one diagonal of one document, in the order of places.
    cut = np.ones(len(pos), dtype=bool)
    cut[1:] = (diagonal[1:] != diagonal[:-1]) | (a[1:] != a[:-1]) | (pos[1:] - pos[:-1] > window)
    start = np.flatnonzero(cut)
    last = np.maximum.reduceat(pos + np.minimum(span, k), start)
    from_, to = pos[start], last - words_ + 1
    from_, to = from_[from_ < to], to[from_ < to]
    edges = np.concatenate([lo, hi, from_, to])
    change = np.concatenate([np.ones(len(lo)), -np.ones(len(hi)), -1e6 * np.ones(len(from_)), 1e6 * np.ones(len(to))])
    order = np.argsort(edges, kind="stable")
    edges, level = edges[order], np.cumsum(change[order])
    keep = (level[:-1] > 0.5) & (edges[1:] > edges[:-1])
    lo, hi = edges[:-1][keep], edges[1:][keep]
    number = lo // far
    return ids[number], lo - number * far, hi - number * far


def _run_chains(key: tuple, rows: pa.Table, min_words: int) -> Iterator[dict]:
    """Runs of words joined along diagonals, as chains of one stretch."""
    a, pos_b, pos_a, own, span = (rows.column(n).to_numpy().astype(np.int64)
                                  for n in ("a", "pos", "pos_a", "span", "span_a"))
    span = np.minimum(own, span)
    # A run of one repeated word that is longer than its first occurrence matches it several times.
    times = -(-own // span)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    a, pos_b, pos_a, own, span = (np.repeat(v, times) for v in (a, pos_b, pos_a, own, span))
    pos_b = pos_b + np.minimum(step * span, own - span)
    out = {n.split()[0]: [] for n in CHAIN.split(", ")}
    cuts = np.flatnonzero(np.diff(a)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
        for p in covering(stretches(pos_b[lo:hi], pos_a[lo:hi], span[lo:hi], min_words)):
            _add(out, key[0], int(a[lo]), [p])
    if out["b"]:
        yield out


def _add(out: dict, b: int, a: int, parts: list[tuple[int, int, int]]) -> None:
    b0, a0 = parts[0][0], parts[0][1]
    b1, a1 = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
    edge = [max(0, (v - REACH) // REACH * REACH) for v in (b0, a0)]
    last = [-(-(v + REACH) // REACH) * REACH for v in (b1, a1)]
    for n, v in zip(out, (b, edge[0], last[0], a, edge[1], last[1], [x for p in parts for x in p], None, None),
                    strict=True):
        out[n].append(v)


def stretches(pos_b: np.ndarray, pos_a: np.ndarray, span: np.ndarray,
              step: int | None = None) -> list[tuple[int, int, int]]:
    """(b, a, length) of matches joined along a diagonal where they touch, or where they are at
    most ``step`` words apart."""
    if not len(pos_b):
        return []
    diagonal = pos_b.astype(np.int64) - pos_a
    order = np.lexsort((pos_b, diagonal))
    d, b, end = diagonal[order], pos_b[order], (pos_b + span)[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (b[1:] > end[:-1] if step is None else np.diff(b) > step)
    start = np.flatnonzero(new)
    return sorted((int(b[s]), int(b[s] - d[s]), int(e - b[s]))
                  for s, e in zip(start, np.maximum.reduceat(end, start), strict=True))


def covering(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that cover all words of ``runs`` in the later text: in text with a period a run
    starts at every word, and few of them cover it."""
    out, best, end = [], None, -1
    for r in runs:
        if r[0] > end and best is not None and best[0] + best[2] > end:
            out.append(best)
            end, best = best[0] + best[2], None
        if r[0] > end:
            out.append(r)
            end, best = r[0] + r[2], None
        elif r[0] + r[2] > (best[0] + best[2] if best else end):
            best = r
    return [*out, best] if best is not None and best[0] + best[2] > end else out


def chain(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of stretches, best first, each stretch in one chain.

    The score of a stretch is its length plus that of its best predecessor, which ends
    before it in both texts, less GAP_COST per word between them in either. With the
    end of the predecessor as its weight the best one is a prefix maximum over the
    ends in the earlier text.
    """
    if len(parts) < 2:
        return [parts] if parts else []
    ends_a = sorted({a + n for _, a, n in parts})
    rank = {v: i + 1 for i, v in enumerate(ends_a)}
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends_a) + 1)
    score, back = [0.0] * len(parts), [-1] * len(parts)
    closing = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    done = 0
    for i, (b, a, n) in enumerate(parts):
        while done < len(closing) and sum(parts[closing[done]][::2]) <= b:
            j = closing[done]
            done += 1
            pb, pa_, pn = parts[j]
            value = (score[j] + GAP_COST * (pb + pa_ + 2 * pn), j)
            at = rank[pa_ + pn]
            while at < len(tree):
                if tree[at] < value:
                    tree[at] = value
                at += at & -at
        best, at = (-np.inf, -1), int(np.searchsorted(ends_a, a, "right"))
        while at:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - GAP_COST * (a + b)
        score[i] = n + max(gain, 0.0)
        back[i] = best[1] if gain > 0 else -1
    out, used = [], [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        mine = []
        while i >= 0 and not used[i]:
            used[i] = True
            mine.append(parts[i])
            i = back[i]
        mine.reverse()
        held = mine[:1]
        for p in mine[1:]:
            q = held[-1]
            if max(p[0] - q[0] - q[2], p[1] - q[1] - q[2]) > MAX_GAP:
                out.append(held)
                held = []
            held.append(p)
        if held:
            out.append(held)
    return out


# --- words of both sides -----------------------------------------------------------------

def _slices(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, n, words): the hashed words of every wanted stretch, each once."""
    wanted = chains.select(F.col("b").alias("doc_id"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")
                           ).union(chains.select("a", "a_lo", "a_hi"))
    asked = written(wanted.groupBy("doc_id", "lo", "hi").agg(F.count("*").alias("n")).groupBy("doc_id")
                    .agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"),
                         F.collect_list("n").alias("n")), "asked_slices")

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("doc_id", "lo", "hi", "n", "words")}
        lists = {n: batch.column(n).to_pylist() for n in ("doc_id", "lo", "hi", "n")}
        for w in words(batch.column("text")):
            for i in range(w.texts):
                mine = (w.hash[w.first[i]:w.first[i + 1]] >> _U(32)).astype(np.uint32)
                doc = lists["doc_id"][w.at + i]
                for lo, hi, n in zip(*(lists[v][w.at + i] for v in ("lo", "hi", "n")), strict=True):
                    for name, v in zip(out, (doc, lo, hi, n, mine[lo:hi].tobytes()), strict=True):
                        out[name].append(v)
        return out

    return map_batches(maybe_in(docs, asked, "doc_id")[0].join(asked, "doc_id"), run,
                       "doc_id bigint, lo int, hi int, n bigint, words binary")


def _with_slices(chains: DataFrame, slices: DataFrame) -> DataFrame:
    """Chains with the words of both sides; a source that many share is a hot key."""
    def key(doc: str, lo: str, hi: str):
        return F.concat_ws(":", F.col(doc), F.col(lo), F.col(hi))

    named = slices.select(key("doc_id", "lo", "hi").alias("key"), "n", "words").dropDuplicates(["key"])
    named = written(named, "named_slices")
    one = hot_join(chains.withColumn("key", key("b", "b_lo", "b_hi")), named, "key", "n")
    one = one.withColumnRenamed("words", "b_words").drop("n")
    two = hot_join(one.withColumn("key", key("a", "a_lo", "a_hi")), named, "key", "n")
    return two.withColumnRenamed("words", "a_words").drop("n", "key").where(
        "a_words is not null and b_words is not null")


def _align(batch: pa.RecordBatch, min_words: int, min_identity: float) -> dict:
    out = {n.split()[0]: [] for n in PASSAGE.split(", ")}
    rows, jobs = [], []
    for r in batch.to_pylist():
        x = np.frombuffer(r["b_words"], dtype=np.uint32)
        y = np.frombuffer(r["a_words"], dtype=np.uint32)
        at = (np.array(r["at"]).reshape(-1, 3) - [r["b_lo"], r["a_lo"], 0]).tolist()
        if fits(x, y, at):
            rows.append((r, x, y, at))
            jobs += ends(x, y, at)
    reach = extend(jobs)
    for i, (r, x, y, at) in enumerate(rows):
        for b0, b1, a0, a1, equal in aligned(x, y, at, min_words, min_identity, reach[2 * i:2 * i + 2]):
            for n, v in zip(out, (r["b"], b0 + r["b_lo"], b1 + r["b_lo"], r["a"], a0 + r["a_lo"],
                                  a1 + r["a_lo"], equal / max(b1 - b0, a1 - a0)), strict=True):
                out[n].append(v)
    return out


def _outermost(key: tuple, rows: pa.Table) -> Iterator[dict]:
    """Passages of a document that lie neither in an exact one nor in another one with the same
    source; rows come by start, longest first."""
    start, end, source, identity = (rows.column(n).to_numpy() for n in (
        "start_word", "end_word", "source_doc_id", "identity"))
    held = np.maximum.accumulate(np.where(identity == 1, end, -1))
    keep = np.ones(len(end), dtype=bool)
    keep[1:] = end[1:] > held[:-1]
    for at in (np.flatnonzero(source == s) for s in np.unique(source[keep])):
        far = np.maximum.accumulate(end[at])
        keep[at[1:]] &= end[at[1:]] > far[:-1]
    rows = rows.filter(pa.array(keep))
    yield {n: rows.column(n) for n in rows.column_names}


def fits(x: np.ndarray, y: np.ndarray, parts: list[list[int]]) -> bool:
    """Whether the words are long enough for the chain (two rows of one id may differ)."""
    return parts[-1][0] + parts[-1][2] <= len(x) and parts[-1][1] + parts[-1][2] <= len(y)


def ends(x: np.ndarray, y: np.ndarray, parts: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words before a chain, from it outwards, and those behind it."""
    b, a, _ = parts[0]
    e, f = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
    return [(x[:b][::-1], y[:a][::-1]), (x[e:], y[f:])]


def aligned(x: np.ndarray, y: np.ndarray, parts: list[list[int]], min_words: int, min_identity: float,
            reach: list[tuple[int, int, int]] | None = None) -> list[tuple]:
    """Passages of a chain: the whole chain with its extensions ``reach`` if it is long and alike
    enough, otherwise what is so on the diagonals of its stretches."""
    whole = align(x, y, parts, reach or extend(ends(x, y, parts)))
    b0, b1, a0, a1, equal = whole
    if min(b1 - b0, a1 - a0) >= min_words and equal >= min_identity * max(b1 - b0, a1 - a0):
        return [whole]
    out = []
    for d in sorted({b - a for b, a, _ in parts}):
        lo, hi = max(0, d), min(len(x), len(y) + d)
        same = x[lo:hi] == y[lo - d:hi - d]
        out += [(lo + i, lo + j, lo + i - d, lo + j - d, int(same[i:j].sum()))
                for i, j in alike(same, min_words, min_identity)]
    return out


def alike(same: np.ndarray, min_words: int, min_identity: float) -> list[tuple[int, int]]:
    """Separate stretches of at least ``min_words`` places and ``min_identity`` equal ones.

    The longest one is taken, less its ends where they have fewer equal words than
    others, then those on both sides of it.
    """
    out, open_ = [], [(0, len(same))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < min_words or same[lo:hi].sum() < min_identity * min_words:
            continue
        total = np.concatenate([[0.0], np.cumsum(same[lo:hi] - min_identity)])
        # The last place from which on no sum is as high as before the first.
        later = np.maximum.accumulate(total[::-1])[::-1]
        last = np.searchsorted(-later, -(total - 1e-9), "right") - 1
        i = int(np.argmax(last - np.arange(len(total))))
        j = int(last[i])
        if j - i < min_words:
            continue
        i, j = lo + i, lo + j
        open_ += [(lo, i), (j, hi)]
        equal = np.flatnonzero(same[i:j])
        for a, b in (_densest(same[i:j]), (int(equal[0]), int(equal[-1]) + 1)):
            if b - a >= min_words and same[i + a:i + b].sum() >= min_identity * (b - a):
                out.append((i + a, i + b))
                break
    return out


def _densest(same: np.ndarray, miss: int = 2) -> tuple[int, int]:
    """The stretch of the most equal places less ``miss`` for every other."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -miss))])
    gain = total - np.minimum.accumulate(total)
    end = int(np.argmax(gain))
    return int(np.flatnonzero(total[:end + 1] == total[end] - gain[end])[-1]), end


def align(x: np.ndarray, y: np.ndarray, parts: list[list[int]], reach: list[tuple[int, int, int]]) -> tuple:
    """(x start, x end, y start, y end, equal words) of a chain aligned on the words."""
    b, a, _ = parts[0]
    e, f = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
    equal, i, j = 0, b, a
    for pb, pa_, n in parts:
        equal += _common(x[i:pb], y[j:pa_]) + int((x[pb:pb + n] == y[pa_:pa_ + n]).sum())
        i, j = pb + n, pa_ + n
    (left_x, left_y, got), (right_x, right_y, more) = reach
    return b - left_x, e + right_x, a - left_y, f + right_y, equal + got + more


def extend(jobs: list[tuple[np.ndarray, np.ndarray]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """(words of x, words of y, equal words) of the best extension of each pair with gaps.

    All pairs go through one dynamic program side by side, at most ``reach`` words of x and
    BAND words off the diagonal. An equal word gains a point, an unequal one or a gap loses
    MISS, and cells DROP below the best so far are left. Points and equal words are one number.
    """
    n, unit, low = len(jobs), 1 << 12, -(1 << 40)
    if not n:
        return []
    # 0 and 1 pad the sides and equal nothing.
    one, two = np.zeros((n, reach), dtype=np.int64), np.ones((n, reach + 2 * BAND + 1), dtype=np.int64)
    for i, (x, y) in enumerate(jobs):
        x, y = x[:reach], y[:reach + BAND]
        one[i, :len(x)] = x.astype(np.int64) + 2
        two[i, BAND:BAND + len(y)] = y.astype(np.int64) + 2
    len_x = np.array([min(len(x), reach) for x, _ in jobs])
    len_y = np.array([min(len(y), reach + BAND) for _, y in jobs])
    shift = np.arange(2 * BAND + 1)
    cost = MISS * unit
    score = np.where(shift >= BAND, -cost * (shift - BAND), low)[None, :].repeat(n, axis=0)
    score[shift[None, :] - BAND > len_y[:, None]] = low
    best, place, row = np.zeros(n, dtype=np.int64), np.full(n, BAND), np.zeros(n, dtype=np.int64)
    for i in range(1, reach + 1):
        # Cell d of row i ends at word i of x and word i + d - BAND of y.
        same = one[:, i - 1, None] == two[:, i - 1:i + 2 * BAND]
        up = np.concatenate([score[:, 1:], np.full((n, 1), low)], axis=1) - cost
        score = np.maximum(score + np.where(same, unit + 1, -cost), up)
        reached = i + shift[None, :] - BAND
        score[(reached < 0) | (reached > len_y[:, None]) | (i > len_x[:, None])] = low
        score = np.maximum.accumulate(score + cost * shift, axis=1) - cost * shift
        score[(reached > len_y[:, None]) | (score < best[:, None] - DROP * unit)] = low
        top = score.argmax(axis=1)
        value = score[np.arange(n), top]
        better = value > best
        best[better], place[better], row[better] = value[better], top[better], i
        if (value <= low).all():
            break
    return [(int(i), int(i + d - BAND), int(v % unit)) for i, d, v in zip(row, place, best, strict=True)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Most equal words of two gaps in order."""
    if not len(x) or not len(y):
        return 0
    if len(x) == len(y) and (x == y).all():
        return len(x)
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for v in x:
        grown = row[:-1] + (y == v)
        row[1:] = np.maximum.accumulate(np.maximum(grown, row[1:]))
    return int(row[-1])


# --- cutting -----------------------------------------------------------------------------

def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the words of repeated passages cut out; the first occurrence stays.

    Columns stay, ``n_chars`` follows the text; the blanks behind a cut word go with it.
    Documents without passages, and rows without doc_id, are not shuffled or changed; an
    empty table stays empty.
    """
    arrow_batches(docs.sparkSession)
    spans = written(passages.groupBy("doc_id").agg(
        F.collect_list("start_word").alias("lo"), F.collect_list("end_word").alias("hi")), "spans")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # A struct has a field at least; this one's name is none of the table's.
    none = F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))
    rows = docs.select("doc_id", "text", F.struct(none, *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    some, others = maybe_in(rows, spans, "doc_id")
    known = some.join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("text")
            valid = column.is_valid().to_pylist()
            lists = [b.column(n).to_pylist() for n in ("lo", "hi")]
            hit = [i for i in range(b.num_rows) if valid[i] and lists[0][i]]
            texts = dict(zip(hit, _cut_texts(column.take(pa.array(hit, pa.int64())),
                                             [lists[0][i] for i in hit], [lists[1][i] for i in hit]),
                             strict=True))
            new = pa.array([texts.get(i) for i in range(b.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("rest"), new],
                                             ["doc_id", "text", "rest", "cut"])

    done = known.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cut", T.StringType())]))
    done = done.unionByName(others.withColumn("cut", F.lit(None).cast("string")))
    columns = {c: F.col(f"rest.`{c}`") if c in rest else F.col(c) for c in docs.columns}
    columns["text"] = F.coalesce("cut", "text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(
            F.col("cut").isNotNull(), F.char_length("cut").cast(docs.schema["n_chars"].dataType)
        ).otherwise(columns["n_chars"])
    return done.select(*[v.alias(c) for c, v in columns.items()])


def _cut_texts(texts: pa.Array, lo: list[list[int]], hi: list[list[int]]) -> list[str]:
    return [_cut(w, i, lo[w.at + i], hi[w.at + i]) for w in words(texts) for i in range(w.texts)]


def _cut(w, i: int, lo: list[int], hi: list[int]) -> str:
    at, end = w.first[i], w.first[i + 1]
    edge, parts = int(w.offsets[i]), []
    for a, b in sorted(zip(lo, hi, strict=True)):
        start = int(w.start[at + a])
        stop = int(w.start[at + b]) if at + b < end else int(w.offsets[i + 1])
        if start > edge:
            parts.append(w.data[edge:start].tobytes())
        edge = max(edge, stop)
    parts.append(w.data[edge:int(w.offsets[i + 1])].tobytes())
    return b"".join(parts).decode("utf-8")
