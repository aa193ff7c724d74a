"""Packing token runs into sequences by shortest-pack-first over the length histogram.

Documents are tokenised and cut into full sequences and one remainder. Remainders
are known by their length only: a histogram of at most ``length`` counts is packed on
the driver, longest lengths first, each into the open pack with the least room that
still holds it. Packs of one pattern are counted, not listed. Documents then take
their place by their rank within their length: slot intervals of the patterns say
which sequence and offset a rank has.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, map_batches, need, written
from plumbline.plans.workers import ship

ship(__name__)
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 1024
END = 0
DEALS = 256
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Texts that the vocabulary file adds to the merges; each is one id wherever it stands."""
    added = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["added_tokens"]
    texts = [t["content"] for t in added]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) or any(
            a != b and a.startswith(b) for a in texts for b in texts):
        raise ValueError("added tokens that take blanks with them or begin with each other are not known here")
    return {t["content"]: t["id"] for t in added}


def encoder(path: str, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The byte-level BPE whose ranks are in ``path``, with the added tokens of
    ``vocabulary``; one per process. Encode with ``allowed_special="all"``."""
    if path not in _ENCODERS:
        lines = Path(path).read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens=added_tokens(vocabulary))
    return _ENCODERS[path]


def pieces(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): runs of at most ``length``
    ids of every document, its ids followed by the end id. ``row`` tells equal rows apart.
    """
    arrow_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        code = encoder(ranks)
        out = {n: [] for n in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = np.array([*code.encode(text or "", allowed_special="all"), END], dtype="<u4")
            for start in range(0, len(ids), length):
                part = ids[start:start + length]
                for n, v in zip(out, (doc_id, row, start, len(part), zlib.crc32(part.tobytes()),
                                      len(ids)), strict=True):
                    out[n].append(v)
        return out

    rows = need(docs, "doc_id", "text").select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return map_batches(rows, run, "doc_id bigint, row bigint, start bigint, length bigint, "
                                  "ids_crc32 bigint, doc_tokens bigint")


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs), packing the longest lengths first,
    always into the fullest pack that has room."""
    open_ = defaultdict(lambda: defaultdict(int))  # room left -> pattern -> packs
    for size in range(length, 0, -1):
        left = counts.get(size, 0)
        for room in range(size, length):
            while left and open_[room]:
                pattern, n = open_[room].popitem()
                take = min(left, n)
                open_[room - size][(*pattern, size)] += take
                if n > take:
                    open_[room][pattern] = n - take
                left -= take
            if not left:
                break
        if left:
            # As many of one length as fit, where nothing longer has room.
            each = length // size
            full, over = divmod(left, each)
            if full:
                open_[length - each * size][(size,) * each] += full
            if over:
                open_[length - over * size][(size,) * over] += 1
    return sorted((p, n) for packs in open_.values() for p, n in packs.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place in a pattern."""
    used, sequence, out = defaultdict(int), 0, []
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            out.append((size, used[size], n, sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return out


def pack(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Null and empty texts are one end id. Sequences hold at most ``length`` ids
    without gaps. Equal rows are packed each; an empty table gives no rows.
    """
    cut = written(pieces(docs, length, ranks), "pieces")
    # Ranks within a length: rows are numbered within (length, deal), deals by running sums.
    deal = F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(DEALS)).cast("int")
    order = W.partitionBy("length", "deal").orderBy("doc_id", "row", "start")
    numbered = written(cut.withColumn("deal", deal).withColumn("n", F.row_number().over(order)),
                       "numbered")
    sizes = numbered.groupBy("length", "deal").agg(F.max("n").alias("rows")).collect()
    counts, base = defaultdict(int), {}
    for size, part, n in sorted(tuple(r) for r in sizes):
        base[size * DEALS + part] = counts[size]
        counts[size] += n
    places = slots(pack_histogram(counts, length))
    keys = np.array(sorted(base), dtype=np.int64)
    bases = np.array([base[k] for k in keys.tolist()], dtype=np.int64)
    by_size = {s: np.array(sorted(p[1:] for p in places if p[0] == s), dtype=np.int64).T
               for s in counts}

    def place(b: pa.RecordBatch) -> dict:
        size = b.column("length").to_numpy()
        rank = bases[np.searchsorted(keys, size * DEALS + b.column("deal").to_numpy())] + (
            b.column("n").to_numpy() - 1)
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            first, _, at, off = by_size[s]
            slot = np.searchsorted(first, rank[mine], "right") - 1
            sequence[mine] = at[slot] + rank[mine] - first[slot]
            offset[mine] = off[slot]
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        return {n: b.column(n) for n in names} | {"sequence_id": sequence, "offset": offset}

    return map_batches(numbered, place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
                                        "doc_tokens bigint, sequence_id bigint, offset bigint")
