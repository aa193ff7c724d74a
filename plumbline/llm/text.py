"""Words, shingles and minimum hashes of whole texts, many texts at a time.

A word is a run of bytes other than space and x09 to x0D; A-Z are lower-cased.
Texts stay in their Arrow buffer: all work is on byte and word arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.plans.workers import ship

ship(__name__)
CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES * 2)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a few texts: ``first[i]`` to ``first[i + 1]`` are those of text ``i``."""

    at: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of about CHUNK_BYTES each."""
    data, offsets = bytes_of(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(texts: pa.Array) -> Iterator[Words]:
    for at, data, offsets in chunks(texts):
        n = len(data)
        inner = ~_SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inner[:-1], inner[1:]
        start = np.flatnonzero(inner & (~before | cut[:-1]))
        end = np.flatnonzero(inner & (~after | cut[1:])) + 1
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[:n], out=total[1:])
        yield Words(at, data, offsets, start, end, np.searchsorted(start, offsets),
                    mix((total[end] - total[start]) * down[start]))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their first index per text.

    A text of fewer words has one shingle of all its words, an empty one none.
    """
    h, count = w.hash, np.diff(w.first)
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    starts = np.repeat(w.first[:-1] - first[:-1], per) + np.arange(first[-1])
    acc = np.zeros(len(starts), dtype=_U)
    limit = np.repeat(w.first[1:], per)
    for t in range(k):
        here = starts + t
        inside = here < limit
        part = h[np.where(inside, here, 0)] if len(h) else acc
        acc = np.where(inside, acc * _U(_BASE) + mix(part + _U(t + 1)), acc)
    return mix(acc), first


def sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    h, first = shingles(w, k)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def set_key(s: np.ndarray) -> bytes:
    """128-bit name of a set; equal sets have equal names."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature_seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=_U) * _U(_BASE))
    return x[:k].astype(np.uint32) | np.uint32(1), x[k:].astype(np.uint32)


def min_hashes(parts: list[np.ndarray], k: int) -> np.ndarray:
    """One row of ``k`` minimum hashes per set; an empty set has all ones."""
    out = np.full((len(parts), k), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, p in enumerate(parts) if len(p)]
    if full:
        x = (np.concatenate([parts[i] for i in full]) >> _U(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(parts[i]) for i in full])[:-1]])
        for j, (a, b) in enumerate(zip(*signature_seeds(k), strict=True)):
            y = x * a + b
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[full, j] = np.minimum.reduceat(y, at)
    return out
