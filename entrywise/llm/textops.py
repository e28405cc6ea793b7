"""Vectorised word and hash primitives over Arrow string arrays.

Texts are handled as one byte buffer per block of a few megabytes, so memory is
bounded by the block (or by the longest single text, if that is longer) and not
by the Arrow batch. A word is a maximal run of bytes other than 0x20 and
0x09-0x0D; UTF-8 continuation bytes are never white space, so byte runs and
character runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=_U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=_U))[0])


@dataclass
class Block:
    """Some consecutive texts: row numbers lo..hi of the batch, their bytes and offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, most: int = 4096) -> Iterator[Block]:
    """Cut an Arrow string array into blocks of about `limit` bytes and at most `most` texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, off, raw = texts.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + most)
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """Word spans of a block, in order, with the text (0..n-1) each belongs to."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words(block: Block) -> Words:
    data, offs = block.data, block.offs
    size = len(data)
    if size == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    begin = cuts[cuts < size]
    first[begin] = inside[begin]
    stop = cuts[(cuts > 0)] - 1
    last[stop] = inside[stop]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(offs, start, "right") - 1
    return Words(start, end, doc)


class SpanHash:
    """64-bit hashes of any byte spans of a buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        p = powers(_BASE, len(data) + 1)
        self._inv = powers(inverse(_BASE), len(data) + 1)
        self._prefix = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * p[:-1], out=self._prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._prefix[end] - self._prefix[start]) * self._inv[start]
        return mix(h + (end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


class RollingHash:
    """Hashes of all windows of n consecutive word hashes, each n at constant cost a window."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n = n
        self._inv = powers(inverse(_WORD_BASE), n + 1)
        self._prefix = np.zeros(n + 1, dtype=_U)
        np.cumsum(hashes * powers(_WORD_BASE, n + 1)[:-1], out=self._prefix[1:])

    def windows(self, n: int) -> np.ndarray:
        if self.n < n:
            return np.zeros(0, _U)
        h = (self._prefix[n:] - self._prefix[: self.n - n + 1]) * self._inv[: self.n - n + 1]
        return mix(h + _U(n) * _U(0x165667B19E3779F9))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._prefix[end] - self._prefix[start]) * self._inv[start]
        return mix(h + (end - start).astype(_U) * _U(0x165667B19E3779F9))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice) == 0:
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
