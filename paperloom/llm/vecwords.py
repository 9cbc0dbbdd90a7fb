"""Words, lines and their 64-bit hashes for a whole Arrow batch at once, by numpy.

A text column arrives as one byte buffer with offsets. Words are maximal runs of bytes
that a 256-entry table does not call separators; a run never crosses from one text to
the next. A word's hash is a polynomial over its bytes, taken from one prefix sum for
the whole batch, then mixed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks each segment of offsets holds; segments may be empty."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    have = POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = U(1)
        have = POWERS[int(base)] = np.multiply.accumulate(have)
    return have[:n]


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``hash``, and ``first``, the
    offsets of each text's words (one more than there are texts)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        word = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate((np.zeros(1, bool), word[:-1])) if len(raw) else word
        opens = word & (~before | edge[:-1])
        after = np.concatenate((word[1:], np.zeros(1, bool))) if len(raw) else word
        closes = word & (~after | edge[1:])
        self.raw, self.word = raw, word
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)

    @functools.cached_property
    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial, in one array of eight bytes a byte."""
        out = np.zeros(len(self.raw) + 1, U)
        np.add(self.raw, U(1), out=out[1:])
        out[1:] *= powers(len(self.raw), BASE)
        return np.cumsum(out, out=out)

    def span(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [a, z)."""
        h = (self.prefix[z] - self.prefix[a]) * powers(len(self.raw) + 1, BASE_INV)[a]
        return mix(h + (z - a).astype(U) * U(0xA24BAED4963EE407))

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return self.span(self.start, self.end)

    def owner(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, where each starts, and their offsets by text."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * U(0x9FB21C651E98DF25)
        out ^= out >> U(29)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], counts)
    return mix(out[at]), at, offsets
