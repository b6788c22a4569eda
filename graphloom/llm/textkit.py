"""Vectorised word tools over Arrow text columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z fold to a-z. Hashes are 64-bit and
equal on every executor. Work goes through chunks of whole documents, so memory follows the longest
document and not the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Blanks and ASCII signs: what is left are runs of letters and digits.
SIGNS = np.array([chr(i).isascii() and not chr(i).isalnum() for i in range(256)])
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or of its inverse, modulo 2^64."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), _BASE if which == "up" else _BASE_INV, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a chunk of texts; those of text i are first[i]:first[i + 1]."""

    hashes: np.ndarray
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    text_at: np.ndarray  # byte offset of each text, and the end
    total: np.ndarray  # running sum under the word hashes

    def heads(self, size: int) -> np.ndarray:
        """Hash of the first size bytes of each word, or of the whole word if it has fewer."""
        stop = np.minimum(self.start + size, self.end)
        return mix((self.total[stop] - self.total[self.start]) * _power("down", len(self.total))[self.start] + np.uint64(0x1000003) * np.uint64(size))

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; those that leave their text mean nothing."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hashes[j : j + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1) + 0x632BE5AB * j) & (2**64 - 1) | 1)
        return mix(out)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return at - at[0], raw


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of whole rows of about limit bytes."""
    at, raw = texts(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, at[i : j + 1] - at[i], raw[at[i] : at[j]]
        i = j


def words(at: np.ndarray, raw: np.ndarray, blank: np.ndarray = _BLANK) -> Words:
    n = len(raw)
    solid = ~blank[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    left = edge[:n].copy()
    right = edge[1:].copy()
    left[1:] |= ~solid[:-1]
    right[:-1] |= ~solid[1:]
    start = np.flatnonzero(solid & left)
    end = np.flatnonzero(solid & right) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * _power("up", n), out=total[1:])
    hashes = mix((total[end] - total[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))
    return Words(hashes, start, end, np.searchsorted(start, at).astype(np.int64), raw, at, total)


def set_of(w: Words, i: int, k: int, grams: np.ndarray) -> np.ndarray:
    """Sorted distinct k-word shingles of text i; with fewer words the whole sequence is the only one."""
    a, b = int(w.first[i]), int(w.first[i + 1])
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    if b == a:
        return np.empty(0, np.uint64)
    short = np.array([b - a], np.uint64)
    for h in w.hashes[a:b]:
        short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h)
    return short
