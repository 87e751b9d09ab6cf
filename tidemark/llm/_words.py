"""Vectorised word and shingle hashing over whole Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, the same in bytes
and in characters because UTF-8 never uses those bytes inside a character.  A
word's 64-bit hash is a polynomial over random byte values, taken from one
running sum over the batch, so no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTES = mix64(np.arange(1, 257, dtype=_U) * _ODD)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]  # A-Z as a-z
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte spans, hashes, and each text's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        n = len(raw)
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        bounds = offsets[(offsets > 0) & (offsets < n)]
        before[bounds] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[bounds - 1] = False
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        #: Word i of text t has index first[t] + i; first has one entry more than there are texts.
        self.first = np.searchsorted(self.start, offsets)
        up, self._down = _powers_to(n)
        self._total = np.zeros(n + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((_BYTES_LOWER if lower else _BYTES)[raw] * up[:n], out=self._total[1:])
        self.hash = self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        with np.errstate(over="ignore"):
            return mix64((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(_U))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    return Words(*text_buffer(column), lower)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes (none if there are fewer)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = np.zeros(count, _U)
        for i in range(n):
            total = total * _U(_BASE) + words[i : i + count]
        return mix64(total + _U(n) * _ODD)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """As gram_hashes, in time that doesn't depend on n: one rolling sum."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    up, down = _powers_to(len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, _U)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix64((total[n:] - total[:-n]) * down[:count] + _U(n) * _ODD)


def run_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive bytes (none if there are fewer)."""
    if len(raw) < n:
        return np.zeros(0, _U)
    up, down = _powers_to(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
        return mix64((total[n:] - total[:-n]) * down[: len(raw) - n + 1])
