"""Vectorised words, word hashes and shingles over Arrow string columns.

A text is taken as its UTF-8 bytes. Every pass is a handful of numpy operations over a block of whole texts, so no
Python code runs per word. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_codes = np.arange(256)
#: Words as runs of anything but space and tab to carriage return.
NONSPACE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: Words as runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | ((_codes >= 65) & (_codes <= 90)) | (_codes >= 128)
#: Runs of ASCII letters and of everything beyond ASCII.
ALPHA = ((_codes >= 97) & (_codes <= 122)) | ((_codes >= 65) & (_codes <= 90)) | (_codes >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(8)
def _powers(n: int, inverse: bool) -> np.ndarray:
    p = np.full(n, _INVERSE if inverse else _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), inverse)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        kind, width = np.int32, 4
    else:
        kind, width = np.int64, 8
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * width).astype(np.int64)
    data = column.buffers()[2]
    if column.null_count:
        length = np.where(np.asarray(column.is_null()), 0, np.diff(off))
        if (length != np.diff(off)).any():
            return raw(column.fill_null(""))
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def blocks(off: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes, or of one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


class Words:
    """Words of texts i to j: doc (from 0), start and end (bytes into ``data``), and a hash of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, kind: np.ndarray = NONSPACE, lower: bool = True):
        lo, hi = int(off[i]), int(off[j])
        self.off = off[i : j + 1] - lo
        self.n_docs = j - i
        b = data[lo:hi]
        self.data = b = LOWER[b] if lower else b
        if not len(b):
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.count = np.zeros(self.n_docs, np.int64)
            return
        inside = kind[b]
        left, right = np.empty_like(inside), np.empty_like(inside)
        left[0], left[1:] = False, inside[:-1]
        right[-1], right[:-1] = False, inside[1:]
        at = self.off[1:-1]
        left[at[at < len(b)]] = False
        right[at[at > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~left)
        self.end = np.flatnonzero(inside & ~right) + 1
        self.count = np.diff(np.searchsorted(self.start, self.off))
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self._sums: np.ndarray | None = None
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges start to end."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(len(self.data))[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * powers(len(self.data) + 1, True)[start] + (end - start).astype(np.uint64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first shingle of each doc, hashes): ``width`` consecutive words; a shorter text's whole sequence is one."""
        return shingles(self.hash, self.count, width)


def shingles(h: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(count)))
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(int(at[-1]), np.uint64)
    if not len(out):
        return at, out
    src = np.repeat(first[:-1], n) + np.arange(len(out)) - np.repeat(at[:-1], n)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    limit = np.repeat(np.minimum(count, width), n)
    for k in range(width):
        part = padded[src + k] * _MULT[k]
        out += part if (limit > k).all() else np.where(limit > k, part, U(0))
    return at, mix(out + limit.astype(np.uint64))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
