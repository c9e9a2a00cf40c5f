"""Vectorised word and shingle hashing over Arrow string columns.

The byte buffer of a whole Arrow batch is turned into word boundaries and 64-bit word hashes with NumPy, without a
Python object per word. Used inside ``mapInArrow`` tasks; nothing here knows about Spark.

Nulls have no words. Upper-case ASCII letters count as lower case; other letters are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SLICE_ROWS = 4096

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C17)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U64) | U64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Digits, letters and every byte of a non-ASCII character: the words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
#: All but ASCII white space: the words of ``[^\x20\x09-\x0D]+``.
NONSPACE_BYTES = np.ones(256, bool)
NONSPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        inverse = U64(pow(int(_STEP), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _STEP)]))
        _inverses = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, inverse)]))
    return _powers, _inverses


@dataclass
class Words:
    """Words of a slice of rows: row, 64-bit hash, and byte range in ``data``; ``first[i]`` is row i's first word."""

    row0: int
    n_rows: int
    data: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES bytes and SLICE_ROWS rows, with one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        upto = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        upto = min(max(upto, at + 1), at + SLICE_ROWS, n)
        yield at, upto
        at = upto


def words(column: pa.Array, kept: np.ndarray) -> Iterator[Words]:
    """Words of each slice of the column; ``kept`` says which (lower-cased) bytes words are made of."""
    offsets, data = string_buffers(column)
    for lo, hi in slices(offsets):
        begin, stop = int(offsets[lo]), int(offsets[hi])
        raw = _LOWER[data[begin:stop]]
        at = (offsets[lo : hi + 1] - begin).astype(np.int64)
        size = len(raw)
        inside = kept[raw]
        breaks = np.zeros(size + 1, bool)
        breaks[at] = True
        before = np.empty(size, bool)
        if size:
            before[0] = False
            before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | breaks[:-1]))
        after = np.empty(size, bool)
        if size:
            after[-1] = False
            after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        powers, inverses = _power_tables(size + 1)
        sums = np.zeros(size + 1, U64)
        np.cumsum(_BYTE_CODES[raw] * powers[:size], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(U64))
        first = np.searchsorted(start, at)
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(first))
        yield Words(lo, hi - lo, raw, row, h, start, end, first)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each run of k words within a row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    h = w.hash[at].copy()
    for j in range(1, k):
        h = h * _MIX2 + w.hash[at + j]
    return at, mix(h + U64(k))
