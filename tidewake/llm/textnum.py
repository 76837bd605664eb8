"""Words and hashes of many texts at once, on numpy arrays over Arrow's own buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; these are ASCII, so cutting UTF-8 there is safe.
Hashes have 64 bits, so two different strings of one corpus share one with a chance near 2**-55 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for uses in which marks don't matter.
MARKS = _SPACE.copy()
MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = [U(x) for x in (0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(n, base, U)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=U)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(a) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(a) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text, one row at least: bounds the memory that a slice needs."""
    _, at = raw(batch.column(column))
    k, n = 0, batch.num_rows
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield batch.slice(k, j - k)
        k = j


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and for each text the number of its first word (one more entry than texts)."""
    out = ~between[data]
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[:1] = False
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(out & ~before)
    after = np.empty_like(out)
    after[:-1] = out[1:]
    after[-1:] = False
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(out & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Of each word, after A-Z became a-z if lower."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[_LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Of the `size` bytes from each place."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
    n = max(0, len(data) - size + 1)
    return mix((total[size : size + n] - total[:n]) * inverse[:n])


def shingles(w: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words, and for each text the number of its first one.

    A text with fewer words, but one at least, has its whole sequence as its only shingle.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    full = np.repeat(np.minimum(n, size), count)
    h = full.astype(U)
    padded = np.concatenate((w, np.zeros(size, U)))
    for k in range(size):
        h = h + np.where(k < full, padded[at + k] * _STEPS[k % len(_STEPS)] + U(k), U(0))
        h = h ^ (h >> U(29))
    return mix(h), begin
