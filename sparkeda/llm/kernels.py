"""Vectorised numpy kernels over Arrow string buffers.

A batch of texts is one byte buffer with offsets. Words are found, hashed and
windowed for the whole buffer at once, so no Python object exists per word.
Hashes are 64-bit and a pure function of the bytes: every executor, attempt and
partitioning gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit values (multiply and shift rounds), so that all bits depend on all bits."""
    x = x ^ _U((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_AGAIN = mix(np.arange(1, 257, dtype=np.uint64), 11)


def _powers(n: int, base: int, held: dict = {}) -> np.ndarray:  # noqa: B006  kept between calls on purpose
    p = held.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if n <= 4 * BLOCK_BYTES:
            held[base] = p
    return p[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash values[start:end] for many spans with one prefix sum of a polynomial modulo 2^64."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(n, _BASE), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _powers(n + 1, _BASE_INV)[start]
    return mix(h ^ ((end - start).astype(np.uint64) << _U(40)), seed)


@dataclass
class Words:
    """Words of a block of documents: row (document in the block), byte span and hash of each word."""

    data: np.ndarray
    doc_start: np.ndarray
    first: np.ndarray  # of each document its first word; one more entry at the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of documents data[offsets[i]:offsets[i + 1]]."""
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    h = span_hashes(_BYTE[data], start, end)
    return Words(data, offsets, first, start, end, h)


def other_hashes(w: Words) -> np.ndarray:
    """A second hash of each word, from other values of its bytes."""
    return span_hashes(_BYTE_AGAIN[w.data], w.start, w.end, 13)


def text_blocks(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cut a string column (null: empty) into blocks (rows, bytes, offsets) of about BLOCK_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, n)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def windows(w: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of so many consecutive words within one document."""
    n = len(w.hash)
    last = np.repeat(w.first[1:], w.counts)
    at = np.flatnonzero(np.arange(n) + size <= last)
    return at, span_hashes(w.hash, at, at + size, seed)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
