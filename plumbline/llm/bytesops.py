"""Vectorised work on the UTF-8 bytes of Arrow string columns.

All texts of a slice are handled as one byte array. ASCII classes can be told from bytes alone, as every byte of a
non-ASCII character is 0x80 or above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 512 << 10

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes a class of ASCII characters takes in; bytes from 0x80 count as the character U+00FF does."""
    rule = re.compile(pattern.encode("latin-1"))
    return np.array([rule.fullmatch(bytes([b])) is not None for b in range(256)])


#: Words are runs of anything but ASCII white space.
SPACED = byte_class(r"[^\x20\x09-\x0D]")
#: Words are runs of digits, lower-case letters and anything outside ASCII (after lower-casing A-Z).
ALNUM = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return body, ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about as many bytes of text each."""
    _, ends = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(n, factor & _MASK, np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose scaled differences are polynomial hashes of substrings."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice: lower-cased bytes, byte spans, the text each word belongs to and its hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, and the total at the end

    def text(self, at: int, n: int) -> bytes:
        """The n words from `at`, joined by spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[at : at + n], self.end[at : at + n], strict=True))


def words_of(column: pa.Array, accepted: np.ndarray) -> Words:
    """Maximal runs of accepted bytes after lower-casing A-Z; they don't cross texts."""
    body, ends = raw(column)
    data = LOWER[body]
    inside = accepted[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cuts = ends[(ends > 0) & (ends < len(data))]
    edge[cuts] = inside[cuts]
    start = np.flatnonzero(edge)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    end = np.flatnonzero(last) + 1
    first = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    return Words(data, start, end, doc, span_hash(prefix_hash(data), start, end), first)


def ngram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, by first word; windows may cross texts and must be filtered."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total *= np.uint64(_BASE)
        total += hashes[j : j + m]
    return mixed(total + np.uint64(n))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def winnowed(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some window of `width` values; all equal minima are taken.

    Whether a window takes a position depends on the window's own values alone, so equal windows take equal positions.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = window_minimum(values, width)
    taken = np.zeros(len(values), bool)
    for j in range(width):
        taken[j : j + len(least)] |= values[j : j + len(least)] == least
    return np.flatnonzero(taken)
