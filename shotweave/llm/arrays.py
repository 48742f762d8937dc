"""Vectorised text kernels that run inside Spark tasks.

Arrow hands a batch of strings over as one byte buffer with offsets. These functions find words in that buffer and give
each word a 64-bit fingerprint without a Python loop over words or rows. Work proceeds in chunks of a few megabytes, so
memory is bounded by the chunk, or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Fingerprint of ordered pairs of fingerprints."""
    return mix64(mix64(a + U(0x9E3779B97F4A7C15 + salt)) + b * U(0xD6E8FEB86659FD93))


_BYTE = mix64(np.arange(256, dtype=U) + U(0x1234567))
_PLACE = mix64(np.arange(1 << 16, dtype=U) + U(0xABCDEF01)) | U(1)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower case: digits, a-z and all of UTF-8 outside ASCII.
ALNUM = np.array([b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
#: Bytes of [^\x20\x09-\x0D]+.
NONSPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


@dataclass
class Words:
    """Words of several texts: fingerprints, byte places in the chunk, and where each text's words begin."""

    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray  # texts + 1 entries
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def place(self) -> np.ndarray:
        """Index of each word within its text."""
        return np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> Words:
    data = (LOWER if lower else SAME)[data]
    mask = is_word[data]
    begin = mask.copy()
    if len(mask) > 1:
        begin[1:] &= ~mask[:-1]
    edge = offsets[:-1][offsets[:-1] < len(mask)]
    begin[edge] = mask[edge]  # texts touch each other in the buffer
    place = np.flatnonzero(mask)
    start = np.flatnonzero(begin)
    if not len(start):
        empty = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=U), empty, empty, np.zeros(len(offsets), dtype=np.int64), data)
    head = np.flatnonzero(begin[place])
    length = np.diff(np.append(head, len(place)))
    within = np.arange(len(place)) - np.repeat(head, length)
    weight = _PLACE[within] if within.max() < len(_PLACE) else _PLACE[within % len(_PLACE)] + (within // len(_PLACE)).astype(U) * U(2)
    hashes = mix64(np.add.reduceat(_BYTE[data[place]] * weight, head) + length.astype(U))
    return Words(hashes, start, length, np.searchsorted(start, offsets), data)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def window_hash(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Fingerprint of h[i : i + size] for each i; the last size - 1 entries are meaningless."""
    n = len(h)
    out, covered, power, width = None, 0, mix64(h + U(salt)), 1
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out = power.copy()
            else:
                out[: max(0, n - covered)] = pair_hash(out[: max(0, n - covered)], power[covered:], salt + width)
            covered += width
        rest >>= 1
        if rest:
            step = power.copy()
            step[: max(0, n - width)] = pair_hash(power[: max(0, n - width)], power[width:], salt + 7)
            power, width = step, width * 2
    return out


def window_ok(first: np.ndarray, size: int) -> np.ndarray:
    """True where a run of `size` words that starts here stays in its text."""
    n = int(first[-1])
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + size <= end


def slices(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices of all entries of the given rows of a ragged array."""
    counts = first[rows + 1] - first[rows]
    skip = np.repeat(first[rows] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(rows) else np.zeros(0, dtype=np.int64)
    return np.arange(int(counts.sum())) + skip
