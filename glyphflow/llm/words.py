"""Vectorised word splitting and hashing over Arrow string batches.

A word is a run of ``[0-9a-z]`` and non-ASCII bytes after lower-casing A-Z, the
same as ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on the lower-cased text: every
byte of a multi-byte UTF-8 character is >= 0x80.  Nothing here loops over words
in Python: a batch becomes a few numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; one longer document is a block of its own.
BLOCK_BYTES = 2_000_000
SHINGLE = 5

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``codes[s:e]``; ``codes`` are uint64 and already spread."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = offsets[0] if len(offsets) else 0
    return data[low : offsets[-1] if len(offsets) else 0], offsets - low


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of about BLOCK_BYTES whole rows."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a block: ``row`` (within the block), ``start``/``end`` bytes and 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        inside = IS_WORD[low]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(inside))]
        before[cut] = False
        after[cut - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = run_hashes(_BYTE[low], self.start, self.end)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))  # of each row; n + 1 entries

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every k words in one row."""
        return grams(self.hash, self.row, k)


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[at + i]
    return at, mix(out)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all k-word shingles; a row of 1 to k - 1 words has one shingle of all its words."""
    at, h = words.grams(k)
    row = words.row[at]
    n = words.counts()
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            out = np.zeros(len(short), dtype=np.uint64)
            for i in range(size):
                out = out * _BASE + words.hash[words.first[short] + i]
            row, h = np.concatenate([row, short]), np.concatenate([h, mix(out + np.uint64(size))])
    return row, h


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
