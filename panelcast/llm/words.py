"""Words and hashed word n-grams of whole Arrow text columns, as numpy arrays.

A word is a run of bytes other than space and the controls 9 to 13; words are found in the UTF-8
buffer of a batch, so no string is made for each word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into numpy arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a chunk at most.
CHUNK_ROWS = 2048

SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.isin(np.arange(256), SPACES)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size == CHUNK_BYTES + 1:
            _powers[0] = have
    return have[0][:n], have[1][:n]


class Words(NamedTuple):
    """Words of a chunk: byte ranges, the row each belongs to, and each row's first word (rows + 1 entries)."""

    values: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, off, val = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(val, np.uint8) if val is not None else np.empty(0, np.uint8), offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes of text (one row at least): first row, row after, bytes, offsets."""
    values, offsets = buffers(column)
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = min(rows, a + CHUNK_ROWS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
        yield a, b, values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split_words(values: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~IS_SPACE[values]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads], stop[tails] = solid[heads], solid[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, offsets)
    return Words(values, offsets, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    """A hash for each word; ``lower`` folds A-Z only."""
    table, out, i = _BYTES_LOWER if lower else _BYTES, np.empty(len(w.start), np.uint64), 0
    while i < len(w.start):
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + CHUNK_BYTES, "right")))
        lo, hi = w.start[i], w.end[j - 1]
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[w.values[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = w.start[i:j] - lo, w.end[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the words that begin a window of k words of one row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    return np.arange(total) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every word on, rows ignored; len(hashes) - k + 1 entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at = np.empty(n, np.uint64), 0
    while at < n:
        to = min(n, at + CHUNK_BYTES // 2)
        up, down = powers(to - at + k)
        sums = np.zeros(to - at + k, np.uint64)
        np.cumsum(hashes[at : to + k - 1] * up[: to - at + k - 1], out=sums[1:])
        out[at:to] = mix((sums[k : k + to - at] - sums[: to - at]) * down[: to - at] + np.uint64(k))
        at = to
    return out


def shingle_sets(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes (A-Z folded) of each row, one after another, and their offsets.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    w = split_words(values, offsets)
    h = word_hashes(w, lower=True)
    grams = window_hashes(h, k)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for r in range(len(sizes)):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = window_hashes(h[a:b], b - a)
        else:
            continue
        sizes[r] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))
