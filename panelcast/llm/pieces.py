"""Texts as runs of word bytes in blocks of bounded size, however long a text is, and CRC-32 of many words at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from panelcast.llm.words import CHUNK_BYTES, chunks


class Block(NamedTuple):
    """Runs of a block: the row of the batch and the byte range in ``values`` of each; only the first ``own`` begin here.

    The runs after ``own`` are the next ones of the same text, so that n-grams beginning here are whole.
    """

    values: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    own: int


def runs(values: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every maximal run of bytes that ``solid`` (256 flags) marks; a run ends with its row."""
    mark = np.zeros(len(values) + 1, bool)
    mark[:-1] = solid[values]
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    stop = np.zeros(len(values) + 1, bool)
    stop[1:] = mark[:-1] & ~mark[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(values))]
    joined = inner[mark[inner] & mark[inner - 1]]
    begin[joined] = stop[joined] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    return np.searchsorted(offsets, start, "right") - 1, start, end


def _until(values: np.ndarray, solid: np.ndarray, at: int, count: int) -> int:
    """A byte position at or after ``at`` that is no run's inside and has ``count`` more whole runs before it, or the end."""
    step = 1 << 12
    while at < len(values):
        part = solid[values[at : at + step]]
        rest = np.flatnonzero(~part)
        if len(rest):
            if count == 0:
                return at + int(rest[0])
            heads = np.flatnonzero(part[1:] & ~part[:-1]) + 1
            tails = rest[np.searchsorted(rest, heads[: count])] if len(heads) >= count and rest[-1] > heads[count - 1] else None
            if tails is not None:
                return at + int(tails[-1])
        if at + step >= len(values):
            return len(values)
        step *= 4
    return len(values)


def blocks(column: pa.Array, solid: np.ndarray, n: int = 1, fold: np.ndarray | None = None, limit: int = CHUNK_BYTES) -> Iterator[Block]:
    """Runs of ``solid`` bytes of every text; a text of more than twice ``limit`` bytes comes in several blocks.

    ``fold`` maps bytes first.  A null text has no runs.  A run is never cut, so one longer than ``limit`` is a block.
    """
    for a, _, values, offsets in chunks(column, limit):
        if fold is not None:
            values = fold[values]
        if len(offsets) > 2 or len(values) <= 2 * limit:
            row, start, end = runs(values, offsets, solid)
            yield Block(values, row + a, start, end, len(start))
            continue
        at = 0
        while at < len(values):
            cut = _until(values, solid, at + limit, 0)
            stop = _until(values, solid, cut, n - 1) if n > 1 else cut
            part = values[at:stop]
            row, start, end = runs(part, np.array([0, len(part)]), solid)
            yield Block(part, row + a, start, end, int(np.searchsorted(start, cut - at)))
            at = cut


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _table()
#: Longer runs are handed to zlib one by one.
_LONG = 64


def crc32(values: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each byte range; ``before`` is the CRC of what precedes each."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    s, size = start[order], length[order]
    out = np.zeros(len(start), np.uint32) if before is None else before[order]
    first = int(np.searchsorted(-size, -_LONG))  # those before it are longer than _LONG
    for i in range(first):
        out[i] = zlib.crc32(values[s[i] : s[i] + size[i]].tobytes(), int(out[i]))
    c, s, size = ~out[first:], s[first:], size[first:]
    for at in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -at))
        c[:k] = _CRC[(c[:k] ^ values[s[:k] + at]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
    out[first:] = ~c
    back = np.empty_like(out)
    back[order] = out
    return back
