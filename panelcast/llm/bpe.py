"""Byte-level BPE encoding and decoding with a given rank file, on padded numpy matrices.

A text is cut into pieces by a pattern; each piece is merged on its own.  Different pieces of a batch
are put into matrices by length (4, 8, 16 ... bytes).  In each round every row merges its leftmost
pair of least rank; ranks come from an open-addressing hash table over pairs of ids, finished rows are
taken out and the rest is compacted.  A piece longer than ``LONGEST`` bytes (a run of one letter over a
whole text, say) would need as many rounds as it has bytes, each over the whole row; it takes the same
merges in the same order from a heap instead.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.workers import tidy

#: Longest piece that goes through the matrices.
LONGEST = 256
#: Cells of a matrix; entries of a task's cache of pieces and the longest piece kept there.
CELLS, CACHE, CACHE_BYTES = 1 << 18, 250_000, 64
#: Characters of a text, or ids, that are turned into Python objects at a time.
BLOCK = 1 << 20
_NONE = np.int32(2**31 - 1)


class Tokenizer:
    """Ranks of a ``.tiktoken`` file and the table of their pairs."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if rank}
        self.find, self.iterate = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.span = np.uint64(len(self.tokens))
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._build(np.array(left, np.uint64) * self.span + np.array(right, np.uint64), np.array(merged, np.int32))
        self.cache: dict[str, bytes] = {}

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self, codes: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(codes) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.merged = np.full(1 << bits, _NONE, np.int32)
        at, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[left][free], return_index=True)
            placed = left[free][first]
            self.keys[at[placed]], self.merged[at[placed]] = codes[placed], merged[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = np.where(self.keys[at[left]] == np.uint64(2**64 - 1), at[left], (at[left] + 1) & self.mask)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of the merge of each pair, _NONE where there is none or an id is padding (-1)."""
        shape = left.shape
        codes = (left.astype(np.int64) * np.int64(self.span) + right).ravel().astype(np.uint64)
        real = ((left >= 0) & (right >= 0)).ravel()
        out = np.full(len(codes), _NONE, np.int32)
        todo = np.flatnonzero(real)
        at = self._slot(codes[todo])
        while len(todo):
            keys = self.keys[at]
            hit = keys == codes[todo]
            out[todo[hit]] = self.merged[at[hit]]
            go = ~hit & (keys != np.uint64(2**64 - 1))
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, number of ids of each, their ids one after another) of pieces of at most ``width`` bytes, as they are done."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        place = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(place):
            best = ranks.argmin(axis=1)
            rows = np.arange(len(place))
            rank = ranks[rows, best]
            done = rank == _NONE
            if done.any():
                ready = ids[done]
                yield place[done], lengths[done], ready[ready >= 0]
                go = ~done
                ids, ranks, place, lengths, best, rank = ids[go], ranks[go], place[go], lengths[go], best[go], rank[go]
                if not len(place):
                    return
                most = max(2, int(lengths.max()))
                ids, ranks, columns = ids[:, :most], ranks[:, : most - 1], columns[:most]
                rows = np.arange(len(place))
            ids[rows, best] = rank
            source = np.minimum(columns + (columns > best[:, None]), len(columns) - 1)
            ids = np.take_along_axis(ids, source, 1)
            lengths = lengths - 1
            ids[rows, lengths] = -1
            # pairs right of the merge move up by one, the two that touch it are looked up anew
            wide = len(columns) - 1
            source = np.minimum(columns[:wide] + (columns[:wide] > best[:, None]), wide - 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[rows, lengths - 1] = _NONE
            after = np.minimum(best + 1, wide)
            right = np.where(best + 1 < lengths, ids[rows, after], -1)
            ranks[rows, np.minimum(best, wide - 1)] = np.where(best < wide, self.pair_ranks(ids[rows, best], right), _NONE)
            has = best > 0
            r, b = rows[has], best[has]
            ranks[r, b - 1] = self.pair_ranks(ids[r, b - 1], ids[r, b])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges by a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev, pair = list(range(1, n + 1)), list(range(-1, n - 1)), {}
        tokens, ranks, heap = self.tokens, self.ranks, []

        def push(i: int) -> None:
            j = nxt[i]
            rank = ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None
            pair[i] = rank
            if rank is not None:
                heapq.heappush(heap, (rank, i))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i = heapq.heappop(heap)
            if pair.get(i) != rank:
                continue
            j = nxt[i]
            ids[i], nxt[i] = rank, nxt[j]
            pair[j] = None
            ids[j] = -1
            if nxt[j] < n:
                prev[nxt[j]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        pieces = list(pieces)
        raws = [p.encode() for p in pieces]
        out = {p: r.to_bytes(4, "little") for p, r in zip(pieces, map(self.ranks.get, raws), strict=True) if r is not None}
        left = [i for i, p in enumerate(pieces) if p not in out]
        lengths = np.fromiter((len(raws[i]) for i in left), np.int64, len(left))
        widths = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        order = np.array(left, np.int64)
        for i in order[lengths > LONGEST].tolist():
            out[pieces[i]] = self._long(raws[i]).astype("<u4").tobytes()
        for width in np.unique(widths[lengths <= LONGEST]).tolist():
            own = order[widths == width].tolist()
            step = max(1, CELLS // width)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                for places, counts, ids in self._matrix([raws[i] for i in part], width):
                    blob, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                    for i, x, y in zip(places.tolist(), (ends - 4 * counts).tolist(), ends.tolist(), strict=True):
                        out[pieces[part[i]]] = blob[x:y]
        return out

    def _learn(self, pieces: list[list[str]]) -> dict[str, bytes]:
        """Puts the pieces into the cache; returns the long ones, which are not kept."""
        have = self.cache
        new = {p for ps in pieces for p in ps if p not in have}
        if len(have) + len(new) > CACHE:
            self.cache, new = {}, set().union(*pieces)
        fresh = self.encode_pieces(new)
        long = {p: ids for p, ids in fresh.items() if len(p) > CACHE_BYTES}
        for p in long:
            del fresh[p]
        self.cache.update(fresh)
        return long

    def _join(self, pieces: list[str], long: dict[str, bytes]) -> bytes:
        get = self.cache.get
        return b"".join([get(p) or long[p] for p in pieces] if long else map(self.cache.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed little-endian integers; each different piece of the batch is merged once."""
        pieces = [self.find(t) if t and len(t) <= BLOCK else [] for t in texts]
        long = self._learn(pieces)
        out = [self._join(ps, long) for ps in pieces]
        for i, t in enumerate(texts):
            if t and len(t) > BLOCK:  # a block of pieces at a time
                matches, parts = self.iterate(t), []
                while ps := [m[0] for m in islice(matches, BLOCK // 8)]:
                    parts.append(self._join(ps, self._learn([ps])))
                out[i] = b"".join(parts)
        return out

    def decode(self, ids: bytes) -> bytes:
        token, step = self.tokens.__getitem__, 4 * BLOCK
        return b"".join(b"".join(map(token, np.frombuffer(ids[a : a + step], "<u4").tolist())) for a in range(0, len(ids), step))


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file, read once a process; every executor must have the file at ``path``."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(path, pattern)
    return _loaded[path, pattern]


#: Rows of text that are held as Python strings at a time.
ROWS = 256


def _free(df: DataFrame, *names: str) -> None:
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            yield whole.slice(a, ROWS)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", back: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``_ids``: the token ids of ``text``, packed as little-endian unsigned 32-bit integers.

    With ``back`` also ``_bytes``, what the ids decode to, in the same pass.  Null and empty texts have no
    ids.  Special tokens are ordinary text.  Other columns, their nulls and repeated rows pass through;
    columns of the new names are refused.  An empty table gives an empty one.
    """
    new = ["_ids", "_bytes"] if back else ["_ids"]
    _free(docs, *new)

    def run(batches):
        t = tokenizer(path, pattern)
        t.cache = {}  # workers outlive their tasks; what they remember does not
        for batch in _sliced(batches):
            ids = t.encode(batch.column(text).to_pylist())
            out = [pa.array(ids, pa.binary())] + ([pa.array(map(t.decode, ids), pa.binary())] if back else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *new])
        t.cache = {}

    return docs.mapInArrow(tidy(run), docs.select("*", *(F.lit(b"").alias(n) for n in new)).schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``encoded`` but ``_ids``, which becomes ``_bytes``: the bytes of the tokens one after another; null ids give null."""
    _free(encoded, "_bytes")

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in _sliced(batches):
            raw = [None if x is None else t.decode(x) for x in batch.column("_ids").to_pylist()]
            rest = batch.drop_columns(["_ids"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(raw, pa.binary())], [*rest.schema.names, "_bytes"])

    return encoded.mapInArrow(tidy(run), encoded.drop("_ids").withColumn("_bytes", F.lit(b"")).schema)
