"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Method.  Shingles are hashed to 64 bits; the leading bits put a shingle into one of m segments, where
m depends on the size band of the set.  Linked sets r, s differ in at most (|r| + |s|) / 7 shingles at
a similarity of 3/4, so when a set has more non-empty segments than that bound, some segment of the
two is identical (pigeonhole).  A set signs a prefix of its segments, just long enough for the bound.

Allocation by cost.  Signatures that many sets share are expensive.  The sharing of every signature
is counted; a set whose cheap signatures alone exceed the bound needs no expensive one (their
allocation is 0).  Sets that fall short sign again, now with one-deletion neighbourhoods: a segment of
two or more shingles counts 2, as it also matches when one shingle differs.  The bound holds for the
set of a pair whose prefix ends first, and the other one may well be settled; so every set that shares
an expensive signature with a short one signs again too.  Signatures with a holder that is still short
(in large near-copy groups, in practice) are kept with all their holders.  These are compared with one
hub of each signature, and then across the components that these links leave apart; only pairs without
a short set are left out, as they have met.  Shingles that no other of these holders has count as
differences of every pair, which settles many of those pairs unseen, as do the parities of hashed shingle counts.

A pair must pass a bound on parities in two to four cells a shingle before the texts are fetched, and is then
verified on the full shingle sets.  Equal sets are one node throughout, and one row of each is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.blocks import Packer, bitmap, bucket_count, bucket_names, in_bitmap, schema, unpack
from panelcast.llm.graph import by_size, components, stars
from panelcast.llm.words import chunks, mix, shingle_sets
from panelcast.llm.workers import tidy, tidy_group
from panelcast.session import cut_lineage

#: Similarity is NUM / DEN; the bounds below follow from it.
NUM, DEN = 3, 4
#: A signature of at most this many sets is cheap: its pairs are written out (at most 28).
CHEAP = 8
#: Ratio of band limits; share of segments signed beyond the bound, so that a few may be expensive.
BAND_RATIO, SPARE = 3.0, 0.08

_BANDS = [3]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(max(_BANDS[-1] + 1, int(_BANDS[-1] * BAND_RATIO)))
BANDS = np.array(_BANDS, np.int64)
_RECORD = {"band": "u1", "key": "<u4", "id": "<u8", "weight": "u1"}
_SHINGLE = {"key": "<u4", "id": "<u8"}
#: Cells of the parities of a set: a power of two, twice its shingles at least, within these limits.
LEAST_CELLS, MOST_CELLS = 64, 1 << 20


def _differences(a: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Most shingles in which a set of size ``a`` and a linked one of at most ``limit`` can differ."""
    partner = np.minimum(limit, a * DEN // NUM)
    return (a + partner) * (DEN - NUM) // (DEN + NUM)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Signed:
    """Signatures of a chunk of sets for one choice of band (0: own, 1: next) and level (0, 1); without ``keys`` their slack alone."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, next_band: bool, deletions: bool, keys: bool = True) -> None:
        sizes = np.diff(offsets)
        own = np.searchsorted(BANDS, sizes)
        if next_band:
            used = (sizes > 0) & (sizes * DEN >= NUM * (BANDS[own] + 1))
            own = own + 1
        else:
            used = sizes > 0
        limit = BANDS[own]
        bound = _differences(sizes, limit)
        most = limit * 2 * (DEN - NUM) // (DEN + NUM) + 1
        m = (most + (most * SPARE * 2).astype(np.int64) + (most > 1)).astype(np.uint64)
        self.band, self.used = own, used
        row = np.repeat(np.arange(len(sizes)), np.where(used, sizes, 0))
        tokens = tokens[np.repeat(used, sizes)]
        seg = ((tokens >> np.uint64(32)) * m[row]) >> np.uint64(32)
        at = _runs(row, seg)
        held = np.diff(np.append(at, len(tokens)))
        seg_row, seg_id = row[at], seg[at]
        worth = np.minimum(held, 2) if deletions else np.ones(len(at), np.int64)
        total = np.bincount(seg_row, worth, len(sizes)).astype(np.int64)
        need = bound + 1
        goal = need + np.where(need > 1, np.maximum(1, (need * SPARE).astype(np.int64)), 0)
        before = np.cumsum(worth) - worth
        heads = _runs(seg_row)
        base = np.zeros(len(sizes), np.int64)
        base[seg_row[heads]] = before[heads]
        before = before - base[seg_row]
        signed = before < goal[seg_row]
        self.slack = np.bincount(seg_row[signed], worth[signed], len(sizes)).astype(np.int64) - need
        lost = used & (total < need) & deletions  # too few shingles apart from each other: sign every shingle
        self.slack[lost] = 0
        if not keys:
            return
        mixed = mix(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF))
        sums = np.add.reduceat(mixed, at) if len(at) else np.empty(0, np.uint64)
        salt = mix(own[seg_row].astype(np.uint64) << np.uint64(40) ^ seg_id)
        keys, rows, weight = [mix(sums + salt)[signed]], [seg_row[signed]], [worth[signed]]
        if deletions:
            where = np.repeat(np.arange(len(at)), held)
            out = (signed & (held > 1))[where]
            keys.append(mix((sums[where] - mixed + salt[where])[out]))
            rows.append(row[out])
            weight.append(np.ones(int(out.sum()), np.int64))
            weight[0] = np.where(lost[rows[0]], 0, weight[0])
            weight[1] = np.where(lost[rows[1]], 0, weight[1])
            each = lost[row]
            keys.append(mix(mixed[each] + mix(own[row[each]].astype(np.uint64) + np.uint64(77))))
            rows.append(row[each])
            weight.append(np.ones(int(each.sum()), np.int64))
        self.key, self.row, self.weight = np.concatenate(keys), np.concatenate(rows), np.concatenate(weight)


def _set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set (equal sets, equal ids); 0 for an empty one."""
    sizes = np.diff(offsets)
    sums = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        sums[full] = mix(np.add.reduceat(mix(tokens + np.uint64(0x1234567)), offsets[:-1][full]) + sizes[full].astype(np.uint64))
    return sums


def _sets(batches: Iterator[pa.RecordBatch], k: int, only: np.ndarray | None = None) -> Iterator[tuple]:
    """Shingle sets of the rows, or of those whose hash is in the bitmap ``only``."""
    for batch in batches:
        if only is not None:
            batch = batch.filter(pa.array(in_bitmap(only, batch.column("_row").to_numpy().view(np.uint64))))
        for a, b, values, offsets in chunks(batch.column("text")):
            tokens, at = shingle_sets(values, offsets, k)
            yield batch, a, b, tokens, at, _set_ids(tokens, at)


def _parities(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set the parities of its shingles' numbers in as many cells as suit its size."""
    sizes = np.diff(at)
    cells = np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), LEAST_CELLS, MOST_CELLS)
    ends = np.cumsum(cells)
    where = np.repeat(ends - cells, sizes) + (tokens & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(where, minlength=int(cells.sum())) & 1).astype(np.uint8)).tobytes()
    return [odd[a:b] for a, b in zip(((ends - cells) // 8).tolist(), (ends // 8).tolist(), strict=True)]


def _unequal(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Cells of unequal parity of each pair, of which each holds a difference; the longer of two is folded to the other's cells."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(sizes), np.int64)
    for shape in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == shape).all(axis=1))
        sides = [np.frombuffer(b"".join([x[r] for r in rows]), np.uint64).reshape(len(rows), -1) for x in (left, right)]
        least = int(shape.min()) // 8
        x, y = (np.bitwise_xor.reduce(s.reshape(len(rows), -1, least), axis=1) for s in sides)
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _node_rows(k: int):
    """doc_id, n, set_id, for both bands and levels the signatures beyond the bound, and parities of the shingles in cells by size and in 512."""

    def run(batches):
        for batch, a, b, tokens, at, ids in _sets(batches, k):
            out = [batch.column("doc_id")[a:b], batch.column("_row")[a:b], pa.array(np.diff(at)), pa.array(ids.view(np.int64))]
            for nxt in (False, True):
                for level in (False, True):
                    s = Signed(tokens, at, nxt, level, keys=False)
                    out.append(pa.array(s.slack.astype(np.int32), mask=~s.used))
                out.append(pa.array(s.band.astype(np.int16)))
            out.append(pa.array(_parities(tokens, at), pa.binary()))
            cells = np.repeat(np.arange(b - a) * 512, np.diff(at)) + (tokens >> np.uint64(55)).astype(np.int64)
            odd = np.packbits((np.bincount(cells, minlength=(b - a) * 512) & 1).astype(np.uint8).reshape(-1, 512), axis=1)
            out.append(pa.array([x.tobytes() for x in odd], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "_row", "n", "set_id", "a0", "a1", "band_a", "b0", "b1", "band_b", "cells", "odd"])

    return run


_NODES = "doc_id bigint, _row bigint, n bigint, set_id bigint, a0 int, a1 int, band_a smallint, b0 int, b1 int, band_b smallint, cells binary, odd binary"


def _sign(k: int, names: np.ndarray, level: int, only: np.ndarray):
    buckets = len(names)

    def run(batches):
        packer = Packer(_RECORD)
        for _, _, _, tokens, at, ids in _sets(batches, k, only):
            _, first = np.unique(ids, return_index=True)
            keep = np.zeros(len(ids), bool)
            keep[first] = True
            keep &= ids != 0
            sizes = np.diff(at)
            tokens, ids = tokens[np.repeat(keep, sizes)], ids[keep]
            at = np.concatenate(([0], np.cumsum(sizes[keep])))
            for nxt in (False, True):
                s = Signed(tokens, at, nxt, level == 1)
                yield from packer.add(
                    names[((s.key >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)],
                    band=s.band[s.row], key=s.key & np.uint64(0xFFFFFFFF), id=ids[s.row], weight=s.weight,
                )
        yield from packer.rest()

    return run


def _shingles(k: int, names: np.ndarray, only: np.ndarray):
    """Every shingle of the sets in the bitmap."""
    buckets = len(names)

    def run(batches):
        packer = Packer(_SHINGLE)
        for _, _, _, tokens, at, ids in _sets(batches, k, only):
            yield from packer.add(
                names[((tokens >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)],
                key=tokens & np.uint64(0xFFFFFFFF), id=np.repeat(ids, np.diff(at)),
            )
        yield from packer.rest()

    return run


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = _runs(a, b)
    return a[at], b[at]


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids & np.uint64(0xFFFFF)) % np.uint64(buckets)).astype(np.int32)


def _bucket_column(name: str, buckets: int):
    return (F.col(name).bitwiseAND(F.lit(0xFFFFF)) % buckets).cast("int").alias("bucket")


def _pack(kind: int, bucket: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, x, y = bucket[order], x[order], y[order]
    w = w[order] if w is not None else np.empty(0, np.uint8)
    cuts = np.append(_runs(bucket), len(bucket))
    return [(kind, int(bucket[i]), x[i:j].tobytes(), y[i:j].tobytes(), w[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


_FOUND = "kind int, bucket int, x binary, y binary, w binary"
_FOUND_NAMES = ["kind", "bucket", "x", "y", "w"]
PAIR, COUNT, SHARED, LONE, HELD = 0, 1, 2, 3, 4


def _all_pairs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside the groups of at most CHEAP members."""
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for s in range(2, CHEAP + 1):
        block = starts[sizes == s][:, None] + np.arange(s)
        for i, j in combinations(range(s), 2):
            left.append(ids[block[:, i]])
            right.append(ids[block[:, j]])
    return np.concatenate(left), np.concatenate(right)


def _lone(buckets: int):
    """How many shingles of a bucket each set holds alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids = (unpack(pdf[c], t) for c, t in _SHINGLE.items())
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        at = _runs(key, ids)  # a set whose row is repeated has come more than once
        key, ids = key[at], ids[at]
        at = _runs(key)
        lone = np.sort(ids[at[np.diff(np.append(at, len(key))) == 1]])
        at = _runs(lone)
        return pd.DataFrame(_pack(LONE, _bucket(lone[at], buckets), lone[at], np.diff(np.append(at, len(lone))).astype("<u4")), columns=_FOUND_NAMES)

    return run


def _match(buckets: int):
    """Pairs of the cheap signatures of a bucket; who holds the expensive ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = int(pdf["bucket"].iloc[0])
        band, key, ids, weight = (unpack(pdf[c], t) for c, t in _RECORD.items())
        out = []
        full = key.astype(np.uint64) | band.astype(np.uint64) << np.uint64(32)
        order = np.lexsort((weight, ids, full))[::-1]  # a set may hold a key twice: its larger weight counts
        full, ids, weight, band = full[order], ids[order], weight[order], band[order]
        at = _runs(full, ids)
        full, ids, weight, band = full[at], ids[at], weight[at], band[at]
        starts = _runs(full)
        sizes = np.diff(np.append(starts, len(full)))
        a, b = _unique_pairs(*_all_pairs(ids, starts, sizes))
        out += _pack(PAIR, _bucket(a, buckets), a, b)
        hot = np.repeat(sizes > CHEAP, sizes)
        full, ids, weight, band = full[hot], ids[hot], weight[hot], band[hot]
        if len(full):
            at = _runs(full)
            groups = np.diff(np.append(at, len(full))).astype("<u4")
            out.append((HELD, here, ids.tobytes(), (full[at] | np.uint64(here) << np.uint64(40)).tobytes(), groups.tobytes()))
        order = np.lexsort((band, ids))
        ids, band, weight = ids[order], band[order], weight[order]
        at = _runs(ids, band)
        total = np.add.reduceat(weight, at, dtype=np.uint32) if len(at) else np.empty(0, np.uint32)
        out += _pack(COUNT, _bucket(ids[at], buckets), ids[at], total, band[at])
        return pd.DataFrame(out, columns=_FOUND_NAMES)

    return run


def _short(nodes: pd.DataFrame, level: int, ids: np.ndarray, band: np.ndarray, total: np.ndarray) -> set[tuple[int, int]]:
    """(set, band) whose cheap signatures do not reach the bound."""
    spent: dict[tuple[int, int], int] = {}
    for i, b, t in zip(ids.tolist(), band.tolist(), total.tolist(), strict=True):
        spent[i, b] = spent.get((i, b), 0) + t
    out = set()
    for i, sa, ba, sb, bb in zip(
        nodes["set_id"].to_numpy(np.int64).view(np.uint64).tolist(), nodes[f"a{level}"].tolist(), nodes["band_a"].tolist(),
        nodes[f"b{level}"].tolist(), nodes["band_b"].tolist(), strict=True,
    ):
        for slack, b in ((sa, ba), (sb, bb)):
            if slack is not None and slack == slack and spent.get((i, b), 0) > slack:
                out.add((i, b))
    return out


_SHORT = "set_id bigint, band int"


def _short_sets(level: int):
    def run(nodes: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, total, band = unpack(found["x"], "<u8"), unpack(found["y"], "<u4"), unpack(found["w"], "u1")
        short = sorted(_short(nodes, level, ids, band, total)) if len(nodes) else []
        return pd.DataFrame({"set_id": np.array([i for i, _ in short], np.uint64).view(np.int64), "band": np.array([b for _, b in short], np.int32)})

    return run


#: Spreads the bands of a set over a bitmap.
_SPREAD = 0x13579B


def _short_bitmap(short: DataFrame) -> np.ndarray:
    return bitmap(short, F.col("set_id").bitwiseXOR(F.col("band").cast("bigint") * _SPREAD))


def _held(batches: Iterator[pa.RecordBatch], *short: np.ndarray) -> Iterator[tuple]:
    """Holders, their signatures and starts of the expensive signatures of a bucket; for each bitmap who is short in the signature's band."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, key, groups = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("x", "<u8"), ("y", "<u8"), ("w", "<u4")))
            key = np.repeat(key, groups)
            band = (key >> np.uint64(32)) & np.uint64(0xFF)
            yield ids, key, _runs(key), groups, [in_bitmap(bits, ids ^ band * np.uint64(_SPREAD)) for bits in short]


def _beside(short: np.ndarray):
    """All holders of the expensive signatures that a short set holds."""

    def run(batches):
        for ids, _, starts, groups, (flag,) in _held(batches, short):
            near = np.unique(ids[np.repeat(np.logical_or.reduceat(flag, starts), groups)])
            yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64))], ["set_id"])

    return run


def _shared(short: np.ndarray, still: np.ndarray, buckets: int):
    """All holders of the expensive signatures with sets short at first and still, flagged 1 and 2."""

    def run(batches):
        for ids, key, starts, groups, (first, second) in _held(batches, short, still):
            keep = np.repeat(np.logical_or.reduceat(first, starts) & np.logical_or.reduceat(second, starts), groups)
            flag = (first.astype(np.uint8) | second.astype(np.uint8) << np.uint8(1))[keep]
            rows = _pack(SHARED, _bucket(ids[keep], buckets), ids[keep], key[keep], flag) if keep.any() else []
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(types)], _FOUND_NAMES)

    return run


def _holders(nodes: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """Rows of the sets that hold an expensive signature that is still needed, each once."""
    return nodes.loc[np.isin(nodes["set_id"].to_numpy(np.int64), unpack(shared["x"], "<i8")), ["row"]]


def _stuck(nodes: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Expensive signatures that are still needed by holder, unless its lone shingles rule out every link."""
    if not len(nodes) or not len(found):
        return pd.DataFrame(columns=["bucket", *_STUCK])
    shared, lone = found[found["kind"] == SHARED], found[found["kind"] == LONE]
    ids, key, flag = unpack(shared["x"], "<u8"), unpack(shared["y"], "<u8"), unpack(shared["w"], "u1")
    node, n = nodes["set_id"].to_numpy(np.int64).view(np.uint64), nodes["n"].to_numpy(np.int64)
    order = np.argsort(node)
    node, n, odd = node[order], n[order], unpack(nodes["odd"], "V64")[order]
    alone = np.zeros(len(node), np.int64)
    lone_ids, lone_n = unpack(lone["x"], "<u8"), unpack(lone["y"], "<u4")
    at = np.minimum(np.searchsorted(node, lone_ids), len(node) - 1)
    known = node[at] == lone_ids
    np.add.at(alone, at[known], lone_n[known])
    possible = alone <= _differences(n, n * DEN // NUM)
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    keep = (node[at] == ids) & possible[at]
    if not keep.any():
        return pd.DataFrame(columns=["bucket", *_STUCK])
    at = at[keep]
    columns = (key[keep], ids[keep], np.minimum(n[at], 2**32 - 1).astype("<u4"), alone[at].astype("<u4"), odd[at], flag[keep])
    return pd.DataFrame([(int(found["bucket"].iloc[0]), *(c.tobytes() for c in columns))], columns=["bucket", *_STUCK])


_STUCK = {"key": "<u8", "id": "<u8", "n": "<u4", "lone": "<u4", "odd": "V64", "flag": "u1"}
#: Flags of a pair that has not met yet: one set short at first, one still short.
NEEDED = 3
_LABELLED = {**_STUCK, "label": "<u8"}


def _may_link(n: np.ndarray, lone: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and lone shingles leave room for a link."""
    x, y = n[i].astype(np.int64), n[j].astype(np.int64)
    near = NUM * np.maximum(x, y) <= DEN * np.minimum(x, y)
    return near & (lone[i].astype(np.int64) + lone[j] <= (x + y) * (DEN - NUM) // (DEN + NUM))


def _by_key(buckets: int):
    def run(batches):
        packer = Packer(_STUCK)
        for batch in batches:
            for row in batch.to_pylist():
                columns = {c: np.frombuffer(row[c], t) for c, t in _STUCK.items()}
                yield from packer.add((mix(columns["key"]) % np.uint64(buckets)).astype(np.int32), **columns)
        yield from packer.rest()

    return run


def _hub_pairs(buckets: int):
    """Every member of an expensive signature with a hub, of the short ones that with the fewest lone shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, n, lone, _, flag = (unpack(pdf[c], t) for c, t in _STUCK.items())
        order = np.lexsort((ids, lone, flag != NEEDED, key))
        key, ids, n, lone, flag = key[order], ids[order], n[order], lone[order], flag[order]
        starts = _runs(key)
        hub, one = np.repeat(starts, np.diff(np.append(starts, len(key)))), np.arange(len(key))
        ok = (hub != one) & ((flag[hub] | flag[one]) == NEEDED) & _may_link(n, lone, hub, one)
        a, b = _unique_pairs(ids[hub[ok]], ids[one[ok]])
        return pd.DataFrame(_pack(PAIR, _bucket(a, buckets), a, b), columns=_FOUND_NAMES)

    return run


def _label(buckets: int):
    """Stuck signatures with the component of their set, dealt by signature."""

    def run(stuck: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if not len(stuck):
            return pd.DataFrame(columns=["bucket", *_LABELLED])
        columns = {c: unpack(stuck[c], t) for c, t in _STUCK.items()}
        key, ids = columns["key"], columns["id"]
        node = labels["node"].to_numpy(np.int64).view(np.uint64)
        to = labels["label"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(node)
        node, to = node[order], to[order]
        own = ids.copy()
        if len(node):
            at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
            own = np.where(node[at] == ids, to[at], ids)
        packer = Packer(_LABELLED)
        rows = [*packer.add((mix(key) % np.uint64(buckets)).astype(np.int32), label=own, **columns), *packer.rest()]
        return pa.Table.from_batches(rows).to_pandas()

    return run


def _cross_pairs(buckets: int):
    """Pairs of different components that share an expensive signature and may link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, n, lone, odd, flag, label = (unpack(pdf[c], t) for c, t in _LABELLED.items())
        order = np.lexsort((ids, lone, key))
        key, ids, n, lone, flag, label = key[order], ids[order], n[order], lone[order], flag[order], label[order]
        odd = odd[order].view("<u8").reshape(-1, 8)
        cuts = np.append(_runs(key), len(key))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own, most = label[i:j], int(n[i:j].max()) * 2 * (DEN - NUM) // (DEN + NUM)
            if (own == own[0]).all():
                continue
            value, back, count = np.unique(own, return_inverse=True, return_counts=True)
            main = back == count.argmax()  # pairs inside the largest component need no look
            for p in np.flatnonzero(~main):
                end = i + int(np.searchsorted(lone[i:j], most - int(lone[i + p]), "right"))  # sorted by lone shingles
                other = np.arange(i, max(i, end))
                other = other[(label[other] != own[p]) & (main[other - i] | (other < i + p)) & ((flag[other] | flag[i + p]) == NEEDED)]
                other = other[_may_link(n, lone, np.full(len(other), i + p), other)]
                apart = np.bitwise_count(odd[other] ^ odd[i + p]).sum(axis=1)  # cells of unequal parity hold a difference each
                other = other[apart <= (n[other].astype(np.int64) + int(n[i + p])) * (DEN - NUM) // (DEN + NUM)]
                left.append(np.full(len(other), i + p))
                right.append(other)
        a, b = _unique_pairs(ids[np.concatenate(left)], ids[np.concatenate(right)])
        return pd.DataFrame(_pack(PAIR, _bucket(a, buckets), a, b), columns=_FOUND_NAMES)

    return run


def _distinct_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = _unique_pairs(unpack(pdf["x"], "<u8"), unpack(pdf["y"], "<u8"))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _texts(k: int, only: np.ndarray):
    """(set_id, text) of the rows in the bitmap, once a chunk."""

    def run(batches):
        for batch, a, b, _, _, ids in _sets(batches, k, only):
            _, first = np.unique(ids, return_index=True)
            first = first[ids[first] != 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first].view(np.int64)), batch.column("text")[a:b].take(pa.array(first)).cast(pa.string())], ["set_id", "text"]
            )

    return run


#: Pairs whose texts are held as shingle sets at a time.
PAIRS = 256


def _verify(k: int):
    def run(batches):
        for batch in (whole.slice(i, PAIRS) for whole in batches for i in range(0, whole.num_rows, PAIRS)):
            keep = np.zeros(batch.num_rows, bool)
            right = [(tokens, at) for _, _, values, offsets in chunks(batch.column("tb")) for tokens, at in [shingle_sets(values, offsets, k)]]
            right = [t[at[i] : at[i + 1]] for t, at in right for i in range(len(at) - 1)]
            for a, b, values, offsets in chunks(batch.column("ta")):
                tokens, at = shingle_sets(values, offsets, k)
                for r in range(a, b):
                    x, y = tokens[at[r - a] : at[r - a + 1]], right[r]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = DEN * both >= NUM * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _bounded(batches):
    """Pairs whose sizes and parities leave room for a link."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        keep = NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)
        batch, n, m = batch.filter(pa.array(keep)), n[keep], m[keep]
        keep = _unequal(*(batch.column(c).to_pylist() for c in ("ca", "cb"))) <= (n + m) * (DEN - NUM) // (DEN + NUM)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _bounded_pairs(sets: DataFrame, found: DataFrame) -> DataFrame:
    """The different candidate pairs in ``found`` that pass the bound."""
    pairs = found.where(f"kind = {PAIR}").groupBy("bucket").applyInPandas(_distinct_pairs, "a bigint, b bigint")
    left, right = (sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in ("a", "b"))
    return cut_lineage(pairs.join(left, "a").join(right, "b").mapInArrow(tidy(_bounded), "a bigint, b bigint"))


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that are links, by their texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
    rows = bitmap(sets.select("set_id", "row").join(ids, "set_id", "left_semi"), F.col("row"))
    texts = docs.select("_row", "text").mapInArrow(tidy(_texts(k, rows)), "set_id bigint, text string")
    texts = cut_lineage(texts.groupBy("set_id").agg(F.first("text").alias("text")))
    left, right = (texts.select(F.col("set_id").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(_verify(k)), "a bigint, b bigint"))


def _apart(pairs: DataFrame, first: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs that were not first and whose sets are not in one component yet."""
    label = by_size(label)
    of = {c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("a", "b")}
    later = pairs.join(by_size(first).withColumnRenamed("a", "_first"), "b").where("a <> _first")
    known = later.join(of["a"], "a", "left").join(of["b"], "b", "left")
    return known.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, row_hash, n_shingles, set_id, component_id, component_set of documents linked at a shingle similarity of 3/4.

    ``docs`` has doc_id and text; other columns are ignored.  Null text, empty text and text without
    a word have an empty set: n_shingles 0, linked with nothing, a component of their own, whatever
    others are empty.  Fewer than ``k`` words are one shingle.  Rows repeated with one doc_id come
    back repeated; copies share a set and thus a component.  ``row_hash`` is xxhash64(doc_id, text), which tells
    rows with a null or repeated doc_id apart.  A null doc_id names no component; one of null ids alone has a
    null component_id; ``component_set``, a set of the component, always names it (null for an empty set).  An empty table gives an empty one.
    Links are exact up to 64-bit hash collisions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("_row"))
    buckets, names = bucket_count(spark), bucket_names(spark)
    nodes = cut_lineage(docs.mapInArrow(tidy(_node_rows(k)), _NODES))
    sets = cut_lineage(
        nodes.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.min("_row").alias("row"), *(F.first(c).alias(c) for c in ("n", "a0", "a1", "band_a", "b0", "b1", "band_b", "cells", "odd")))
    )
    dealt = sets.drop("cells").withColumn("bucket", _bucket_column("set_id", buckets)).groupBy("bucket")

    def matched(level: int, own: DataFrame) -> DataFrame:
        signed = docs.select("_row", "text").mapInArrow(tidy(_sign(k, names, level, bitmap(own, F.col("row")))), schema(_RECORD))
        return cut_lineage(signed.groupBy("bucket").applyInPandas(tidy_group(_match(buckets)), _FOUND))

    found = matched(0, sets)
    counts = found.where(f"kind = {COUNT}")
    short = cut_lineage(dealt.cogroup(counts.groupBy("bucket")).applyInPandas(_short_sets(0), _SHORT))
    stuck = None
    if not short.isEmpty():
        first_short = _short_bitmap(short)
        beside = found.where(f"kind = {HELD}").select("x", "y", "w").mapInArrow(tidy(_beside(first_short)), "set_id bigint")
        signing = cut_lineage(short.select("set_id").unionByName(beside).distinct())
        again_sets = cut_lineage(sets.drop("cells").join(signing, "set_id", "left_semi").withColumn("bucket", _bucket_column("set_id", buckets)))
        again = matched(1, again_sets)
        found = found.unionByName(again)
        counts = again.where(f"kind = {COUNT}")
        still = again_sets.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(_short_sets(1), _SHORT)
        shared = again.where(f"kind = {HELD}").select("x", "y", "w").mapInArrow(tidy(_shared(first_short, _short_bitmap(still), buckets)), _FOUND)
        shared = cut_lineage(shared)
        by_bucket = again_sets.select("bucket", "set_id", "row").groupBy("bucket")
        holders = by_bucket.cogroup(shared.select("bucket", "x").groupBy("bucket")).applyInPandas(_holders, "row bigint")
        single = docs.select("_row", "text").mapInArrow(tidy(_shingles(k, names, bitmap(holders, F.col("row")))), schema(_SHINGLE))
        needed = single.groupBy("bucket").applyInPandas(tidy_group(_lone(buckets)), _FOUND).unionByName(shared)
        stuck = cut_lineage(again_sets.groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInPandas(_stuck, schema(_STUCK)))
        hubs = stuck.mapInArrow(tidy(_by_key(buckets)), schema(_STUCK)).groupBy("bucket").applyInPandas(tidy_group(_hub_pairs(buckets)), _FOUND)
        found = found.unionByName(hubs)
    pairs = _bounded_pairs(sets, found)
    # each set with its least partner first; most other pairs then lie inside a component and need no look
    first = cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    label = components(_links(docs, sets, first, k))
    rest = cut_lineage(_apart(pairs, first, label))
    if not rest.isEmpty():
        label = components(stars(label).unionByName(_links(docs, sets, rest, k)))
    if stuck is not None and not stuck.isEmpty():
        own = label.withColumn("bucket", _bucket_column("node", buckets))
        labelled = stuck.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInPandas(_label(buckets), schema(_LABELLED))
        cross = _bounded_pairs(sets, labelled.groupBy("bucket").applyInPandas(tidy_group(_cross_pairs(buckets)), _FOUND))
        if not cross.isEmpty():
            label = components(stars(label).unionByName(_links(docs, sets, cross, k)))
    joined = sets.join(label, sets["set_id"] == label["node"], "left").select("set_id", "doc", F.coalesce("label", "set_id").alias("label"))
    least = joined.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_set = joined.join(least, "label").select("set_id", "component_id", F.col("label").alias("component_set"))
    return nodes.join(of_set, "set_id", "left").select(
        "doc_id", F.col("_row").alias("row_hash"), F.col("n").alias("n_shingles"), "set_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component_set"
    )
