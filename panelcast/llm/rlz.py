"""Duplicate passages by relative Lempel-Ziv parsing against reference blocks.

Every stretch of the corpus is reference text.  A reference block indexes all windows of ``k`` words
whose least 8-gram hash (their anchor) falls to it; equal windows have equal anchors, so the block of
its own anchor is the only one in which a window of a document can be found, and sending a stretch
there gives the parse against every block without a copy of the text per block.  Consecutive windows
mostly share an anchor and travel as one unit.

In a block each window gets its source, the first equal window elsewhere.  A factor is a maximal run
of windows whose sources also follow each other; a document is parsed greedily from left to right.
Factors are at least ``k`` words long, and as every window start was looked up, also those that cross
the end of a factor, the union of the factors is exactly the set of words covered by a repeated
window.  Windows are compared by 64-bit hashes inside their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.blocks import Packer, bucket_names, unpack
from panelcast.llm.words import chunks, mix, split_words, window_hashes, window_starts, word_hashes
from panelcast.llm.workers import tidy, tidy_group

#: Words in an anchor.
ANCHOR = 8
#: Words gathered before equal units of a task are merged and its windows sent off.
TASK_WORDS = 1 << 21

_UNIT = {"doc": "<i8", "start": "<i4", "count": "<i4", "multi": "u1"}
_FACTOR = {"doc": "<i8", "start": "<i4", "count": "<i4", "src_doc": "<i8", "src_start": "<i4"}
_SENT = "bucket int, final boolean, doc binary, start binary, count binary, multi binary, windows binary, src_doc binary, src_start binary"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _units(doc_ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, k: int) -> tuple | None:
    """Per unit: anchor, document, first window, windows; and the hashes of all windows."""
    w = split_words(values, offsets)
    starts = window_starts(w.first, k)
    if not len(starts):
        return None
    h = word_hashes(w)
    least = _sliding_min(window_hashes(h, ANCHOR), k - ANCHOR + 1)
    anchor, hashes, row = least[starts], window_hashes(h, k)[starts], w.row[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(starts)))
    return anchor[at], doc_ids[row[at]], (starts - w.first[row])[at], counts, hashes


class _Sender:
    """Merges equal units of a task and packs the rest by block; equal ones are factors at once."""

    def __init__(self, names: np.ndarray) -> None:
        self.names, self.held, self.parts = names, 0, []

    def add(self, units: tuple | None) -> Iterator[pa.RecordBatch]:
        if units is not None:
            self.parts.append(units)
            self.held += len(units[-1])
        if self.held >= TASK_WORDS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        anchor, doc, start, count, hashes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.held, self.parts = 0, []
        first = np.concatenate(([0], np.cumsum(count)))
        content = mix(np.add.reduceat(mix(hashes), first[:-1]) + count.astype(np.uint64))
        order = np.argsort(content, kind="stable")
        new = np.concatenate(([True], content[order][1:] != content[order][:-1]))
        group = np.cumsum(new) - 1
        least = order[new][group]  # the first of its equals, in the order of ``order``
        copies = np.bincount(group)[group]
        lead = np.empty(len(order), np.int64)
        lead[order] = least
        many = np.zeros(len(order), bool)
        many[order] = copies > 1
        sent = ~many | (lead == np.arange(len(order)))
        bucket = self.names[(mix(anchor) % np.uint64(len(self.names))).astype(np.int64)]
        yield from self._pack(bucket, sent, doc, start, count, many, first, hashes)
        if many.any():  # an equal unit is in this task: its factor is known; the lead's source is any other
            other = lead.copy()
            second = order[np.flatnonzero(new & (copies > 1)) + 1]
            other[lead[second]] = second
            packer = Packer(_FACTOR)
            rows = packer.add(self.names[doc[many] % len(self.names)], doc=doc[many], start=start[many], count=count[many], src_doc=doc[other[many]], src_start=start[other[many]])
            for b in [*rows, *packer.rest()]:
                empty = pa.array([b""] * b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b["bucket"], pa.array([True] * b.num_rows), b["doc"], b["start"], b["count"], empty, empty, b["src_doc"], b["src_start"]],
                    ["bucket", "final", "doc", "start", "count", "multi", "windows", "src_doc", "src_start"],
                )

    def _pack(self, bucket, sent, doc, start, count, many, first, hashes) -> Iterator[pa.RecordBatch]:
        rows = []
        order = np.flatnonzero(sent)[np.argsort(bucket[sent], kind="stable")]
        dealt = bucket[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1]))), len(dealt))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            u = order[i:j]
            n = count[u]
            at = np.repeat(first[u] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            own = (doc[u].astype("<i8"), start[u].astype("<i4"), n.astype("<i4"), many[u].astype("u1"), hashes[at])
            rows.append((int(dealt[i]), False, *(x.tobytes() for x in own), b"", b""))
        names = ["bucket", "final", "doc", "start", "count", "multi", "windows", "src_doc", "src_start"]
        types = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _send(k: int, names: np.ndarray):
    def run(batches):
        sender = _Sender(names)
        for batch in batches:
            ids = batch.column("_row").to_numpy(zero_copy_only=False)
            for a, b, values, offsets in chunks(batch.column("text")):
                yield from sender.add(_units(ids[a:b], values, offsets, k))
        yield from sender.rest()

    return run


def _parse_block(names: np.ndarray):
    """Factors of the units of a reference block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start, count, multi = (unpack(pdf[c], t) for c, t in _UNIT.items())
        hashes = unpack(pdf["windows"], "<u8")
        unit = np.repeat(np.arange(len(doc)), count)
        place = start[unit] + (np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count))
        order = np.lexsort((place, doc[unit], hashes))
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        sizes = np.diff(np.append(heads, len(order)))[group]
        source = order[heads[group]]  # the first equal window; the first itself takes the second
        own = source == order
        after = np.minimum(np.arange(len(order)) + 1, len(order) - 1)
        source = np.where(own & (sizes > 1), order[after], source)
        src = np.empty(len(order), np.int64)
        src[order] = source
        found = np.zeros(len(order), bool)
        found[order] = sizes > 1
        found &= multi[unit] == 0  # those are factors already
        at = np.flatnonzero(found)
        if not len(at):
            return pd.DataFrame(columns=["bucket", *_FACTOR])
        u, p, s = unit[at], place[at], src[at]
        sd, sp = doc[unit[s]], place[s]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (u[1:] != u[:-1]) | (sd[1:] != sd[:-1]) | (sp[1:] != sp[:-1] + 1)
        cut = np.flatnonzero(new)
        packer = Packer(_FACTOR)
        d = doc[u[cut]]
        rows = [*packer.add(names[d % len(names)], doc=d, start=p[cut], count=np.diff(np.append(cut, len(at))), src_doc=sd[cut], src_start=sp[cut]), *packer.rest()]
        return pa.Table.from_batches(rows).to_pandas()

    return run


def _spans(k: int):
    """Per document: the parse in order, as (first word, words) of every factor, neighbours of one source joined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start, count, sd, ss = (unpack(pdf[c], t) for c, t in _FACTOR.items())
        order = np.lexsort((start, doc))
        doc, start, count, sd, ss = doc[order], start[order].astype(np.int64), count[order], sd[order], ss[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sd[1:] != sd[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (ss[1:] != ss[:-1] + count[:-1])
        cut = np.flatnonzero(new)
        end = start + count + k - 1
        last = np.append(cut[1:], len(doc)) - 1
        d, a, b = doc[cut], start[cut], end[last]
        rows = np.append(np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))), len(d))
        out = [(int(d[i]), j - i, a[i:j].astype("<i8").tobytes(), b[i:j].astype("<i8").tobytes()) for i, j in zip(rows[:-1], rows[1:], strict=True)]
        return pd.DataFrame(out, columns=["_doc", "_factors", "_from", "_to"])

    return run


def duplicate_spans(docs: DataFrame, k: int = 35) -> DataFrame:
    """(_doc, _factors, _from, _to): word ranges of the factors of each row of (_row, text) that has any, as packed arrays."""
    if k <= ANCHOR:
        raise ValueError(f"windows must be longer than {ANCHOR} words")
    names = bucket_names(docs.sparkSession)
    sent = docs.select("_row", "text").mapInArrow(tidy(_send(k, names)), _SENT)
    parse = _parse_block(names)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Units are parsed; factors found inside a task pass through."""
        done, units = pdf.loc[pdf["final"], ["bucket", *_FACTOR]], pdf[~pdf["final"]]
        return pd.concat([done, parse(units)]) if len(units) else done

    factors = sent.groupBy("bucket").applyInPandas(tidy_group(block), "bucket int, " + ", ".join(f"{c} binary" for c in _FACTOR))
    return factors.groupBy("bucket").applyInPandas(tidy_group(_spans(k)), "_doc bigint, _factors int, _from binary, _to binary")


#: Rows whose texts are held as words at a time.
ROWS = 512


def _cut(batches):
    """Word counts and the kept words of every text."""
    for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
        counts, removed, kept = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("text", "_from", "_to"))
        for text, a, b in zip(*columns, strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if a is not None:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.frombuffer(a, "<i8"), 1)
                np.add.at(edge, np.frombuffer(b, "<i8"), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            counts.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
        out = [batch.column("doc_id"), batch.column("n_factors"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_factors", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, k: int = 35) -> DataFrame:
    """doc_id, n_factors, n_words, n_removed, kept_text: texts without words in a window that starts anywhere else too.

    ``docs`` has doc_id and text; other columns are ignored.  Null and empty texts have no words and
    an empty kept_text; texts of fewer than ``k`` words keep all; a passage loses every copy, the first
    one included; windows are judged on the input.  A null or repeated doc_id is allowed: rows are
    told apart by id and text, and equal rows are copies of each other.  An empty table gives an
    empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("_row"))
    spans = duplicate_spans(docs, k)
    joined = docs.join(spans, docs["_row"] == spans["_doc"], "left").select(
        "doc_id", "text", F.coalesce("_factors", F.lit(0)).alias("n_factors"), "_from", "_to"
    )
    return joined.mapInArrow(tidy(_cut), "doc_id bigint, n_factors int, n_words bigint, n_removed bigint, kept_text string")
