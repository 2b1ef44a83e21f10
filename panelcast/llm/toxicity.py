"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled, not clean.  With the share of toxic
texts (the class prior) the risk of a scorer g under the logistic loss is
``prior * E_pos[loss(g, toxic)] + max(0, E_all[loss(g, clean)] - prior * E_pos[loss(g, clean)])``: the second
part estimates the risk on clean texts and cannot be negative, so where it falls below zero its gradient is
turned round.  The scorer is linear in the words of a text and in runs of five and six bytes of them (stems
and endings), each counted as seen once, twice and three times, kept sparse by a proximal step, and fitted in numpy on a bounded sample of different texts;
scoring covers every text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.pieces import Block, blocks, crc32
from panelcast.llm.workers import tidy
from panelcast.llm.words import chunks, mix
from panelcast.session import cut_lineage

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True
_SHINGLE = 5
#: A word or run is a feature for each of these numbers of occurrences that it reaches.
LEVELS = (1, 2, 3)
_GRAMS = (5, 6)
_SKETCH = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class ToxicityConfig:
    """``positives`` and ``unlabelled`` bound the texts a fit sees; a text takes at most 12 * ``cells`` bytes of them.

    Only ``features`` features, the most different ones, can have a weight.  ``prior`` None: the share of toxic among the different labelled texts.
    """

    positives: int = 3000
    unlabelled: int = 6000
    prior: float | None = None
    cells: int = 1 << 20
    features: int = 4096
    min_texts: int = 3
    min_score: float = 3.0
    steps: int = 400
    rate: float = 0.5
    sparsity: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class ToxicityModel:
    """``features`` (cell + cells * i, see ``features``) that have a weight."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _grams(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of every word and of every run of ``_GRAMS`` bytes of it, a space before and after counting as bytes."""
    yield np.arange(len(b.start)), mix(crc32(b.values, b.start, b.end).astype(np.uint64))
    size = b.end - b.start
    first = np.concatenate(([0], np.cumsum(size + 1)))  # of each word's space in the words joined by one space
    text = np.full(first[-1] + 1, 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(word)) - (np.cumsum(size) - size)[word]
    text[first[word] + 1 + inner] = b.values[b.start[word] + inner]
    word = np.repeat(np.arange(len(size)), size + 1)  # the word of each byte, its leading space included
    wide = text.astype(np.uint64)
    for n in _GRAMS:
        at = np.arange(max(len(text) - n + 1, 0))
        at = at[at + n <= first[word[at] + 1] + 1]  # up to the space after the word
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | wide[at + k]
        yield word[at], mix(code)


def _counts(column: pa.Array, cells: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, count) of the hashed words and byte runs of every text; ``wanted`` renumbers cells and drops the -1 ones."""
    width = cells if wanted is None else int(wanted.max(initial=0)) + 1
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for b in blocks(column, _SOLID, 1, _FOLD):
        for word, code in _grams(b):
            cell = (code & np.uint64(cells - 1)).astype(np.int64)
            if wanted is not None:
                cell = wanted[cell]
                word, cell = word[cell >= 0], cell[cell >= 0]
            key, count = np.unique(b.row[word] * width + cell, return_counts=True)
            keys.append(key)
            counts.append(count)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key // width, key % width, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def features(column: pa.Array, cells: int) -> list[np.ndarray]:
    """Of every text the features it has: cell + cells * i for each cell that occurs ``LEVELS[i]`` times or more."""
    out = []
    for first, last, _, _ in chunks(column):  # a few rows at a time
        row, cell, count = _counts(column.slice(first, last - first), cells)
        rows, ids = (np.concatenate(x) for x in zip(*((row[count >= n], cell[count >= n] + cells * i) for i, n in enumerate(LEVELS)), strict=True))
        order = np.argsort(rows, kind="stable")
        at = np.searchsorted(rows[order], np.arange(last - first + 1))
        out += [ids[order][a:b].astype(np.uint32) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    """Eight least hashes of the runs of ``_SHINGLE`` words of every text (fewer words: none, all ones)."""
    out = np.full((len(column), len(_SKETCH)), np.iinfo(np.uint64).max)
    for b in blocks(column, _SOLID, _SHINGLE, _FOLD):
        word = mix(crc32(b.values, b.start, b.end).astype(np.uint64))
        first = np.arange(min(b.own, max(len(word) - _SHINGLE + 1, 0)))
        first = first[b.row[first] == b.row[first + _SHINGLE - 1]]
        if len(first):
            gram = sum(word[first + i] * np.uint64(2 * i + 1) for i in range(_SHINGLE))
            rows, heads = np.unique(b.row[first], return_index=True)
            least = np.stack([np.minimum.reduceat(mix(gram ^ salt), heads) for salt in _SKETCH], axis=1)
            out[rows] = np.minimum(out[rows], least)
    return out


def _table(rows: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(kind, id, sketch, features) of the sampled texts (kind, id, text), written once; none of it reaches the driver."""

    def run(batches):
        for batch in batches:
            text, kind = batch.column("text"), batch.column("kind").to_pylist()
            own = [x.tobytes() if k < 2 else b"" for x, k in zip(features(text, config.cells), kind, strict=True)]
            sketch = []
            for x, k in zip(_sketches(text), own, strict=True):  # too short for a run: the features themselves
                sketch.append(hashlib.sha512(k).digest() if x[0] == np.iinfo(np.uint64).max else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), pa.array(sketch, pa.binary()), pa.array(own, pa.binary())], ["kind", "id", "sketch", "features"])

    return cut_lineage(rows.mapInArrow(tidy(run), "kind int, id bigint, sketch binary, features binary"))


def _different(found: list) -> list[int]:
    """Ids of the texts, one of each group of near copies (two equal values among eight least hashes of word runs)."""
    seen, out = set(), []
    for r in sorted(found, key=lambda r: (bytes(r["sketch"]), r["id"])):
        marks = np.frombuffer(bytes(r["sketch"]), np.uint64)
        pairs = {(i, *marks[i : i + 2].tolist()) for i in range(0, len(marks), 2)}
        if seen.isdisjoint(pairs):
            out.append(r["id"])
        seen |= pairs
    return out


def _chosen(table: DataFrame, n: int, m: int, config: ToxicityConfig) -> np.ndarray:
    """The ``features`` features whose shares of ``n`` positives and ``m`` unlabelled texts differ most.

    In standard deviations, ``min_score`` at least, and only those that ``min_texts`` positives have.  A task counts
    its own texts; the sums stay in Spark.
    """

    def run(batches):
        size = config.cells * len(LEVELS)
        sums = np.zeros((2, size), np.int32)
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("features").to_pylist(), strict=True):
                sums[kind, np.frombuffer(blob, np.uint32)] += 1
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[1, some]), pa.array(sums[0, some])], ["feature", "held", "seen"])

    counts = table.mapInArrow(tidy(run), "feature int, held int, seen int").groupBy("feature").agg(F.sum("held").alias("held"), F.sum("seen").alias("seen"))
    share = f"(held + seen + 1) / {n + m + 2}"
    apart = F.expr(f"abs(held / {n} - seen / {m}) / sqrt({share} * (1 - {share}) * {1 / n + 1 / m!r})").alias("apart")
    rows = counts.where(F.col("held") >= config.min_texts).select("feature", apart).where(F.col("apart") >= config.min_score)
    return np.sort(np.array([r["feature"] for r in rows.orderBy(F.desc("apart"), "feature").limit(config.features).collect()], np.int64))


def _bags(table: DataFrame, chosen: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Of every text the chosen features it has, by kind."""

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.uint32) for x in batch.column("features").to_pylist()]
            own = [x[np.isin(x, chosen)].tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), pa.array(own, pa.binary())], ["kind", "id", "features"])

    out: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in sorted(table.mapInArrow(tidy(run), "kind int, id bigint, features binary").collect(), key=lambda r: r["id"]):
        out[r["kind"]].append(np.frombuffer(bytes(r["features"]), np.uint32))
    return out


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Bags:
    """Texts as index lists over the chosen words, with the products a linear scorer needs."""

    def __init__(self, texts: list[np.ndarray], number: np.ndarray) -> None:
        own = [number[t] for t in texts]
        own = [t[t >= 0] for t in own]
        self.rows, self.width = len(own), int(number.max(initial=-1)) + 1
        self.row = np.repeat(np.arange(self.rows), [len(t) for t in own])
        self.col = np.concatenate([np.empty(0, np.int64), *own])

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, w[self.col], self.rows)

    def pull(self, d: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient over words and bias of the sum of scores weighted by ``d``."""
        return np.bincount(self.col, d[self.row], self.width), float(d.sum())


def risk(pos: Bags, unl: Bags, w: np.ndarray, bias: float, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk and the gradient a step takes (words, bias)."""
    gp, gu = pos.scores(w, bias), unl.scores(w, bias)
    clean = _softplus(gu).mean() - prior * _softplus(gp).mean()
    total = prior * _softplus(-gp).mean() + max(0.0, clean)
    dw_clean, db_clean = unl.pull(_sigmoid(gu) / unl.rows)
    dw_over, db_over = pos.pull(-prior * _sigmoid(gp) / pos.rows)
    dw_clean, db_clean = dw_clean + dw_over, db_clean + db_over
    if clean < 0:
        return total, -dw_clean, -db_clean
    dw, db = pos.pull(-prior * _sigmoid(-gp) / pos.rows)
    return total, dw + dw_clean, db + db_clean


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """A sparse linear model over the ``chosen`` features from the features of positive and of unlabelled texts."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    start = math.log(prior / (1 - prior))
    if not positives or not unlabelled:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), start, prior)
    number = np.full(config.cells * len(LEVELS), -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    pos, unl = Bags(positives, number), Bags(unlabelled, number)
    w, bias = np.zeros(len(chosen)), start
    sums, sum_bias = np.full(len(chosen), 1e-8), 1e-8
    penalty, free = config.sparsity * prior / math.sqrt(len(positives)), np.ones(len(chosen), bool)
    for i in range(2 * config.steps if len(chosen) else 0):
        if i == config.steps:  # those left get their weights with a tenth of the penalty
            penalty, free = penalty / 10, w != 0
        _, dw, db = risk(pos, unl, w, bias, prior)
        sums += dw * dw
        sum_bias += db * db
        step = config.rate / np.sqrt(sums)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0) * free
        bias -= config.rate / math.sqrt(sum_bias) * db
    return ToxicityModel(chosen[w != 0], w[w != 0], bias, prior)


def _unit(x: Column) -> Column:
    return F.shiftrightunsigned(x, 11) / F.lit(float(1 << 53))


def _drawn(texts: DataFrame, bound: int, kind: int, seed: int) -> DataFrame:
    """(kind, id, text) of at most ``bound`` different texts, those with the least hashes, whichever rows hold them.

    Equal texts fall under the threshold together and are one row a task before the shuffle.
    """
    hashed = texts.select("text", F.xxhash64(F.lit(seed), "text").alias("id"))
    different = hashed.agg(F.approx_count_distinct("id")).first()[0]
    chance = min(1.0, 1.25 * bound / max(different, 1))
    some = hashed.where(_unit(F.col("id")) < chance)
    last = some.select("id").distinct().orderBy("id").limit(bound).agg(F.max("id")).first()[0]
    rows = some.where(F.col("id") <= F.lit(last)).groupBy("id").agg(F.min("text").alias("text"))
    return rows.select(F.lit(kind).alias("kind"), "id", "text")


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    A document is a confirmed positive when one of its labels is 1; null labels, null ids and null texts do not
    count.  Labels other than 1 enter only the class prior.  Without positives every text gets the prior, which is
    next to 0 when there are no labels either.  Repeated rows and near copies count once.  The driver sees a sketch
    of 64 bytes a sampled text, and then only the chosen features of each.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("kind"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    drawn, bounds, counts = _drawn(texts, config.unlabelled, 0, config.seed + 1), {1: config.positives, 2: config.unlabelled}, {}
    for kind, bound in bounds.items():
        own = marks.where(F.col("kind") == kind)
        counts[kind] = own.count()
        hashed = own.withColumn("_h", F.xxhash64(F.lit(config.seed), "doc_id"))
        ids = hashed.where(_unit(F.col("_h")) < min(1.0, 1.25 * bound / max(counts[kind], 1))).orderBy("_h").limit(bound).select("doc_id")
        rows = texts.join(F.broadcast(ids), "doc_id", "left_semi")  # at most ``bound`` ids
        drawn = drawn.unionByName(_drawn(rows, bound, kind, config.seed))
    table = _table(drawn, config)
    sketches: dict[int, list] = {0: [], 1: [], 2: []}
    for r in table.select("kind", "id", "sketch").collect():
        sketches[r["kind"]].append(r)
    kept = {kind: _different(own) for kind, own in sketches.items()}
    prior = config.prior
    if prior is None:  # groups of copies count once: scale each side's share of different texts to its whole
        a, b = (counts[k] * len(kept[k]) / max(1, min(counts[k], bounds[k])) for k in (1, 2))
        prior = a / (a + b) if a + b else 0.0
    if not kept[1] or not kept[0]:
        return train([], [], np.empty(0, np.int64), prior, config)
    ids = table.sparkSession.createDataFrame([(k, i) for k in (0, 1) for i in kept[k]], "kind int, id bigint")
    own = table.join(F.broadcast(ids), ["kind", "id"], "left_semi")
    chosen = _chosen(own, len(kept[1]), len(kept[0]), config)
    bags = _bags(own, chosen)
    return train(bags[1], bags[0], chosen, prior, config)


def score(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where score >= 0.5), from the whole ``text`` alone.

    A null or empty text, or one without a known word or run, gets the score of no evidence.  Texts are read in blocks, so
    a very long one needs no more memory than a few copies of itself; occurrences beyond the third add nothing.
    Other columns, nulls in them and repeated rows pass through; score and predicted must not be among them.
    """
    if clash := {"score", "predicted"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the sample

    def run(batches):
        m = held.value
        cells, at = np.unique(m.features % config.cells, return_inverse=True)
        wanted = np.full(config.cells, -1, np.int32)
        wanted[cells] = np.arange(len(cells))
        table = np.zeros((len(LEVELS), len(cells)))
        table[m.features // config.cells, at] = m.weights
        for batch in batches:
            total = np.full(batch.num_rows, m.bias)
            for first, last, _, _ in chunks(batch.column("text")):
                row, cell, count = _counts(batch.column("text").slice(first, last - first), config.cells, wanted)
                weight = sum((table[i, cell] * (count >= n) for i, n in enumerate(LEVELS)), np.zeros(len(cell)))
                total[first:last] += np.bincount(row, weight, last - first)
            s = _sigmoid(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.mapInArrow(tidy(run), schema)
