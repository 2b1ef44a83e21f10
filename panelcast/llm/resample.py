"""Importance resampling towards a target corpus by bit-sliced sums.

Hashed n-gram counts of the documents and of the target give each bucket an integer gain, a scaled log
ratio.  A document's weight is the sum of gains over its n-grams.  Its bucket counts are held as bit
planes, one bit a bucket; the gains as planes of their two's complement.  The popcount of count plane j
AND gain plane i, times 2**(i + j) (the sign plane counts negative), sums to the exact weight.  Gumbel
noise from a hash of the id turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.pieces import blocks, crc32
from panelcast.llm.workers import tidy
from panelcast.operators.ranking import global_position
from panelcast.session import cut_lineage

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words after folding A-Z: digits, letters and everything beyond ASCII.
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True
_SPACE = np.frombuffer(b" ", np.uint8)


@dataclass(frozen=True)
class ResampleConfig:
    """``share`` is a pair: of N eligible documents floor(share[0] * N / share[1]) are drawn."""

    orders: tuple[int, int] = (1, 1)
    buckets: int = 10_000
    scale: int = 1000
    min_words: int = 20
    share: tuple[int, int] = (10, 100)
    seed: int = 2024


def _features(column: pa.Array, config: ResampleConfig):
    """(rows, buckets, rows of the words) block by block; one entry an n-gram."""
    low, high = config.orders
    for b in blocks(column, _SOLID, high, _FOLD):
        row, bucket = [], []
        crc = np.zeros(b.own, np.uint32)
        start = np.arange(b.own)
        for n in range(1, high + 1):
            last = start + n - 1
            inside = last < len(b.row)  # a block holds whole texts, or one text and the words its n-grams reach
            inside[inside] = b.row[last[inside]] == b.row[start[inside]]
            start, crc, last = start[inside], crc[inside], last[inside]
            if n > 1:
                crc = crc32(_SPACE, np.zeros(len(crc), np.int64), np.ones(len(crc), np.int64), crc)
            crc = crc32(b.values, b.start[last], b.end[last], crc)
            if n >= low:
                row.append(b.row[start])
                bucket.append((crc % np.uint32(config.buckets)).astype(np.int64))
        yield np.concatenate(row), np.concatenate(bucket), b.row[: b.own]


def bucket_counts(docs: DataFrame, config: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """How often each bucket occurs in all texts.  A task sums its own; at most ``buckets`` rows reach the driver."""

    def run(batches):
        sums = np.zeros(config.buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in _features(batch.column("text"), config):
                sums += np.bincount(bucket, minlength=config.buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(config.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray, config: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """floor(scale * ln(smoothed target share / smoothed share)) of each bucket."""
    b, all_docs, all_target = config.buckets, int(docs.sum()), int(target.sum())
    return np.array(
        [
            math.floor(config.scale * math.log(float(t + 1) * float(all_docs + b) / (float(s + 1) * float(all_target + b))))
            for s, t in zip(docs.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def _packed(flags: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    rows, n = flags.shape
    wide = np.zeros((rows, -(-n // 64) * 64), bool)
    wide[:, :n] = flags
    return np.packbits(wide, axis=1).view(np.uint64)


class GainPlanes:
    """Gains sliced into bit planes of their two's complement."""

    def __init__(self, gain: np.ndarray) -> None:
        bits = max(int(np.abs(gain).max(initial=0)).bit_length(), 1) + 1
        self.buckets = len(gain)
        self.planes = _packed((gain[None, :] >> np.arange(bits)[:, None]) & 1 == 1)
        self.power = 1 << np.arange(bits, dtype=np.int64)
        self.power[-1] *= -1

    def weigh(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        """The sum of gains over each row's buckets, repeats counted."""
        out = np.zeros(rows, np.int64)
        if not len(row):
            return out
        key, count = np.unique(row * self.buckets + bucket, return_counts=True)
        row, bucket = key // self.buckets, key % self.buckets
        for j in range(int(count.max()).bit_length()):
            has = (count >> j) & 1 == 1
            own, at = np.unique(row[has], return_inverse=True)
            for a in range(0, len(own), 256):  # a few MB of flags at a time
                here = (at >= a) & (at < a + 256)
                flags = np.zeros((min(256, len(own) - a), self.buckets), bool)
                flags[at[here] - a, bucket[has][here]] = True
                plane = _packed(flags)
                sums = np.zeros(len(plane), np.int64)
                for gain, power in zip(self.planes, self.power, strict=True):
                    sums += power * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                out[own[a : a + 256]] += sums << j
        return out


def weights(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """All columns of ``docs`` but ``text``, with n_words, n_features and weight.

    Both tables have ``text``, read whole and block by block, however long; null is empty.  A text without a
    word weighs 0.  Other columns, nulls in them and repeated rows pass through; an empty table gives an empty one.
    """
    names = ["n_words", "n_features", "weight"]
    if clash := set(names) & {c.lower() for c in docs.columns if c != "text"}:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    planes = GainPlanes(gains(bucket_counts(docs, config), bucket_counts(target, config), config))
    held = docs.sparkSession.sparkContext.broadcast(planes)  # buckets x about 16 bits
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, weight = (np.zeros(rows, np.int64) for _ in names)
            for row, bucket, word in _features(batch.column("text"), config):
                n_words += np.bincount(word, minlength=rows)
                n_features += np.bincount(row, minlength=rows)
                weight += held.value.weigh(row, bucket, rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n_words), pa.array(n_features), pa.array(weight)], [*others, *names])

    schema = docs.drop("text").select("*", *(F.lit(0).cast("bigint").alias(n) for n in names)).schema
    return docs.mapInArrow(tidy(run), schema)


def noisy_score(config: ResampleConfig = ResampleConfig()):
    """weight plus scaled Gumbel noise that the seed and doc_id (null: empty text) decide."""
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.col("weight") + F.floor(F.lit(-float(config.scale)) * F.ln(-F.ln(u)))


def resample(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    Of the N rows with at least ``min_words`` words the floor(share * N) with the highest scores are drawn and
    ranked from 1; the rank of all others is null.  Ties go to the smaller doc_id, a null one last; rows alike in
    both are interchangeable and each gets its own rank.  Ranks come from range partitions, no task sees all rows.
    """
    weighed = weights(docs.select("doc_id", "text"), target, config)
    rows = cut_lineage(weighed.withColumn("score", noisy_score(config)).withColumn("_spread", F.rand(config.seed)))
    enough = F.col("n_words") >= config.min_words
    drawn = F.floor(F.lit(config.share[0]) * rows.where(enough).count() / F.lit(config.share[1]))
    ranked = global_position(rows.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_spread")], "_at")
    rank = F.when(F.col("_at") < drawn, (F.col("_at") + 1).cast("bigint")).alias("rank")
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*out, rank).unionByName(rows.where(~enough).select(*out, F.lit(None).cast("bigint").alias("rank")))
