"""Shards of nearly equal bytes by sampled splitters.

Records are sorted by (hash of the text, doc_id), so equal texts stand together.  A sample drawn with
chances in proportion to size gives splitters at its quantiles; the ranges between them hold about equal
bytes, and one text that fills many ranges is split by doc_id.  Exact sums show ranges that are still
overfull, by bytes or by rows; they are sampled again, more finely, and subdivided until none is left.  A record's place in its range plus the
sums of the ranges before it is its place in the whole, and the shard follows from that: shards differ
by one record's bytes at most, and no task sorts more than a range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


@dataclass(frozen=True)
class ShardConfig:
    """``rows_per_range`` bounds what a task sorts, but for rows of one key and id; the driver holds ``samples_per_range``
    keys for each range."""

    shards: int = 40
    overhead: int = 16
    ranges_per_shard: int = 8
    rows_per_range: int = 500_000
    samples_per_range: int = 24
    overfull: float = 2.0


class Splitters:
    """Sorted (key, id) pairs; ``place`` counts those at or below each record."""

    def __init__(self, pairs: list[tuple[int, int]]) -> None:
        pairs = sorted(set(pairs))
        self.key, self.id = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)

    def place(self, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out = lo.copy()
        tied = np.flatnonzero(lo < hi)
        order = tied[np.argsort(key[tied], kind="stable")]
        cuts = np.append(np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), key[order][1:] != key[order][:-1]))), len(order))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[i:j]
            a, b = lo[rows[0]], hi[rows[0]]
            out[rows] = a + np.searchsorted(self.id[a:b], ids[rows], "right")
        return out


def _quantiles(sample: list, ranges: int) -> list[tuple[int, int]]:
    """Keys that cut a weighted sample into ``ranges`` equal parts."""
    if not sample:
        return []
    pairs = sorted((r["_key"], r["_id"], r["_weight"]) for r in sample)
    sums = np.cumsum([w for _, _, w in pairs])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges)
    return [pairs[i][:2] for i in np.unique(at)]


def _in_range(splitters: Splitters, names: list[str]):
    def run(batches):
        for batch in batches:
            key, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_id"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splitters.place(key, ids))], [*names, "_range"])

    return run


def _ranged(rows: DataFrame, splitters: Splitters) -> DataFrame:
    schema = rows.withColumn("_range", F.lit(0).cast("bigint")).schema
    return rows.mapInArrow(_in_range(splitters, rows.columns), schema)


def _parts(held, config: ShardConfig, usual: float) -> int:
    """Into how many parts a range (bytes, n, low, high) has to be cut; 0 when it is not overfull or one (key, id) alone."""
    if held["low"] == held["high"] or held["bytes"] <= config.overfull * usual and held["n"] <= config.rows_per_range:
        return 0
    return 1 + max(int(held["bytes"] / usual), 2 * held["n"] // config.rows_per_range)


def _draw(rows: DataFrame, chance: Column, salt: int) -> list:
    """A sample with the given chances; a record with a chance above 1 counts for more."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "_key", "_id"), 11) / F.lit(float(1 << 53))
    return rows.where(unit < chance).select("_key", "_id", F.greatest(chance, F.lit(1.0)).alias("_weight")).collect()


def shard_by_bytes(docs: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in one of ``shards`` shards of nearly equal bytes.

    ``docs`` has doc_id and text; other columns are ignored.  A record's size is the UTF-8 bytes of its text (0
    for null, whose CRC is that of no bytes) plus ``overhead``.  Slots count from 0 without gaps in each shard.
    A null doc_id sorts before all others; rows repeated whole are interchangeable and each gets its own slot.
    The same rows give the same shards, however they are stored.  An empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + config.overhead).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_id"),
        )
    )
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    out = "doc_id bigint, size bigint, text_crc32 bigint, shard int, _place bigint"
    if not count:
        return rows.sparkSession.createDataFrame([], out.replace("_place", "slot"))
    ranges = max(config.shards * config.ranges_per_shard, -(-2 * count // config.rows_per_range))
    rate = ranges * config.samples_per_range / total
    pairs = _quantiles(_draw(rows, F.col("size") * F.lit(rate), 0), ranges)
    again = 0
    while True:
        splitters = Splitters(pairs)
        ends = F.min(F.struct("_key", "_id")).alias("low"), F.max(F.struct("_key", "_id")).alias("high")
        held = _ranged(rows, splitters).groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).orderBy("_range").collect()
        parts = {r["_range"]: _parts(r, config, total / ranges) for r in held}
        if not any(parts.values()):
            break
        again += 1
        wanted = F.create_map(*(F.lit(x) for r in held if (k := parts[r["_range"]]) for x in (r["_range"], k * config.samples_per_range / r["n"])))
        sizes = F.create_map(*(F.lit(x) for r in held if parts[r["_range"]] for x in (r["_range"], r["bytes"] / r["n"])))
        some = _ranged(rows, splitters).where(F.col("_range").isin([r for r, k in parts.items() if k]))
        # by bytes as by rows: half of the chance of a record goes with its size
        chance = wanted[F.col("_range")] * (F.lit(0.5) + F.lit(0.5) * F.col("size") / sizes[F.col("_range")])
        drawn: dict[int, list] = {}
        place = splitters.place
        for r in _draw(some, chance, again):
            drawn.setdefault(int(place(np.array([r["_key"]]), np.array([r["_id"]]))[0]), []).append(r)
        for r in held:
            if k := parts[r["_range"]]:
                pairs = pairs + _quantiles(drawn.get(r["_range"], []), k) + [tuple(r["high"])]  # the last record is cut off at least
    numbers = np.array([r["_range"] for r in held])
    before_bytes = np.concatenate(([0], np.cumsum([r["bytes"] for r in held])))
    before_rows = np.concatenate(([0], np.cumsum([r["n"] for r in held])))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_id", "size", "text_crc32"], kind="stable")
        at = int(np.searchsorted(numbers, pdf["_range"].iloc[0]))
        twice = 2 * (before_bytes[at] + pdf["size"].cumsum()) - pdf["size"]  # twice the middle of the record
        shard = [min(config.shards - 1, int(x) * config.shards // (2 * int(total))) for x in twice]
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"].astype("Int64"), "size": pdf["size"], "text_crc32": pdf["text_crc32"], "shard": shard, "_place": before_rows[at] + np.arange(len(pdf))}
        )

    placed = cut_lineage(_ranged(rows, splitters).groupBy("_range").applyInPandas(deal, out))
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"))
