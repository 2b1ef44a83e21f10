"""Number columns packed into one row per bucket, so that a shuffle moves arrays and not single values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records gathered in a task before they are packed and passed on.
FLUSH = 1 << 19


class Packer:
    """Gathers records in numpy columns and gives them out as rows (bucket, column blobs ...)."""

    def __init__(self, dtypes: dict[str, str], flush: int = FLUSH) -> None:
        self.dtypes, self.flush, self.parts, self.held = dtypes, flush, [], 0

    def add(self, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.parts.append((bucket.astype(np.int32), *(columns[c].astype(t, copy=False) for c, t in self.dtypes.items())))
            self.held += len(bucket)
        if self.held >= self.flush:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), *blobs], ["bucket", *self.dtypes])


def unpack(blobs: Iterator[bytes], dtype: str) -> np.ndarray:
    """The blobs of a bucket as one array."""
    return np.frombuffer(b"".join(bytes(x) for x in blobs), dtype)


def schema(dtypes: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in dtypes)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a packed shuffle: one for each shuffle partition, so a bucket shrinks as that setting grows.

    A task gives out one packed row for each bucket it reaches, as a shuffle writes one block.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_names(spark: SparkSession) -> np.ndarray:
    """A number for each bucket that Spark's hash sends to a partition of its own, so that no task gets several.

    A few numbers for each partition are hashed; the first that falls to a partition names its bucket.
    """
    n = bucket_count(spark)
    tried = 16
    while True:
        rows = spark.range(tried * n).select(F.col("id").cast("int").alias("name"))
        first = rows.groupBy(F.pmod(F.hash("name"), F.lit(n)).alias("part")).agg(F.min("name").alias("name")).collect()
        if len(first) == n:
            return np.array([r["name"] for r in sorted(first, key=lambda r: r["part"])], np.int32)
        tried *= 4


#: Bits of a membership bitmap: 4 MB whatever the corpus size.  It only spares work; false hits are harmless.
BITMAP_BITS = 1 << 25


def bitmap(df: DataFrame, key: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size over the lowest bits of 64-bit keys; at most ``bits`` / 8 bytes reach the driver."""
    at = F.pmod(key, F.lit(bits)) + 1
    rows = (
        df.select(at.alias("_at"))
        .groupBy(F.bitmap_bucket_number("_at").alias("n"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("b"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        a = (r["n"] - 1) * 4096
        out[a : a + 4096] = np.frombuffer(bytes(r["b"]), np.uint8)[: len(out) - a]
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

