"""Positions, top-k, keep-first and sorted dictionaries without single-task sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

Order = Sequence[str | Column]


def global_position(df: DataFrame, order: Order, name: str = "position") -> DataFrame:
    """0-based position of every row in the total order, exact and fully distributed.

    Rows are range-partitioned and sorted, and written with partition number and row number so
    that the layout is fixed; a row's position is the size of the partitions before its own plus
    its index inside it.  The offset table has one row per partition and is the only broadcast side.
    """
    laid_out = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    )
    laid_out = cut_lineage(laid_out)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        laid_out.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_before"))
        .drop("_part", "_row", "_before")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per key: the first by ``order``.

    An aggregate on the ordering struct, not a window: partial results shrink every key to one
    row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    sort_key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sort_key).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, by: Column, ties: Sequence[str], k: int) -> DataFrame:
    """Global top-k with key columns as tie-break."""
    return df.orderBy(by, *ties).limit(k)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], by: Column, ties: Sequence[str], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows of every group; Spark cuts each group to k rows per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(by, *ties)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def order_statistics(df: DataFrame, by: str, ties: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Rows at positions ``floor(n * f)`` of the order (``f`` = 1 gives the last row)."""
    ranked = global_position(df, [by, *ties])
    n = ranked.agg(F.count(F.lit(1))).scalar()
    picks = F.array(*[F.least(F.floor(n * F.lit(float(f))), n - 1) for f in fractions])
    return ranked.where(F.array_contains(picks, F.col("position")))


def distinct_index(df: DataFrame, col: str, index: str = "idx") -> DataFrame:
    """Sorted distinct values with their 0-based rank."""
    return global_position(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], index).withColumn(
        index, F.col(index).cast("int")
    )


def month_index(df: DataFrame, date: str = "month_date") -> DataFrame:
    """0-based rank of every distinct month in the data; bounded by the calendar."""
    months = df.agg(F.array_sort(F.collect_set(F.trunc(date, "MM"))).alias("m"))
    return months.select(F.posexplode("m").alias("month_idx", date))
