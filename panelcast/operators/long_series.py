"""Windows over series that are longer than a task.

Rows are range-partitioned by key and date, so a partition holds consecutive rows and a long series is a chain
of segments, one a partition.  Windows run inside segments.  One row a segment says what later or earlier ones
need of it: its length, its first and last known value, its last few rows.  A window over these rows carries
them along the chain, and every row combines its segment's result with the carry.

What follows a row is read in reverse order: a frame that only grows costs one step a row, while one that shrinks
towards the end is added up again for every row, which is quadratic in the segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.series import DISTRICT, Series
from panelcast.session import cut_lineage


def _time(date: Column, kind: T.DataType) -> Column:
    """A number that grows with time: days of a date, microseconds of a timestamp."""
    if isinstance(kind, T.DateType):
        return F.unix_date(date).cast("double")
    return F.unix_micros(date.cast("timestamp")).cast("double")


def _segment(s: Series) -> Series:
    """Rows of a series inside one partition, in the order they were written in."""
    return Series((*s.keys, "_part"), "_row")


def with_carry(df: DataFrame, y: str, s: Series = DISTRICT, rows: int = 0, parts: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with what each row needs of other segments of its series.

    ``_row``: number in the partition; ``_i``: number in the segment; ``_run_before``: nulls that end the rows before the segment; ``_last`` and
    ``_next`` (t, v): nearest known value before and after the segment; ``_tail``: the ``rows`` values before it,
    oldest first.  ``parts`` is the number of range partitions, by default that of a shuffle.  Rows of one date follow
    each other by ``ties``, or in any order, which is written down so that all windows see the same one.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*s.keys, s.date]
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order, *ties).withColumn("_part", F.spark_partition_id())
    laid = cut_lineage(sorted_.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    segment = _segment(s)
    known = F.col(y).isNotNull()
    point = F.when(known, F.struct(_time(F.col(s.date), df.schema[s.date].dataType).alias("t"), F.col(y).cast("double").alias("v")))
    numbered = laid.withColumns({"_i": F.row_number().over(segment.w), "_n": F.count(F.lit(1)).over(segment.whole), "_point": point})
    late = F.when(F.col("_i") > F.col("_n") - rows, F.struct("_i", F.col(y).cast("double").alias("v")))
    ends = numbered.groupBy(*s.keys, "_part").agg(
        F.max("_n").alias("_n"), F.max(F.when(known, F.col("_i"))).alias("_at"),
        F.min_by("_point", F.when(known, F.col("_i"))).alias("_first"), F.max_by("_point", F.when(known, F.col("_i"))).alias("_final"),
        F.transform(F.sort_array(F.collect_list(late)), lambda e: e["v"]).alias("_values"),
    )
    chain = Window.partitionBy(*s.keys).orderBy("_part")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*s.keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("_n").over(before), F.lit(0))
    carry = ends.withColumn("_start", so_far).withColumn("_known_at", F.col("_start") + F.col("_at")).select(
        *s.keys, "_part", (F.col("_start") - F.coalesce(F.last("_known_at", ignorenulls=True).over(before), F.lit(0))).alias("_run_before"),
        F.last("_final", ignorenulls=True).over(before).alias("_last"), F.last("_first", ignorenulls=True).over(after).alias("_next"),
        (F.flatten(F.collect_list("_values").over(chain.rowsBetween(-max(rows, 1), -1))) if rows else F.array().cast("array<double>")).alias("_tail"),
    )
    tail = F.when(F.size("_tail") > rows, F.slice("_tail", -rows, rows)).otherwise(F.col("_tail")) if rows else F.col("_tail")
    return numbered.drop("_n").join(carry.withColumn("_tail", tail), [*s.keys, "_part"])


_CARRIED = ("_part", "_row", "_i", "_point", "_run_before", "_last", "_next", "_tail")


def null_run_position(df: DataFrame, y: str, s: Series = DISTRICT, name: str = "null_run", parts: int | None = None) -> DataFrame:
    """Position of each null inside its run of nulls; 0 on values."""
    carried = with_carry(df, y, s, parts=parts)
    return carried.withColumn(name, _run(y, s)).drop(*_CARRIED)


def _run(y: str, s: Series) -> Column:
    last_at = F.max(F.when(F.col(y).isNotNull(), F.col("_i"))).over(_segment(s).upto)
    return F.when(last_at.isNull(), F.col("_run_before") + F.col("_i")).otherwise(F.col("_i") - last_at).cast("int")


def fill_gaps(df: DataFrame, y: str, s: Series = DISTRICT, max_gap: int = 3, parts: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``null_run``, ``locf`` and ``linear``, all from one layout.

    ``locf``: the last value carried into the first ``max_gap`` nulls of a run.  ``linear``: the straight line by
    time between the neighbours; trailing nulls repeat the last value, leading ones stay null.  Between neighbours of
    one date there is no line, so ``linear`` is NaN.
    """
    segment = _segment(s)
    carried = with_carry(df, y, s, parts=parts, ties=ties)
    p = F.coalesce(F.last("_point", ignorenulls=True).over(segment.upto), F.col("_last"))
    n = F.coalesce(F.last("_point", ignorenulls=True).over(segment.from_), F.col("_next"))
    ends = carried.withColumns({"null_run": _run(y, s), "_p": p, "_q": n})
    t = _time(F.col(s.date), df.schema[s.date].dataType)
    share = F.coalesce(F.try_divide(t - F.col("_p.t"), F.col("_q.t") - F.col("_p.t")), F.lit(float("nan")))
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share
    linear = (
        F.when(F.col(y).isNotNull(), F.col(y).cast("double")).when(F.col("_p").isNull(), F.lit(None).cast("double")).when(F.col("_q").isNull(), F.col("_p.v")).otherwise(line)
    )
    return ends.withColumns({"locf": F.when(F.col("null_run") <= max_gap, F.col("_p.v")), "linear": linear}).drop(*_CARRIED, "_p", "_q")


def rolling(df: DataFrame, y: str, s: Series = DISTRICT, n: int = 3, parts: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the mean (of one value at least) and sample deviation (two at least) of the past ``n`` rows."""
    segment = _segment(s)
    carried = with_carry(df, y, s, n, parts, ties)
    short = F.greatest(F.lit(n) - F.col("_i") + 1, F.lit(0))  # rows that lie before the segment
    take = F.least(short, F.size("_tail"))
    old = F.filter(F.when(take > 0, F.slice("_tail", F.size("_tail") - take + 1, take)).otherwise(F.array().cast("array<double>")), lambda v: v.isNotNull())
    frame, x = segment.prev(n), F.col(y).cast("double")
    parted = carried.withColumns(
        {"_old": old, "_c": F.count(x).over(frame), "_m": F.coalesce(F.avg(x).over(frame), F.lit(0.0)), "_v": F.coalesce(F.var_pop(x).over(frame), F.lit(0.0))}
    )
    k = F.size("_old")
    mean = F.when(k > 0, F.aggregate("_old", F.lit(0.0), lambda a, v: a + v) / k).otherwise(F.lit(0.0))
    merged = parted.withColumns({"_k": k, "_om": mean}).withColumn("_os", F.aggregate("_old", F.lit(0.0), lambda a, v: a + (v - F.col("_om")) * (v - F.col("_om"))))
    both, gap = F.col("_c") + F.col("_k"), F.col("_m") - F.col("_om")
    total = F.col("_v") * F.col("_c") + F.col("_os") + gap * gap * F.col("_c") * F.col("_k") / both
    out = merged.withColumns(
        {
            f"rolling_{n}_mean": F.when(both >= 1, (F.col("_m") * F.col("_c") + F.col("_om") * F.col("_k")) / both),
            f"rolling_{n}_std": F.when(both >= 2, F.sqrt(total / (both - 1))),
        }
    )
    return out.drop(*_CARRIED, "_old", "_c", "_m", "_v", "_k", "_om", "_os")
