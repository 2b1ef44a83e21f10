"""Order statistics of the past of a series, without sorting the past again for every row."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.series import DISTRICT, Series
from panelcast.session import ship_package


def _at(held: list[float], p: float) -> float:
    """Quantile of a sorted list, linear between neighbours."""
    x = p * (len(held) - 1)
    lo = int(x)
    a, b = held[lo], held[min(lo + 1, len(held) - 1)]
    return a if a == b or x == lo else (lo + 1 - x) * a + (x - lo) * b


def running_quantiles(df: DataFrame, y: str, s: Series = DISTRICT, probs: Sequence[float] = (0.25, 0.75), name: str = "q", upto: bool = False) -> DataFrame:
    """``df`` with an array of quantiles of the earlier rows of the series (with ``upto`` the row itself too).

    The values so far are kept sorted and each new one is put in its place, so a row costs a binary search.  Nulls
    do not count; without an earlier value the array is null.  A series is one group.
    """
    ship_package(df.sparkSession)
    columns = df.columns
    schema = df.select("*", F.lit(None).cast("array<double>").alias(name)).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(s.date)
        held: list[float] = []
        out: list[list[float] | None] = []
        for v in table.column(y).cast(pa.float64()).to_pylist():
            if upto and v is not None:
                insort(held, v)
            out.append([_at(held, p) for p in probs] if held else None)
            if not upto and v is not None:
                insort(held, v)
        return table.select(columns).append_column(name, pa.array(out, pa.list_(pa.float64())))

    return df.groupBy(*s.keys).applyInArrow(run, schema)


def past_iqr_outliers(df: DataFrame, y: str, s: Series = DISTRICT, multiplier: float = 1.5, min_history: int = 4, name: str = "is_outlier") -> DataFrame:
    """``df`` with a flag where y leaves the fences of the quartiles of all earlier rows, once there are more than ``min_history``."""
    q = running_quantiles(df.withColumn("_row", F.row_number().over(s.w)), y, s, (0.25, 0.75), "_q")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    spread = (hi - lo) * multiplier
    outside = (F.col(y) < lo - spread) | (F.col(y) > hi + spread)
    return q.withColumn(name, F.coalesce((F.col("_row") > min_history) & outside, F.lit(False))).drop("_row", "_q")
