"""Window features of keyed time series.

A series is the set of rows sharing ``keys``; ``date`` is unique inside it.  The operators
expect aggregated grain (one row per key and period), so a series is never longer than the
calendar and a window partition stays small however many raw rows fed one key.  All features
of one call share a single window spec: one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Keys and order of a family of time series."""

    keys: tuple[str, ...] = ("state", "district")
    date: str = "month_date"

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.date)

    @property
    def whole(self) -> WindowSpec:
        """All rows of the series; ordered like ``w`` so both share one sort."""
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def past(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def from_(self) -> WindowSpec:
        """The current row and all later ones, latest first: ``last`` over it is the next one.

        In reverse order the frame grows from row to row; the same rows in forward order would be added up again for each.
        """
        return Window.partitionBy(*self.keys).orderBy(F.desc(self.date)).rowsBetween(Window.unboundedPreceding, 0)

    def prev(self, n: int, extra_shift: int = 0) -> WindowSpec:
        """The n rows before the current one (optionally shifted further back)."""
        return self.w.rowsBetween(-n - extra_shift, -1 - extra_shift)


DISTRICT = Series()


def valid_lags(lags: Sequence[int]) -> list[int]:
    """Lags below one would read the present or the future and are left out."""
    return [k for k in lags if k >= 1]


def lag_cols(s: Series, y: str, lags: Sequence[int] = (1, 2, 3, 6), fill: bool = True) -> dict[str, Column]:
    mean = F.avg(y).over(s.whole)
    cols = {}
    for k in valid_lags(lags):
        v = F.lag(y, k).over(s.w).cast("double")
        cols[f"{y}_lag_{k}"] = F.coalesce(v, mean) if fill else v
    return cols


def rolling_cols(
    s: Series, y: str, windows: Sequence[int] = (3, 6), std: bool = True, fill: bool = True
) -> dict[str, Column]:
    """Mean (from one row on) and sample deviation (from two rows on) of the n previous rows."""
    cols = {}
    for n in windows:
        mean = F.avg(y).over(s.prev(n))
        cols[f"{y}_rolling_{n}_mean"] = F.coalesce(mean, F.avg(y).over(s.whole)) if fill else mean
        if std:
            dev = F.stddev_samp(y).over(s.prev(n))
            cols[f"{y}_rolling_{n}_std"] = F.coalesce(dev, F.stddev_samp(y).over(s.whole)) if fill else dev
    return cols


def full_rolling_cols(s: Series, y: str, windows: Sequence[int] = (7, 30)) -> dict[str, Column]:
    """Rolling mean that stays null until the whole window is filled."""
    return {
        f"{y}_roll{n}_mean": F.when(F.count(y).over(s.prev(n)) == n, F.avg(y).over(s.prev(n))) for n in windows
    }


def diff_cols(s: Series, y: str, periods: Sequence[int] = (1,), fill: bool = True) -> dict[str, Column]:
    cols = {}
    for k in periods:
        d = (F.col(y) - F.lag(y, k).over(s.w)).cast("double")
        cols[f"{y}_diff_{k}"] = F.coalesce(d, F.lit(0.0)) if fill else d
    return cols


def pct_change_cols(s: Series, y: str, periods: Sequence[int] = (1,), fill: bool = True) -> dict[str, Column]:
    """Relative change; a zero base gives null instead of infinity, and null becomes 0 when filled."""
    cols = {}
    for k in periods:
        before = F.lag(y, k).over(s.w).cast("double")
        p = F.try_divide(F.col(y) - before, before)
        cols[f"{y}_pct_change_{k}"] = F.coalesce(p, F.lit(0.0)) if fill else p
    return cols


def lead_col(s: Series, y: str, k: int = 1) -> Column:
    return F.lead(y, k).over(s.w)


def stability_cols(
    s: Series, y: str, windows: Sequence[int] = (3, 6), extra_shift: int = 0
) -> dict[str, Column]:
    """Mean, deviation and maximum of the lagged series over n rows."""
    cols = {}
    for n in windows:
        f = s.prev(n, extra_shift)
        cols[f"roll_lag1m_mean_{n}"] = F.avg(y).over(f)
        cols[f"roll_lag1m_std_{n}"] = F.stddev_samp(y).over(f)
        cols[f"roll_lag1m_max_{n}"] = F.max(y).over(f).cast("double")
    return cols


def rolling_median_cols(s: Series, y: str, windows: Sequence[int] = (3, 6)) -> dict[str, Column]:
    return {f"{y}_rolling_{n}_median": F.expr(f"percentile({y}, 0.5D)").over(s.prev(n)) for n in windows}


def add_series_features(
    df: DataFrame,
    y: str,
    s: Series = DISTRICT,
    lags: Sequence[int] = (1, 2, 3, 6),
    windows: Sequence[int] = (3, 6),
    diff: bool = True,
    pct_change: bool = False,
    fill: bool = True,
) -> DataFrame:
    """Lag, rolling, difference and change features in one projection."""
    cols = {**lag_cols(s, y, lags, fill), **rolling_cols(s, y, windows, True, fill)}
    if diff:
        cols |= diff_cols(s, y, (1,), fill)
    if pct_change:
        cols |= pct_change_cols(s, y, (1,), fill)
    return df.withColumns(cols)


def error_band(df: DataFrame, month: str, actual: str, pred: str, n: int = 3, z: float = 1.28) -> DataFrame:
    """Rolling MAE including the current row, and the prediction band it implies.

    Meant for national totals: one row per month, so the ordered window holds months only.
    """
    w = Window.orderBy(month).rowsBetween(-(n - 1), 0)
    mae = F.avg(F.abs(F.col(actual) - F.col(pred))).over(w)
    return (
        df.withColumn("rolling_mae", mae)
        .withColumn("lower", F.greatest(F.lit(0.0), F.col(pred) - z * F.col("rolling_mae")))
        .withColumn("upper", F.col(pred) + z * F.col("rolling_mae"))
    )


def volume_segments(
    df: DataFrame, y: str, s: Series = DISTRICT, low: float = 0.33, high: float = 0.67, name: str = "volume_bucket"
) -> DataFrame:
    """low / medium / high by quantiles of the series' expanding median.

    Rows fall back to terciles of the series itself when no expanding median exists.
    """
    med = df.withColumn("_med", F.expr(f"percentile({y}, 0.5D)").over(s.upto))
    edges = med.withColumns(
        {
            "_q": F.expr(f"percentile(_med, array({low}D, {high}D))").over(s.whole),
            "_t": F.expr(f"percentile({y}, array({1 / 3}D, {2 / 3}D))").over(s.whole),
        }
    )
    lo, hi = F.coalesce(F.col("_q")[0], F.col("_t")[0]), F.coalesce(F.col("_q")[1], F.col("_t")[1])
    bucket = F.when(F.col(y) <= lo, "low").when(F.col(y) <= hi, "medium").when(F.col(y) > hi, "high")
    return edges.withColumn(name, bucket).drop("_med", "_q", "_t")


def densify_months(df: DataFrame, keys: Sequence[str], date: str = "month_date") -> DataFrame:
    """One row per key and calendar month between the first and last month of the table.

    Empty grid rows, generated per distinct key by ``sequence``, are added to the data and merged
    by an aggregate.  Rows are partitioned by the series keys up front, which serves the
    aggregate and every series window that follows: one exchange for all of them.
    """
    values = [c for c in df.columns if c not in (*keys, date)]
    ends = df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi"))).scalar()
    grid = (
        df.select(*keys)
        .distinct()
        .withColumn("_ends", ends)
        .withColumn(date, F.explode(F.sequence("_ends.lo", "_ends.hi", F.expr("interval 1 month"))))
        .drop("_ends")
    )
    both = df.unionByName(grid, allowMissingColumns=True).repartition(*keys)
    merged = both.groupBy(*keys, date).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
    return merged.select(*df.columns)
