"""Lag and rolling features of monthly series kept in stream state: a batch touches only the series it changes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelcast.operators.monitor import alerts
from panelcast.session import ship_package
from panelcast.streaming.incremental import changed_rows_writer, latest_rows, run_available

_STATE = "months array<int>, sums array<double>"


def _features(months: list[int], sums: np.ndarray, changed: set[int], lags: Sequence[int], windows: Sequence[int]) -> dict[str, list]:
    """Rows that a change in some months can touch: these and the following ones within reach."""
    reach = max((*lags, *windows, 0))
    at = [i for i in range(len(months)) if any(months[j] in changed for j in range(max(0, i - reach), i + 1))]
    out: dict[str, list] = {"month": [months[i] for i in at], "y": [sums[i] for i in at]}
    for k in lags:
        out[f"lag_{k}"] = [sums[i - k] if i >= k else np.nan for i in at]
    for n in windows:
        past = [sums[max(0, i - n) : i] for i in at]
        past = [p[~np.isnan(p)] for p in past]
        out[f"rolling_{n}_mean"] = [p.mean() if len(p) else np.nan for p in past]
        out[f"rolling_{n}_std"] = [p.std(ddof=1) if len(p) > 1 else np.nan for p in past]
    return out


def series_features(stream: DataFrame, keys: Sequence[str], date: str, y: str, lags: Sequence[int] = (1, 2, 3), windows: Sequence[int] = (3,)) -> DataFrame:
    """Changed rows (keys, month_date, y, lag_k, rolling_n_mean, rolling_n_std) after every batch.

    State is the monthly sums of a series, as long as the calendar.  Rows may come in any order and a month in any
    number of batches; a change emits the month again and the later ones that look back on it.  Null values add
    nothing; a month with nothing but nulls has a null sum.  Rows without a date are left out.  Rows of a key pass
    through one task as a stream.
    """
    spark = stream.sparkSession
    ship_package(spark)
    month = (F.year(date) * 12 + F.month(date) - 1).cast("int").alias("month")
    rows = stream.where(F.col(date).isNotNull()).select(*keys, month, F.col(y).cast("double").alias("y"))
    names = ["y", *(f"lag_{k}" for k in lags), *(f"rolling_{n}_{x}" for n in windows for x in ("mean", "std"))]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("month", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        held = {m: np.nan if v is None else v for m, v in held.items()}
        changed: set[int] = set()
        for part in parts:
            for m, v in part.groupby("month")["y"].sum(min_count=1).items():
                old = held.get(int(m), np.nan)
                held[int(m)] = old if pd.isna(v) else float(v) if np.isnan(old) else old + float(v)
                changed.add(int(m))
        months = sorted(held)
        sums = np.array([held[m] for m in months], float)
        state.update((months, [None if np.isnan(v) else float(v) for v in sums]))
        found = pd.DataFrame(_features(months, sums, changed, lags, windows))
        for i, k in enumerate(keys):
            found.insert(i, k, key[i])
        yield found[[*keys, "month", *names]]

    changed = rows.groupBy(*keys).applyInPandasWithState(update, schema, _STATE, "update", GroupStateTimeout.NoTimeout)
    first = F.make_date((F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1)).alias("month_date")
    return changed.select(*keys, first, *(F.nullif(F.nanvl(F.col(n), F.lit(None)), F.lit(float("nan"))).alias(n) for n in names))


def keep_features(stream: DataFrame, keys: Sequence[str], date: str, y: str, out: str, checkpoint: str, lags: Sequence[int] = (1, 2, 3),
                  windows: Sequence[int] = (3,)) -> StreamingQuery:
    """Writes the changed rows of every batch below ``out``; ``newest_features`` reads the current table."""
    return run_available(series_features(stream, keys, date, y, lags, windows), changed_rows_writer(out), checkpoint)


def newest_features(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    return latest_rows(spark, out, [*keys, "month_date"])


def alerts_from_features(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alerts of the current table: the forecast is the mean of the past three rows, the naive one the last value."""
    rows = features.select(*keys, "month_date", "y", F.col("rolling_3_mean").alias("yhat"), F.col("lag_1").alias("yhat2")).where("yhat is not null")
    return alerts(rows, [*keys, "month_date"])
