"""Autocorrelation of keyed series and lag selection.

Sums of lagged products come from windows and one aggregate; everything after that works on an
array of at most ``max_lag + 1`` numbers per series, inside the row, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.series import DISTRICT, Series

# Lags used when nothing can be estimated.
DEFAULT_LAGS = (1, 2, 3, 6)


def acf(df: DataFrame, y: str, s: Series = DISTRICT, max_lag: int = 12, keep_short: bool = False) -> DataFrame:
    """Biased autocorrelations 0..m per series, m = min(max_lag, n // 2 - 1).

    Series shorter than ``max_lag + 2`` are left out, or kept with a null array.
    """
    x = F.col(y) - F.avg(y).over(s.whole)
    centred = df.select(*s.keys, s.date, x.alias("_x"))
    products = [(F.col("_x") * F.lag("_x", k).over(s.w)).alias(f"_p{k}") for k in range(1, max_lag + 1)]
    products.insert(0, (F.col("_x") * F.col("_x")).alias("_p0"))
    sums = centred.select(*s.keys, *products).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.array(*[F.sum(f"_p{k}") for k in range(max_lag + 1)]).alias("_s")
    )
    m = F.least(F.lit(max_lag), F.floor(F.col("n_obs") / 2).cast("int") - 1)
    usable = (F.col("n_obs") >= max_lag + 2) & (F.col("_m") >= 1)
    head = F.slice("_s", F.lit(1), F.greatest(F.col("_m") + 1, F.lit(1)))
    ratios = F.when(usable, F.transform(head, lambda v: F.try_divide(v, F.col("_s")[0])))
    out = sums.withColumn("_m", m).select(*s.keys, "n_obs", ratios.alias("acf"))
    return out if keep_short else out.where("acf is not null")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda t, v: t + v)


def pacf(df: DataFrame, name: str = "pacf") -> DataFrame:
    """Partial autocorrelations from the ``acf`` array by the Durbin-Levinson recursion."""
    r = F.col("acf")
    first = F.struct(F.array(r[1]).alias("phi"), F.array(F.lit(1.0), r[1]).alias("out"))

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        near = F.slice(r, F.lit(2), k - 1)
        p = F.try_divide(F.get(r, k) - _dot(phi, F.reverse(near)), 1 - _dot(phi, near))
        rest = F.zip_with(phi, F.reverse(phi), lambda a, b: a - p * b)
        return F.struct(F.concat(rest, F.array(p)).alias("phi"), F.concat(state["out"], F.array(p)).alias("out"))

    orders = F.when(F.size(r) > 2, F.sequence(F.lit(2), F.size(r) - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(name, F.aggregate(orders, first, step, lambda st: st["out"]))


def significant_lags(df: DataFrame, threshold: float = 0.2, top_k: int = 5, name: str = "lags") -> DataFrame:
    """Per series: the top lags whose |acf| or |pacf| reaches the threshold; lag 1 joins if there is room."""
    strength = F.zip_with("acf", "pacf", lambda a, p: F.greatest(F.abs(a), F.abs(p)))
    scored = F.transform(strength, lambda v, k: F.struct((-v).alias("w"), k.alias("k")))
    strong = F.sort_array(F.filter(scored, lambda e: (e["k"] >= 1) & (e["w"] <= -threshold)))
    picked = F.transform(F.slice(strong, 1, top_k), lambda e: e["k"])
    # Lag 1 goes to the end; the cut at top_k removes it again when there is no room.
    with_first = F.slice(F.array_distinct(F.concat(picked, F.array(F.lit(1)))), 1, top_k)
    return df.withColumn(name, F.sort_array(with_first))


def lag_votes(df: DataFrame) -> DataFrame:
    """Number of series that picked each lag."""
    return df.select(F.explode("lags").alias("lag")).groupBy("lag").agg(F.count(F.lit(1)).alias("votes"))


def recommended_lags(df: DataFrame, y: str, s: Series = DISTRICT, max_lag: int = 12, threshold: float = 0.2,
                     top_k: int = 5, share: float = 0.4, default: Sequence[int] = DEFAULT_LAGS) -> DataFrame:
    """One row: lags picked by at least ``share`` of all series, else the most frequent, always with lag 1.

    Every series votes, in one pass over the series table with a counter per lag.
    """
    picked = significant_lags(pacf(acf(df, y, s, max_lag, keep_short=True)), threshold, top_k)
    counted = F.array(
        *[F.struct((-F.count_if(F.array_contains("lags", k))).alias("v"), F.lit(k).alias("lag")) for k in range(1, max_lag + 1)]
    )
    ballot = picked.agg(F.count(F.lit(1)).alias("_n"), counted.alias("b"))
    ballot = ballot.withColumn("b", F.sort_array(F.filter("b", lambda e: e["v"] < 0)))
    need = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    common = F.transform(F.filter("b", lambda e: -e["v"] >= F.col("_need")), lambda e: e["lag"])
    most = F.transform(F.slice("b", 1, top_k), lambda e: e["lag"])
    out = ballot.withColumn("_need", need).select("b", F.when(F.size(common) < 3, most).otherwise(common).alias("l"))
    fallback = F.array(*[F.lit(k) for k in default])
    lags = F.when(F.size("b") == 0, fallback).when(F.array_contains("l", 1), F.col("l")).otherwise(F.array_append("l", F.lit(1)))
    return out.select(F.sort_array(lags).alias("lags"))
