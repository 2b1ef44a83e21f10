"""Past-only outlier handling and gap-aware imputation of keyed series.

Everything inside a series uses windows partitioned by its keys (calendar-bounded, see
``series``).  Means over many series (state, state x month) are grouped aggregates joined back,
so a state with a large share of the districts is combined map-side instead of being sorted
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.series import DISTRICT, Series


@dataclass(frozen=True)
class CleaningConfig:
    outlier_method: Literal["zscore_moving", "iqr", "none"] = "zscore_moving"
    outlier_window: int = 3
    outlier_z_thresh: float = 3.0
    iqr_multiplier: float = 1.5
    outlier_cap_method: Literal["median", "clip_all", "none"] = "median"
    missing_method: Literal["locf", "state_mean", "linear", "none"] = "locf"
    max_locf_gap: int = 3
    series: Series = field(default=DISTRICT)
    state: str = "state"


def zscore_outlier(s: Series, y: str, window: int = 3, z: float = 3.0) -> Column:
    """True where y is more than z past deviations away from the past mean.

    A constant past (deviation 0) never flags, nor does a past of fewer than two values.
    """
    f = s.prev(window)
    enough = F.count(y).over(f) >= max(1, window // 2)
    mean, dev = F.avg(y).over(f), F.stddev_samp(y).over(f)
    far = F.abs(F.try_divide(F.col(y) - mean, dev)) > z
    return F.coalesce(enough & (dev > 0) & far, F.lit(False))


def iqr_outlier(s: Series, y: str, multiplier: float = 1.5, min_history: int = 4) -> Column:
    """True where y leaves the fences of the quartiles of all earlier rows."""
    q = F.expr(f"percentile({y}, array(0.25D, 0.75D))").over(s.past)
    spread = (q[1] - q[0]) * multiplier
    outside = (F.col(y) < q[0] - spread) | (F.col(y) > q[1] + spread)
    return F.coalesce((F.row_number().over(s.w) > min_history) & outside, F.lit(False))


def median_cap(s: Series, y: str, flag: str, window: int = 3) -> Column:
    """Flagged values become the median of the unflagged values in the past window, if there is one."""
    med = F.expr(f"percentile(CASE WHEN NOT {flag} THEN {y} END, 0.5D)").over(s.prev(window))
    return F.when(F.col(flag), F.coalesce(med, F.col(y).cast("double"))).otherwise(F.col(y).cast("double"))


def clip_all(s: Series, y: str, window: int = 3, z: float = 3.0) -> Column:
    """Every value, flagged or not, limited to past mean +- z deviations; no past leaves it as it is."""
    mean = F.avg(y).over(s.prev(window))
    dev = F.coalesce(F.stddev_samp(y).over(s.prev(window)), F.lit(0.0))
    v = F.col(y).cast("double")
    clipped = F.least(F.greatest(v, mean - z * dev), mean + z * dev)
    return F.when(v.isNotNull(), clipped)


def null_run_position(df: DataFrame, y: str, s: Series, name: str = "null_run") -> DataFrame:
    """Position of each null inside its run of nulls; 0 on values.

    The island id is the number of values seen so far.  Both windows are partitioned by the
    series keys first, so they share one exchange.
    """
    island = df.withColumn("_island", F.count(y).over(s.upto))
    run = Series((*s.keys, "_island"), s.date)
    return island.withColumn(name, F.count_if(F.col(y).isNull()).over(run.upto).cast("int")).drop("_island")


def locf(df: DataFrame, y: str, s: Series, max_gap: int, out: str) -> DataFrame:
    """Last value carried forward into the first ``max_gap`` nulls of every run."""
    last = F.last(y, ignorenulls=True).over(s.upto)
    marked = null_run_position(df, y, s, "_run")
    return marked.withColumn(out, F.when(F.col("_run") <= max_gap, last)).drop("_run")


def linear_by_time(df: DataFrame, y: str, s: Series, out: str) -> DataFrame:
    """Straight line between the neighbouring values by days; trailing nulls repeat the last value."""
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(s.date).alias("d"), F.col(y).cast("double").alias("v")))
    ends = df.withColumns(
        {"_p": F.last(known, ignorenulls=True).over(s.upto), "_n": F.last(known, ignorenulls=True).over(s.from_)}
    )
    part = F.datediff(s.date, "_p.d") / F.datediff("_n.d", "_p.d")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * part
    value = (
        F.when(F.col(y).isNotNull(), F.col(y).cast("double"))
        .when(F.col("_p").isNull(), F.lit(None).cast("double"))
        .when(F.col("_n").isNull(), F.col("_p.v"))
        .otherwise(line)
    )
    return ends.withColumn(out, value).drop("_p", "_n")


def peer_mean_fill(
    df: DataFrame, y: str, state: str, date: str, out: str, asof: bool = False
) -> DataFrame:
    """Nulls become the mean of the state in that month, else the mean of the state.

    ``asof`` restricts the state mean to earlier months.
    """
    by_month = df.groupBy(state, date).agg(F.avg(y).alias("_sm"), F.sum(y).alias("_s"), F.count(y).alias("_c"))
    months = Series((state,), date)
    frame = months.past if asof else months.whole
    means = by_month.withColumn(
        "_st", F.try_divide(F.sum("_s").over(frame).cast("double"), F.sum("_c").over(frame))
    ).select(state, date, "_sm", "_st")
    return (
        df.join(means, [state, date], "left")
        .withColumn(out, F.coalesce(F.col(y).cast("double"), "_sm", "_st"))
        .drop("_sm", "_st")
    )


def impute(df: DataFrame, y: str, cfg: CleaningConfig, flag: str) -> DataFrame:
    """Fill nulls of ``y`` in place by the configured method and mark the filled rows."""
    s, value = cfg.series, "_filled"
    if cfg.missing_method == "none":
        return df.withColumn(flag, F.lit(False))
    if cfg.missing_method == "locf":
        df = locf(df, y, s, cfg.max_locf_gap, value)
    elif cfg.missing_method == "linear":
        df = linear_by_time(df, y, s, value)
    else:
        df = df.withColumn(value, F.col(y).cast("double"))
    df = peer_mean_fill(df, value, cfg.state, s.date, "_done")
    return (
        df.withColumn(flag, F.col(y).isNull() & F.col("_done").isNotNull())
        .withColumn(y, F.col("_done"))
        .drop(value, "_done")
    )


def clean_series(df: DataFrame, y: str, cfg: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Detect, cap, impute; keeps the original and the capped value and one flag per step."""
    s = cfg.series
    if cfg.outlier_method == "zscore_moving":
        is_outlier = zscore_outlier(s, y, cfg.outlier_window, cfg.outlier_z_thresh)
    elif cfg.outlier_method == "iqr":
        is_outlier = iqr_outlier(s, y, cfg.iqr_multiplier)
    else:
        is_outlier = F.lit(False)
    df = df.withColumns({f"{y}_original": F.col(y), "_flag": is_outlier})
    if cfg.outlier_cap_method == "median":
        capped = median_cap(s, y, "_flag", cfg.outlier_window)
    elif cfg.outlier_cap_method == "clip_all":
        capped = clip_all(s, y, cfg.outlier_window, cfg.outlier_z_thresh)
    else:
        capped = F.col(y).cast("double")
    df = df.withColumn(f"{y}_after_cap", capped)
    df = df.withColumns(
        {
            "is_outlier_event": F.col("_flag").cast("int"),
            f"{y}_was_capped": F.coalesce(F.col("_flag") & (F.col(y) != F.col(f"{y}_after_cap")), F.lit(False)),
            y: F.col(f"{y}_after_cap"),
        }
    ).drop("_flag")
    return impute(df, y, cfg, f"{y}_was_imputed")


def cleaning_summary(df: DataFrame, y: str) -> DataFrame:
    n = F.count(F.lit(1))
    outliers = F.coalesce(F.sum("is_outlier_event"), F.lit(0))
    imputed = F.count_if(F.col(f"{y}_was_imputed"))

    def pct(part: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(part * 100.0, n), 2), F.lit(0.0))

    return df.agg(
        n.alias("total_rows"),
        outliers.alias("outliers_detected"),
        F.count_if(F.col(f"{y}_was_capped")).alias("outliers_capped"),
        imputed.alias("values_imputed"),
        pct(outliers).alias("outliers_pct"),
        pct(imputed).alias("imputed_pct"),
    )


def missing_summary(df: DataFrame, y: str, s: Series = DISTRICT) -> DataFrame:
    """Per series: rows, nulls, share, longest run of nulls, first and last null month."""
    gap = F.when(F.col(y).isNull(), F.col(s.date))
    return (
        null_run_position(df, y, s, "_run")
        .groupBy(*s.keys)
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count(gap).alias("missing_count"),
            F.round(F.count(gap) * 100.0 / F.count(F.lit(1)), 2).alias("missing_pct"),
            F.max("_run").alias("max_consecutive_gap"),
            F.min(gap).alias("first_missing_date"),
            F.max(gap).alias("last_missing_date"),
        )
    )


def anomaly_flags(
    df: DataFrame, y: str, s: Series = DISTRICT, small: float = 5, z: float = 3.0, window: int = 3
) -> DataFrame:
    """Small denominator, zero volume and spikes against the past window, with a suggested value."""
    mean, dev = F.avg(y).over(s.prev(window)), F.stddev_samp(y).over(s.prev(window))
    far = F.coalesce(F.abs(F.col(y) - mean) > z * dev, F.lit(False))
    return df.withColumns(
        {
            "small_denominator": F.coalesce(F.col(y) < small, F.lit(False)),
            "zero_volume": F.coalesce(F.col(y) == 0, F.lit(False)),
            "spike": far,
            "replacement": F.when(far, mean).otherwise(F.col(y).cast("double")),
        }
    )


def conservative_fixes(
    df: DataFrame, y: str, median: DataFrame, s: Series = DISTRICT, z: float = 3.0, window: int = 3
) -> DataFrame:
    """One logged fix per row: null -> median, beyond z deviations -> bound, lone zero -> past mean.

    ``median`` is a one-row table with column ``median`` (see ``quantiles.exact_quantiles``).
    """
    st = df.agg(F.struct(F.avg(y).alias("m"), F.stddev_samp(y).alias("sd")).alias("g")).scalar()
    before, after = F.lag(y, 1).over(s.w), F.lead(y, 1).over(s.w)
    df = df.withColumns({"_g": st, "_med": median.select("median").scalar()})
    low, high = F.col("_g.m") - z * F.col("_g.sd"), F.col("_g.m") + z * F.col("_g.sd")
    fix = (
        F.when(F.col(y).isNull(), "median_impute")
        .when((F.col(y) == 0) & (before > 0) & (after > 0), "zero_replaced")
        .when((F.col(y) > high) | (F.col(y) < low), "capped_3_std")
    )
    out = df.withColumns({"fix": fix, "_past": F.avg(y).over(s.prev(window))})
    value = (
        F.when(F.col("fix") == "median_impute", F.col("_med"))
        .when(F.col("fix") == "zero_replaced", F.col("_past"))
        .when(F.col("fix") == "capped_3_std", F.least(F.greatest(F.col(y).cast("double"), low), high))
        .otherwise(F.col(y).cast("double"))
    )
    return out.withColumn(f"{y}_fixed", value).drop("_g", "_med", "_past")


def fix_log(fixed: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """The changed rows only: what was changed, from what, to what."""
    return fixed.where("fix is not null").select(
        *keys, "fix", F.col(y).cast("double").alias("old_value"), F.col(f"{y}_fixed").alias("new_value")
    )
