"""Drift statistics and flags, alerts, and the decisions drawn from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.quantiles import exact_quantiles


def period(date: str, freq: Literal["M", "W"] = "M") -> Column:
    """``2025-01`` for months, ``2025-01-06/2025-01-12`` (Monday to Sunday) for weeks."""
    if freq == "M":
        return F.date_format(date, "yyyy-MM")
    monday = F.trunc(date, "week")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def drift_stats(df: DataFrame, date: str, features: Sequence[str], freq: Literal["M", "W"] = "M") -> DataFrame:
    """Mean, sample deviation and count per period and feature; undefined ones are 0.

    One wide aggregate over the raw rows, reshaped to long afterwards: unpivoting first would
    multiply the rows by the number of features.
    """
    if not features:
        raise ValueError("no features to monitor")
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
            F.count(c).alias("count"),
        )
        for c in features
    ]
    wide = df.groupBy(period(date, freq).alias("period")).agg(F.array(*aggs).alias("_s"))
    return wide.select("period", F.explode("_s").alias("_s")).select("period", "_s.*")


def drift_flags(stats: DataFrame, reference_periods: int = 3, threshold_pct: float = 30.0) -> DataFrame:
    """Relative change of every period against the mean of the feature's first periods."""
    first = Window.partitionBy("feature").orderBy("period")
    every = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = stats.withColumn("_r", F.row_number().over(first))
    ref = F.avg(F.when(F.col("_r") <= reference_periods, F.col("mean"))).over(every)
    out = ranked.withColumn("ref_mean", ref)
    change = F.when(F.col("ref_mean") != 0, (F.col("mean") - F.col("ref_mean")) / F.abs("ref_mean") * 100).otherwise(
        F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    )
    out = out.withColumn("rel_change_pct", change)
    return out.select(
        "period", "feature", "mean", "ref_mean", "rel_change_pct",
        (F.abs("rel_change_pct") > threshold_pct).alias("drift_flag"),
    )


def drift_summary(report: DataFrame) -> DataFrame:
    """Features, periods, flags, drifting features, and flags in the latest period.

    The report has one row per feature and period, so the unpartitioned window stays small.
    """
    marked = report.withColumn("_latest", F.col("period") == F.max("period").over(Window.partitionBy()))
    return marked.agg(
        F.count_distinct("feature").alias("n_features_monitored"),
        F.count_distinct("period").alias("n_periods"),
        F.count_if("drift_flag").alias("total_drift_flags"),
        F.count_distinct(F.when(F.col("drift_flag"), F.col("feature"))).alias("features_with_drift"),
        F.count_if(F.col("drift_flag") & F.col("_latest")).alias("latest_period_flags"),
    )


@dataclass(frozen=True)
class AlertConfig:
    high_load_percentile: float = 90.0
    high_load_growth: float = 0.20
    underperform_percentile: float = 70.0
    underperform_rel_error: float = 0.30
    epsilon: float = 1e-6


def alerts(df: DataFrame, keys: Sequence[str], y: str | None = "y", p: str = "yhat", lag: str | None = "yhat2",
           cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """High-load and under-performing rows against exact global percentiles of the forecast."""
    cuts = exact_quantiles(df, p, {"load": cfg.high_load_percentile / 100, "under": cfg.underperform_percentile / 100})
    df = df.withColumn("_c", cuts.select(F.struct("load", "under")).scalar())
    growth = (F.col(p) - F.col(lag)) / (F.col(lag) + cfg.epsilon) if lag else F.lit(0.0)
    out = df.withColumn("growth_rate", growth)
    high = (F.col(p) >= F.col("_c.load")) & (F.col("growth_rate") > cfg.high_load_growth)
    shown = [*keys, p]
    under = F.lit(False)
    if y is not None:
        out = out.withColumn("abs_error", F.abs(F.col(y) - F.col(p)))
        out = out.withColumn("rel_error", F.col("abs_error") / (F.col(y) + cfg.epsilon))
        under = (F.col(p) >= F.col("_c.under")) & (F.col(y) < F.col(p)) & (F.col("rel_error") > cfg.underperform_rel_error)
        shown += [y, "abs_error", "rel_error"]
    out = out.withColumns(
        {
            "high_load_alert": F.coalesce(high, F.lit(False)).cast("int"),
            "underperforming_alert": F.coalesce(under, F.lit(False)).cast("int"),
        }
    )
    h, u = F.col("high_load_alert") == 1, F.col("underperforming_alert") == 1
    kind = F.when(h & u, "both").when(h, "high_load").when(u, "underperforming").otherwise("none")
    return out.withColumn("alert_type", kind).select(
        *shown, "growth_rate", "high_load_alert", "underperforming_alert", "alert_type"
    )


@dataclass(frozen=True)
class RetrainConfig:
    r2_min: float = 0.5
    mae_degradation_pct: float = 10.0
    drift_count: int = 3


def retrain_decision(current: DataFrame, baseline: DataFrame, drift: DataFrame,
                     cfg: RetrainConfig = RetrainConfig()) -> DataFrame:
    """One row: whether to retrain and the reasons, from three one-row tables."""
    base = baseline.select("mae").scalar()
    n_drift = drift.select("features_with_drift").scalar()
    row = current.select("mae", "r2").withColumns({"_b": base, "_d": n_drift})
    worse = F.when(F.col("_b") > 0, (F.col("mae") - F.col("_b")) / F.col("_b") * 100)
    row = row.withColumn("mae_increase_pct", worse)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("r2") < cfg.r2_min, F.lit("r2_below_minimum")),
            F.when(F.col("mae_increase_pct") > cfg.mae_degradation_pct, F.lit("mae_increased")),
            F.when(F.col("_d") >= cfg.drift_count, F.lit("features_drifting")),
        )
    )
    return row.select(
        "mae", "r2", "mae_increase_pct", F.col("_d").alias("features_with_drift"), reasons.alias("reasons"),
        (F.size(reasons) > 0).alias("retrain"),
    )


@dataclass(frozen=True)
class PromotionConfig:
    min_mae_gain_pct: float = 2.0
    max_r2_drop: float = 0.01
    max_mape_factor: float = 1.05


def promotion_gate(champion: DataFrame, challenger: DataFrame, cfg: PromotionConfig = PromotionConfig()) -> DataFrame:
    """Challenger against champion per scope (e.g. overall, weak): gain, failed rules, verdict.

    Both inputs are metric tables with columns scope, mae, r2, mape.
    """
    a = champion.select("scope", *[F.col(c).alias(f"champion_{c}") for c in ("mae", "r2", "mape")])
    b = challenger.select("scope", *[F.col(c).alias(f"challenger_{c}") for c in ("mae", "r2", "mape")])
    j = a.join(b, "scope")
    gain = F.try_divide((F.col("champion_mae") - F.col("challenger_mae")) * 100, F.col("champion_mae"))
    j = j.withColumn("mae_gain_pct", gain)
    failed = F.array_compact(
        F.array(
            F.when(F.col("mae_gain_pct") >= cfg.min_mae_gain_pct, None).otherwise("mae_gain_too_small"),
            F.when(F.col("champion_r2") - F.col("challenger_r2") <= cfg.max_r2_drop, None).otherwise("r2_drop"),
            F.when(F.col("challenger_mape") <= cfg.max_mape_factor * F.col("champion_mape"), None).otherwise("mape_worse"),
        )
    )
    return j.withColumns({"failed": failed, "promote": F.size(failed) == 0})


def segment_regressions(champion: DataFrame, challenger: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Segments whose MAPE is worse by more than the tolerance (kind, segment, mape in both tables)."""
    a = champion.select("kind", "segment", F.col("mape").alias("champion_mape"))
    b = challenger.select("kind", "segment", F.col("mape").alias("challenger_mape"))
    j = a.join(b, ["kind", "segment"]).withColumn("mape_delta", F.col("challenger_mape") - F.col("champion_mape"))
    return j.where(F.col("mape_delta") > tolerance)


def new_regressions(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """Regressed segments that were not regressed before."""
    return current.join(earlier.select("kind", "segment"), ["kind", "segment"], "left_anti")


def compare_metrics(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Two runs side by side: metrics table (run, metric, value, higher_is_better) -> delta, better, improvement."""
    a = metrics.where(F.col("run") == base).select("metric", "higher_is_better", F.col("value").alias("base_value"))
    b = metrics.where(F.col("run") == other).select("metric", F.col("value").alias("other_value"))
    j = a.join(b, "metric").withColumn("delta", F.col("other_value") - F.col("base_value"))
    gain = F.when(F.col("higher_is_better"), F.col("delta")).otherwise(-F.col("delta"))
    pct = F.try_divide(gain * 100, F.abs("base_value"))
    return j.withColumns({"better": F.when(gain > 0, other).when(gain < 0, base).otherwise("tie"), "improvement_pct": pct})
