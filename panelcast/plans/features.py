"""Composite feature jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import dates as d
from panelcast.operators import series as ts
from panelcast.operators.calendars import add_calendar, calendar_of
from panelcast.operators.groups import add_group_stats, group_stats, ratio_to_peers
from panelcast.operators.series import DISTRICT, Series

SENTINEL = -999.0


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 2, 3, 6)
    windows: tuple[int, ...] = (3, 6)
    phases: Mapping[str, tuple[str, str]] = field(default_factory=lambda: d.POLICY_PHASES)
    campaigns: Sequence[tuple[str, str]] = d.CAMPAIGN_PERIODS
    series: Series = DISTRICT
    pad_before: int = 12
    pad_after: int = 6


def _dates(df: DataFrame, cfg: FeatureConfig, reference: Column) -> DataFrame:
    """Calendar, policy, trend and cycle columns."""
    date = cfg.series.date
    df = add_calendar(df, date, calendar_of(df, date, cfg.pad_before, cfg.pad_after))
    return df.withColumns(
        d.month_cycle(date) | d.policy_flags(date, cfg.phases, cfg.campaigns) | d.time_trend(date, reference)
    )


def monthly_features(df: DataFrame, y: str, cfg: FeatureConfig = FeatureConfig(), start: Column | None = None) -> DataFrame:
    """Baseline feature table: series, calendar, policy, trend and date parts; nothing is left null.

    The trend counts months from ``start``, by default the table's first month; rows scored later
    need the start of the training run.
    """
    out = ts.add_series_features(df, y, cfg.series, cfg.lags, cfg.windows, pct_change=True)
    first = df.agg(F.min(cfg.series.date)).scalar() if start is None else start
    out = _dates(out, cfg, first)
    parts = d.calendar_parts(cfg.series.date)
    return out.withColumns({k: parts[k] for k in ("year", "month", "quarter")})


def sentinel_fill(df: DataFrame, keep: Sequence[str] = (), value: float = SENTINEL) -> DataFrame:
    """Remaining numeric nulls become the sentinel."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    return df.fillna(value, subset=cols)


def fold_features(
    assigned: DataFrame, y: str, cfg: FeatureConfig = FeatureConfig(), history: str = "full"
) -> DataFrame:
    """Features of all folds in one job, filled from statistics of each fold's training rows.

    ``assigned`` carries (fold, role).  ``history="fold"`` computes windows inside a role alone,
    ``"full"`` lets validation rows look back at the training rows of the same fold.  The data is
    replicated once per fold; keep the number of folds small.
    """
    s = cfg.series
    scope = ("fold", "role") if history == "fold" else ("fold",)
    w = Series((*scope, *s.keys), s.date)
    lags = ts.lag_cols(w, y, cfg.lags, fill=False)
    rolls = ts.rolling_cols(w, y, cfg.windows, True, fill=False)
    out = assigned.withColumns({**lags, **rolls, **ts.diff_cols(w, y)})
    train = assigned.where("role = 'train'")
    per_group = group_stats(train, ["fold", *s.keys], y, "_gm", "_gs")
    per_fold = F.broadcast(group_stats(train, ["fold"], y, "_am", "_as"))
    out = out.join(per_group, ["fold", *s.keys], "left").join(per_fold, ["fold"], "left")
    mean, std = F.coalesce("_gm", "_am"), F.coalesce("_gs", "_as")
    fills = {c: F.coalesce(F.col(c), std if c.endswith("_std") else mean) for c in (*lags, *rolls)}
    out = out.withColumns(fills).drop("_gm", "_gs", "_am", "_as")
    first = F.broadcast(assigned.groupBy(*scope).agg(F.min(s.date).alias("_first")))
    out = out.join(first, list(scope), "left")
    parts = d.fiscal_parts(s.date)
    out = _dates(out, cfg, F.col("_first")).drop("_first")
    return out.withColumns({k: parts[k] for k in ("year", "month", "quarter", "financial_year")})


def train_group_features(assigned: DataFrame, y: str, s: Series = DISTRICT, state: str = "state") -> DataFrame:
    """Long-term group statistics, past rolling means and state ratio, all fitted on train rows per fold."""
    w = Series(("fold", "role", *s.keys), s.date)
    train = assigned.where("role = 'train'")
    overall = F.broadcast(group_stats(train, ["fold"], y, "_am", "_as"))
    out = assigned.withColumns({f"rolling_{n}_mean": F.avg(y).over(w.prev(n)) for n in (3, 6)})
    out = add_group_stats(out, group_stats(train, ["fold", *s.keys], y), ["fold", *s.keys])
    out = out.join(train.groupBy("fold", state).agg(F.avg(y).alias("_sm")), ["fold", state], "left")
    out = out.join(overall, ["fold"], "left")
    mean = F.coalesce("group_long_term_mean", "_am")
    peer = F.coalesce("_sm", "_am")
    return out.withColumns(
        {
            "group_long_term_mean": mean,
            "group_long_term_std": F.coalesce("group_long_term_std", "_as"),
            "rolling_3_mean": F.coalesce("rolling_3_mean", mean),
            "rolling_6_mean": F.coalesce("rolling_6_mean", mean),
            "ratio_to_state_mean": F.when(peer > 0, F.col(y) / peer).otherwise(F.lit(1.0)),
        }
    ).drop("_sm", "_am", "_as")


def daily_context_features(df: DataFrame, y: str, s: Series, drop_incomplete: bool = True) -> DataFrame:
    """Weekday, month, weekend, lags 1/7/30 and full 7/30-row means of a daily series."""
    parts = d.calendar_parts(s.date)
    history = ts.lag_cols(s, y, (1, 7, 30), fill=False) | ts.full_rolling_cols(s, y, (7, 30))
    out = df.withColumns(
        {"dow": parts["day_of_week"], "month": parts["month"], "is_weekend": parts["is_weekend"], **history}
    )
    return out.dropna(subset=list(history)) if drop_incomplete else out


def calendar_and_group_features(df: DataFrame, y: str, s: Series = DISTRICT, state: str = "state",
                                fill: bool = False) -> DataFrame:
    """Financial-year calendar, long-term group statistics, rolling means and the state ratio."""
    out = df.withColumns(d.fiscal_parts(s.date))
    out = out.withColumns({f"rolling_{n}_mean": F.avg(y).over(s.prev(n)) for n in (3, 6)})
    out = add_group_stats(out, group_stats(df, s.keys, y), s.keys)
    out = ratio_to_peers(out, y, (state, s.date))
    if fill:
        out = out.withColumns(
            {f"rolling_{n}_mean": F.coalesce(f"rolling_{n}_mean", "group_long_term_mean") for n in (3, 6)}
        )
    return out


def log_context_features(df: DataFrame, y: str, s: Series = DISTRICT) -> DataFrame:
    """Date parts, lags 1/3/6/12, past means, and volume segment; incomplete rows dropped.

    Lags run within the series; a table that is one single series is passed as one key value.
    """
    parts = d.calendar_parts(s.date)
    out = df.withColumns({k: parts[k] for k in ("year", "month", "day", "day_of_week", "quarter")})
    cols = ts.lag_cols(s, y, (1, 3, 6, 12), fill=False)
    cols |= {f"{y}_roll_mean_{n}": F.avg(y).over(s.prev(n)) for n in (3, 6)}
    out = ts.volume_segments(out.withColumns(cols), y, s)
    return out.dropna("any")


