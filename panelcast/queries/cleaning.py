"""Outliers, imputation, anomaly flags and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import cleaning as c
from panelcast.operators import long_series, running
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.series import DISTRICT, Series, densify_months
from panelcast.queries import tables as t
from panelcast.queries.registry import cte, query, rounded
from panelcast.session import cut_lineage

Y = "total_enrolment"
K = ["state", "district", "month_date"]

_PREV3 = "(w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_ZFLAG = f"""coalesce(count({Y}) OVER {_PREV3} >= 1 AND stddev_samp({Y}) OVER {_PREV3} > 0
  AND abs(({Y} - avg({Y}) OVER {_PREV3}) / nullif(stddev_samp({Y}) OVER {_PREV3}, 0)) > 3, false)"""

cte("z_flagged", f"""SELECT state, district, month_date, CAST({Y} AS BIGINT) AS {Y}, {_ZFLAG} AS flag
  FROM gappy_spiky WINDOW w AS (PARTITION BY state, district ORDER BY month_date)""")
cte("z_capped", f"""SELECT *, CASE WHEN flag THEN coalesce(median(CAST(masked AS DOUBLE)) OVER {_PREV3},
    CAST({Y} AS DOUBLE)) ELSE CAST({Y} AS DOUBLE) END AS after_cap
  FROM (SELECT *, CASE WHEN NOT flag THEN {Y} END AS masked FROM z_flagged)
  WINDOW w AS (PARTITION BY state, district ORDER BY month_date)""")
cte("z_locf", """SELECT *, CASE WHEN run <= 3 THEN last_value(after_cap IGNORE NULLS) OVER w END AS filled
  FROM (SELECT *, sum(CASE WHEN after_cap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY state, district, island
      ORDER BY month_date) AS run
    FROM (SELECT *, count(after_cap) OVER (PARTITION BY state, district ORDER BY month_date) AS island FROM z_capped))
  WINDOW w AS (PARTITION BY state, district ORDER BY month_date)""")
cte("z_clean", f"""SELECT state, district, month_date, {Y} AS original, after_cap, CAST(flag AS INTEGER) AS is_outlier_event,
    coalesce(flag AND {Y} <> after_cap, false) AS was_capped,
    coalesce(filled, avg(filled) OVER (PARTITION BY state, month_date), avg(filled) OVER (PARTITION BY state)) AS value
  FROM z_locf""")


@query("outlier_moving_zscore", "W7",
       f"SELECT state, district, month_date, {Y}, flag AS is_outlier FROM z_flagged")
def _zscore(spark: SparkSession, sf: str) -> DataFrame:
    df = t.gappy_spiky(spark, sf)
    return df.select(*K, Y, c.zscore_outlier(DISTRICT, Y).alias("is_outlier"))


@query("outlier_past_iqr", "W8", f"""
SELECT state, district, month_date, CAST({Y} AS BIGINT) AS {Y}, coalesce(rn > 4 AND ({Y} < q1 - 1.5 * (q3 - q1)
  OR {Y} > q3 + 1.5 * (q3 - q1)), false) AS is_outlier
FROM (SELECT *, row_number() OVER w AS rn,
    quantile_cont(CAST({Y} AS DOUBLE), 0.25) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q1,
    quantile_cont(CAST({Y} AS DOUBLE), 0.75) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q3
  FROM spiky WINDOW w AS (PARTITION BY state, district ORDER BY month_date))""")
def _iqr(spark: SparkSession, sf: str) -> DataFrame:
    return t.spiky(spark, sf).select(*K, Y, c.iqr_outlier(DISTRICT, Y).alias("is_outlier"))


@query("past_quartiles_and_medians", "W8 W18", f"""
SELECT state, district, month_date, coalesce(rn > 4 AND ({Y} < q1 - 1.5 * (q3 - q1) OR {Y} > q3 + 1.5 * (q3 - q1)), false) AS is_outlier, R[med] AS running_median
FROM (SELECT *, row_number() OVER w AS rn,
    quantile_cont(CAST({Y} AS DOUBLE), 0.25) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q1,
    quantile_cont(CAST({Y} AS DOUBLE), 0.75) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q3,
    median(CAST({Y} AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS med
  FROM spiky WINDOW w AS (PARTITION BY state, district ORDER BY month_date))""")
def _running(spark: SparkSession, sf: str) -> DataFrame:
    """Running order statistics: the past is kept sorted, not sorted again for every row."""
    rows = running.past_iqr_outliers(t.spiky(spark, sf).select(*K, Y), Y)
    rows = running.running_quantiles(rows, Y, probs=(0.5,), name="_med", upto=True)
    return rounded(rows.select(*K, "is_outlier", F.col("_med")[0].alias("running_median")))


# Events of a type are one series, far longer than the calendar; every run of nulls is two rows or more.
EVENTS = Series(("event_type",), "ts")
_GAPPY = "SELECT event_id, event_type, ts, CASE WHEN event_id % 7 < 4 THEN value END AS v FROM events"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 < 4, F.col("value")).alias("v")
    return t.table(spark, sf, "events").select("event_id", "event_type", "ts", v)


@query("long_series_gaps", "W10 W11 W13", f"""
WITH g AS ({_GAPPY}), r AS (SELECT *, count(v) OVER (w ROWS UNBOUNDED PRECEDING) AS island,
    last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pv, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pt,
    first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
  FROM g WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
n AS (SELECT *, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, island ORDER BY ts) AS INTEGER) AS run FROM r)
SELECT event_id, run AS null_run, R[CASE WHEN run <= 2 THEN pv END] AS locf,
  R[CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((epoch_us(ts) - pt) / CAST(nt - pt AS DOUBLE)) END] AS linear FROM n""")
def _long_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gap position, last value carried forward and straight lines on raw events, whose series go over many partitions."""
    return rounded(long_series.fill_gaps(_events(spark, sf), "v", EVENTS, 2, ties=("event_id",)).select("event_id", "null_run", "locf", "linear"))


@query("long_series_rolling", "W3", f"""
SELECT event_id, R[avg(v) OVER p] AS rolling_6_mean, R[stddev_samp(v) OVER p] AS rolling_6_std
FROM ({_GAPPY}) WINDOW p AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def _long_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling mean and deviation of the past six events of a type."""
    return rounded(long_series.rolling(_events(spark, sf), "v", EVENTS, 6, ties=("event_id",)).select("event_id", "rolling_6_mean", "rolling_6_std"))


@query("outlier_median_cap", "W9", "SELECT state, district, month_date, flag, R[after_cap] AS after_cap FROM z_capped")
def _cap(spark: SparkSession, sf: str) -> DataFrame:
    df = t.gappy_spiky(spark, sf).withColumn("flag", c.zscore_outlier(DISTRICT, Y))
    return rounded(df.select(*K, "flag", c.median_cap(DISTRICT, Y, "flag").alias("after_cap")))


@query("outlier_clip_all", "W9 F11", f"""
SELECT state, district, month_date, R[CASE WHEN {Y} IS NOT NULL THEN
  least(greatest(CAST({Y} AS DOUBLE), m - 3 * sd), m + 3 * sd) END] AS clipped
FROM (SELECT *, avg({Y}) OVER {_PREV3} AS m, coalesce(stddev_samp({Y}) OVER {_PREV3}, 0) AS sd
  FROM gappy_spiky WINDOW w AS (PARTITION BY state, district ORDER BY month_date))""")
def _clip(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.gappy_spiky(spark, sf).select(*K, c.clip_all(DISTRICT, Y).alias("clipped")))


@query("null_runs", "W11", f"""
SELECT state, district, month_date, CAST(sum(CASE WHEN {Y} IS NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY state, district, island ORDER BY month_date) AS INTEGER) AS null_run
FROM (SELECT *, count({Y}) OVER (PARTITION BY state, district ORDER BY month_date) AS island FROM gappy)""")
def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return c.null_run_position(t.gappy(spark, sf), Y, DISTRICT).select(*K, "null_run")


@query("impute_locf_max_gap", "W10 W11", f"""
SELECT state, district, month_date, CASE WHEN run <= 2 THEN last_value({Y} IGNORE NULLS)
  OVER (PARTITION BY state, district ORDER BY month_date) END AS filled
FROM (SELECT *, sum(CASE WHEN {Y} IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY state, district, island ORDER BY month_date) AS run
  FROM (SELECT *, count({Y}) OVER (PARTITION BY state, district ORDER BY month_date) AS island FROM gappy))""")
def _locf(spark: SparkSession, sf: str) -> DataFrame:
    return c.locf(t.gappy(spark, sf), Y, DISTRICT, 2, "filled").select(*K, "filled")


@query("impute_state_mean", "W12 J10", f"""
SELECT state, district, month_date, R[coalesce({Y}, avg({Y}) OVER (PARTITION BY state, month_date),
  avg({Y}) OVER (PARTITION BY state))] AS filled FROM gappy""")
def _state_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.peer_mean_fill(t.gappy(spark, sf), Y, "state", "month_date", "filled").select(*K, "filled"))


@query("impute_state_mean_asof", "W12", f"""
SELECT g.state, g.district, g.month_date, R[coalesce({Y}, avg({Y}) OVER (PARTITION BY g.state, g.month_date), p.m)] AS filled
FROM gappy g LEFT JOIN (
  SELECT state, month_date, sum(s) OVER w / nullif(sum(c) OVER w, 0) AS m
  FROM (SELECT state, month_date, CAST(sum({Y}) AS DOUBLE) AS s, count({Y}) AS c FROM gappy GROUP BY ALL)
  WINDOW w AS (PARTITION BY state ORDER BY month_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) p
ON g.state = p.state AND g.month_date = p.month_date""")
def _state_mean_asof(spark: SparkSession, sf: str) -> DataFrame:
    df = c.peer_mean_fill(t.gappy(spark, sf), Y, "state", "month_date", "filled", asof=True)
    return rounded(df.select(*K, "filled"))


@query("impute_linear_time", "W13", f"""
SELECT state, district, month_date, R[CASE WHEN {Y} IS NOT NULL THEN {Y} WHEN p IS NULL THEN NULL
  WHEN n IS NULL THEN p.v ELSE p.v + (n.v - p.v) * (month_date - p.d) / (n.d - p.d) END] AS filled
FROM (SELECT *, last_value(k IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(k IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM (SELECT *, CASE WHEN {Y} IS NOT NULL THEN {{'d': month_date, 'v': CAST({Y} AS DOUBLE)}} END AS k FROM gappy)
  WINDOW w AS (PARTITION BY state, district ORDER BY month_date))""")
def _linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.linear_by_time(t.gappy(spark, sf), Y, DISTRICT, "filled").select(*K, "filled"))


@query("clean_series_default", "C1 W7 W9 W10 W12", f"""
SELECT state, district, month_date, CAST(original AS BIGINT) AS {Y}_original, R[after_cap] AS {Y}_after_cap,
  is_outlier_event, was_capped AS {Y}_was_capped, R[value] AS {Y},
  after_cap IS NULL AND value IS NOT NULL AS {Y}_was_imputed FROM z_clean""")
def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.clean_series(t.gappy_spiky(spark, sf), Y))


@query("clean_series_iqr_clip_linear", "C1 W8 W9 W13 W12", f"""
WITH flagged AS (
  SELECT *, coalesce(rn > 4 AND ({Y} < q1 - 1.5 * (q3 - q1) OR {Y} > q3 + 1.5 * (q3 - q1)), false) AS flag,
    CASE WHEN {Y} IS NOT NULL THEN least(greatest(CAST({Y} AS DOUBLE), m - 3 * sd), m + 3 * sd) END AS after_cap
  FROM (SELECT *, row_number() OVER w AS rn,
      quantile_cont(CAST({Y} AS DOUBLE), 0.25) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q1,
      quantile_cont(CAST({Y} AS DOUBLE), 0.75) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q3,
      avg({Y}) OVER {_PREV3} AS m, coalesce(stddev_samp({Y}) OVER {_PREV3}, 0) AS sd
    FROM gappy_spiky WINDOW w AS (PARTITION BY state, district ORDER BY month_date))),
knots AS (
  SELECT *, last_value(k IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(k IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM (SELECT *, CASE WHEN after_cap IS NOT NULL THEN {{'d': month_date, 'v': after_cap}} END AS k FROM flagged)
  WINDOW w AS (PARTITION BY state, district ORDER BY month_date)),
lines AS (
  SELECT *, CASE WHEN after_cap IS NOT NULL THEN after_cap WHEN p IS NULL THEN NULL WHEN n IS NULL THEN p.v
    ELSE p.v + (n.v - p.v) * (month_date - p.d) / (n.d - p.d) END AS filled FROM knots),
done AS (
  SELECT *, coalesce(filled, avg(filled) OVER (PARTITION BY state, month_date), avg(filled) OVER (PARTITION BY state))
    AS value FROM lines)
SELECT state, district, month_date, CAST({Y} AS BIGINT) AS {Y}_original, R[after_cap] AS {Y}_after_cap,
  CAST(flag AS INTEGER) AS is_outlier_event, coalesce(flag AND {Y} <> after_cap, false) AS {Y}_was_capped,
  R[value] AS {Y}, after_cap IS NULL AND value IS NOT NULL AS {Y}_was_imputed FROM done""")
def _clean_iqr(spark: SparkSession, sf: str) -> DataFrame:
    cfg = c.CleaningConfig(outlier_method="iqr", outlier_cap_method="clip_all", missing_method="linear")
    return rounded(c.clean_series(t.gappy_spiky(spark, sf), Y, cfg))


@query("cleaning_summary", "A8", """
SELECT count(*) AS total_rows, CAST(sum(is_outlier_event) AS BIGINT) AS outliers_detected,
  CAST(count_if(was_capped) AS BIGINT) AS outliers_capped,
  CAST(count_if(after_cap IS NULL AND value IS NOT NULL) AS BIGINT) AS values_imputed,
  round(sum(is_outlier_event) * 100e0 / count(*), 2) AS outliers_pct,
  round(count_if(after_cap IS NULL AND value IS NOT NULL) * 100e0 / count(*), 2) AS imputed_pct FROM z_clean""")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return c.cleaning_summary(c.clean_series(t.gappy_spiky(spark, sf), Y), Y)


@query("missing_summary", "A7 W11", f"""
SELECT state, district, count(*) AS total_rows, CAST(count(*) - count({Y}) AS BIGINT) AS missing_count,
  round((count(*) - count({Y})) * 100e0 / count(*), 2) AS missing_pct, max(run) AS max_consecutive_gap,
  min(CASE WHEN {Y} IS NULL THEN month_date END) AS first_missing_date,
  max(CASE WHEN {Y} IS NULL THEN month_date END) AS last_missing_date
FROM (SELECT *, CAST(sum(CASE WHEN {Y} IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY state, district, island ORDER BY month_date) AS INTEGER) AS run
  FROM (SELECT *, count({Y}) OVER (PARTITION BY state, district ORDER BY month_date) AS island FROM gappy))
GROUP BY state, district""")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    return c.missing_summary(t.gappy(spark, sf), Y)


@query("densified_months", "W20", "SELECT state, district, month_date, total_enrolment FROM gappy")
def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return densify_months(cut_lineage(t.enrol_panel(spark, sf, True)), ["state", "district"])


@query("anomaly_flags", "P26", f"""
SELECT state, district, month_date, {Y}, {Y} < 5 AS small_denominator, {Y} = 0 AS zero_volume, far AS spike,
  R[CASE WHEN far THEN m ELSE {Y} END] AS replacement
FROM (SELECT *, coalesce(abs({Y} - m) > 3 * sd, false) AS far
  FROM (SELECT *, avg({Y}) OVER {_PREV3} AS m, stddev_samp({Y}) OVER {_PREV3} AS sd
    FROM panel_s WINDOW w AS (PARTITION BY state, district ORDER BY month_date)))""")
def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    df = t.enrol_panel(spark, sf, True)
    return rounded(c.anomaly_flags(df, Y))


@query("conservative_fix_log", "P27", f"""
WITH g AS (SELECT avg({Y}) AS m, stddev_samp({Y}) AS sd, median(CAST({Y} AS DOUBLE)) AS med FROM gappy_spiky),
f AS (
  SELECT s.*, g.*, avg({Y}) OVER {_PREV3} AS past, CASE WHEN {Y} IS NULL THEN 'median_impute'
    WHEN {Y} = 0 AND lag({Y}) OVER w > 0 AND lead({Y}) OVER w > 0 THEN 'zero_replaced'
    WHEN {Y} > m + 3 * sd OR {Y} < m - 3 * sd THEN 'capped_3_std' END AS fix
  FROM gappy_spiky s, g WINDOW w AS (PARTITION BY state, district ORDER BY month_date))
SELECT state, district, month_date, fix, CAST({Y} AS DOUBLE) AS old_value, R[CASE fix WHEN 'median_impute' THEN med
  WHEN 'zero_replaced' THEN past ELSE least(greatest({Y}, m - 3 * sd), m + 3 * sd) END] AS new_value
FROM f WHERE fix IS NOT NULL""")
def _fixes(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.gappy_spiky(spark, sf))
    fixed = c.conservative_fixes(df, Y, exact_quantiles(df, Y, {"median": 0.5}))
    return rounded(c.fix_log(fixed, K, Y))
