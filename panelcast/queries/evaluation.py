"""Prediction accuracy, monitoring, gates and blending on model-free forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import blend as b
from panelcast.operators import evaluate as e
from panelcast.operators import monitor as m
from panelcast.operators import series as ts
from panelcast.queries import tables as t
from panelcast.queries.registry import cte, joined, query, rounded
from panelcast.session import cut_lineage

K = ["state", "district", "month_date"]


def _metrics_sql(y: str = "y", p: str = "yhat", mape: str | None = None) -> str:
    pct = mape or f"avg(CASE WHEN {y} <> 0 THEN abs({y} - {p}) / abs({y}) END) * 100"
    return f"""R[avg(abs({y} - {p}))] AS mae, R[sqrt(avg(({y} - {p}) * ({y} - {p})))] AS rmse,
  R[1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))] AS r2, R[{pct}] AS mape, count(*) AS n_samples"""


@query("overall_metrics", "E1", f"SELECT {_metrics_sql()} FROM forecast_s")
def _overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.metrics_by(t.forecast(spark, sf, True), []))


@query("mape_variants", "E1", f"""SELECT 'epsilon' AS variant, {_metrics_sql(mape="avg(CASE WHEN abs(y) > 1e-6 THEN abs(y - yhat) / abs(y) END) * 100")}
  FROM forecast_s UNION ALL SELECT 'plus_one', {_metrics_sql(mape="avg(abs(y - yhat) / (y + 1)) * 100")} FROM forecast_s""")
def _variants(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    parts = [e.metrics_by(df, [], variant=v).select(F.lit(v).alias("variant"), "*") for v in ("epsilon", "plus_one")]
    return rounded(parts[0].unionByName(parts[1]))


@query("metrics_by_state", "E1 A9", f"SELECT state, {_metrics_sql()} FROM forecast_s GROUP BY state")
def _by_state(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.metrics_by(t.forecast(spark, sf, True), ["state"]))


@query("group_accuracy", "A9 A14", """SELECT month_date, R[avg(abs(y - yhat))] AS mae, R[CASE WHEN count(*) < 2 THEN 0
  ELSE 1 - sum((y - yhat) * (y - yhat)) / nullif(var_pop(y) * count(*), 0) END] AS r2, R[avg(y)] AS mean_actual,
  count(DISTINCT district) AS n_units, count(*) AS n_rows FROM forecast_s GROUP BY month_date""")
def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.group_accuracy(t.forecast(spark, sf, True), ["month_date"]))


_SAFETY = """SELECT *, mae <= 1.05 * (SELECT avg(abs(y - yhat)) FROM forecast_s) AND mape <= 60 AS pass_flag FROM (
  SELECT state, district, avg(abs(y - yhat)) AS mae, avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100 AS mape,
    sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM forecast_s GROUP BY ALL)"""


@query("safety_report", "E2", f"SELECT state, district, R[mae] AS mae, R[mape] AS mape, R[rmse] AS rmse, pass_flag FROM ({_SAFETY})")
def _safety(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.safety_report(t.forecast_table(spark, sf, True), K[:2], factor=1.05, mape_limit=60))


@query("safety_summary", "E2", f"""SELECT R[(SELECT avg(abs(y - yhat)) FROM forecast_s)] AS global_mae,
  R[(SELECT avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100 FROM forecast_s)] AS global_mape,
  R[count_if(pass_flag) * 100e0 / count(*)] AS safety_pct, count(*) AS n_groups, CAST(count_if(pass_flag) AS BIGINT) AS n_passing
  FROM ({_SAFETY})""")
def _safety_sum(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    return rounded(e.safety_summary(df, e.safety_report(df, K[:2], factor=1.05, mape_limit=60)))


@query("residual_stats", "A11 E11", """SELECT district, R[avg(y - yhat)] AS mean_residual, R[stddev_samp(y - yhat)] AS std_residual,
  R[max(abs(y - yhat))] AS max_abs_residual FROM forecast GROUP BY district""")
def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.residual_stats(t.forecast(spark, sf), ["district"]))


def _bins(value: str, source: str, by: str, bins: int) -> str:
    keys = f"{by}, " if by else ""
    over = f"(PARTITION BY {by})" if by else "()"
    return f"""SELECT {keys}CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin,
  R[any_value(lo) + any_value(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})) * ((any_value(hi) - any_value(lo)) / {bins})] AS bin_start,
  count(*) AS n FROM (SELECT {keys}{value} AS v, min({value}) OVER {over} AS lo, max({value}) OVER {over} AS hi FROM {source}
  WHERE {value} IS NOT NULL) GROUP BY ALL"""


@query("residual_histogram", "A12 E11", f"SELECT bin, bin_start, n FROM ({_bins('(y - yhat)', 'forecast_s', '', 30)})")
def _hist(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True).withColumn("residual", F.col("y") - F.col("yhat"))
    return rounded(e.histogram(df, "residual", 30))


@query("price_histogram_by_flag", "A12", _bins("l_extendedprice", "lineitem", "l_returnflag", 25))
def _hist_by(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.histogram(t.table(spark, sf, "lineitem"), "l_extendedprice", 25, ["l_returnflag"], few_keys=True))


@query("box_stats_by_calendar_month", "A13", """
WITH q AS (SELECT month(month_date) AS m, quantile_cont(y - yhat, 0.25) AS q1, quantile_cont(y - yhat, 0.5) AS median, quantile_cont(y - yhat, 0.75) AS q3
  FROM forecast_s GROUP BY ALL)
SELECT CAST(m AS INTEGER) AS month, R[q1] AS q1, R[median] AS median, R[q3] AS q3,
  min(CASE WHEN y - yhat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN R[y - yhat] END) AS whisker_low,
  max(CASE WHEN y - yhat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN R[y - yhat] END) AS whisker_high,
  CAST(count_if(NOT y - yhat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM forecast_s JOIN q ON month(month_date) = m GROUP BY m, q1, median, q3""")
def _box(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True).select(F.month("month_date").alias("month"), (F.col("y") - F.col("yhat")).alias("residual"))
    return rounded(e.box_stats(df, "residual", ["month"], few_keys=True))


_BUCKET = "CASE WHEN y < 100 THEN '<100' WHEN y < 500 THEN '100-500' WHEN y < 2000 THEN '500-2K' WHEN y < 10000 THEN '2K-10K' ELSE '10K+' END"
_ERR = """avg(abs(y - {p})) AS mae, avg(CASE WHEN y <> 0 THEN abs(y - {p}) / abs(y) END) * 100 AS mape, count(*) AS n,
  avg(y) AS mean_actual, avg({p}) AS mean_predicted, avg({p} - y) AS bias"""
for _name, _p in (("errors_a", "yhat"), ("errors_b", "yhat2")):
    cte(_name, f"""SELECT 'state' AS kind, state AS segment, {_ERR.format(p=_p)} FROM forecast_s GROUP BY state
  UNION ALL SELECT 'month', strftime(month_date, '%Y-%m'), {_ERR.format(p=_p)} FROM forecast_s GROUP BY ALL
  UNION ALL SELECT 'bucket', {_BUCKET}, {_ERR.format(p=_p)} FROM forecast_s GROUP BY ALL""")


@query("error_tables", "A15 W23", """SELECT kind, segment, R[mae] AS mae, R[mape] AS mape, n, R[mean_actual] AS mean_actual,
  R[mean_predicted] AS mean_predicted, R[bias] AS bias FROM errors_a""")
def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.error_tables(t.forecast(spark, sf, True)))


@query("weak_segments", "A16 U4", """
SELECT kind, segment, 'high_error' AS reason, CAST(NULL AS DOUBLE) AS value FROM (
  (SELECT kind, segment FROM errors_a WHERE kind = 'state' ORDER BY mae DESC, segment LIMIT 2) UNION
  (SELECT kind, segment FROM errors_a WHERE kind = 'state' ORDER BY mape DESC, segment LIMIT 2))
UNION ALL SELECT 'month', segment, 'under_predicted', R[v] FROM (SELECT strftime(month_date, '%Y-%m') AS segment,
  median((yhat - y) / y) AS v FROM forecast_s GROUP BY ALL) WHERE v < 0
UNION ALL SELECT kind, segment, 'bias', R[bias] FROM errors_a WHERE kind = 'bucket'""")
def _weak(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    return rounded(e.weak_segments(df, e.error_tables(df), 2))


@query("residual_trend", "A22", "SELECT state, R[regr_slope(y - yhat, yhat)] AS slope, R[regr_intercept(y - yhat, yhat)] AS intercept FROM forecast_s GROUP BY state")
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.residual_trend(t.forecast(spark, sf, True), by=["state"]))


@query("model_comparison_rows", "J11 J4", """SELECT state, district, month_date, y, R[yhat] AS yhat, yhat2, R[y - yhat] AS error_a,
  R[y - yhat2] AS error_b, CASE WHEN abs(y - yhat) < abs(y - yhat2) THEN 'a' WHEN abs(y - yhat2) < abs(y - yhat) THEN 'b'
  ELSE 'tie' END AS closer FROM forecast_s""")
def _compare(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    joined = e.with_predictions(df.select(*K, "y", "yhat"), df.select(*K, "yhat2"), K)
    return rounded(e.compare_models(joined, K, "y", "yhat", "yhat2"))


@query("naive_baseline", "M6 E10", """SELECT R[a] AS model_mae, R[b] AS naive_mae, n, R[(b - a) * 100 / b] AS improvement_pct,
  a < b AS model_wins FROM (SELECT avg(abs(y - yhat)) AS a, avg(abs(y - yhat2)) AS b, count(*) AS n FROM forecast_s WHERE yhat2 IS NOT NULL)""")
def _naive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.baseline_comparison(t.forecast(spark, sf, True)))


@query("rank_picks", "W21 P20", """SELECT state, district, R[mean_value] AS mean_value, n, CAST(i AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (ORDER BY mean_value, state, district) - 1 AS i, count(*) OVER () AS c FROM (
    SELECT state, district, avg(y) AS mean_value, count(y) AS n FROM forecast_s GROUP BY ALL HAVING count(y) >= 6))
  WHERE i IN (0, floor(c / 3), floor(c * 2 / 3), c - 1)""")
def _picks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.rank_picks(t.forecast(spark, sf, True), K[:2], "y"))


cte("series_means", "SELECT state, district, avg(y) AS mean_value, count(y) AS n FROM forecast_s GROUP BY ALL HAVING count(y) >= 6")


@query("mean_quantile_buckets", "W22", """
SELECT bucket, CAST(count(*) AS BIGINT) AS n_groups, R[min(mean_value)] AS low, R[max(mean_value)] AS high FROM (
  SELECT *, CASE WHEN mean_value <= (SELECT quantile_cont(mean_value, 1/3::DOUBLE) FROM series_means) THEN 'low'
    WHEN mean_value <= (SELECT quantile_cont(mean_value, 2/3::DOUBLE) FROM series_means) THEN 'medium' ELSE 'high' END AS bucket
  FROM series_means) GROUP BY bucket""")
def _quantile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    df = e.mean_quantile_buckets(t.forecast_table(spark, sf, True), K[:2], "y", picks=2**31 - 1)
    return rounded(df.groupBy("bucket").agg(F.count("*").alias("n_groups"), F.min("mean_value").alias("low"), F.max("mean_value").alias("high")))


@query("bucket_sample_series", "W22", """
SELECT state, district, R[mean_value] AS mean_value, n, bucket, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(state || '|' || district), state, district) AS rank FROM (
    SELECT s.*, CASE WHEN mean_value <= e1 THEN 'q1' WHEN mean_value <= e2 THEN 'q2' WHEN mean_value <= e3 THEN 'q3' ELSE 'q4' END AS bucket
    FROM series_means s, (SELECT quantile_cont(mean_value, 0.25) AS e1, quantile_cont(mean_value, 0.5) AS e2,
      quantile_cont(mean_value, 0.75) AS e3 FROM series_means))) WHERE rank <= 2""")
def _bucket_picks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.mean_quantile_buckets(t.forecast_table(spark, sf, True), K[:2], "y", ("q1", "q2", "q3", "q4"), picks=2))


@query("national_error_band", "W15 A4", """
SELECT *, R[greatest(0, yhat - 1.28 * rolling_mae)] AS lower, R[yhat + 1.28 * rolling_mae] AS upper FROM (
  SELECT month_date, y, R[p] AS yhat, R[avg(abs(y - p)) OVER (ORDER BY month_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)] AS rolling_mae
  FROM (SELECT month_date, sum(y) AS y, sum(yhat) AS p FROM forecast GROUP BY month_date))""")
def _band(spark: SparkSession, sf: str) -> DataFrame:
    sums = t.forecast(spark, sf).groupBy("month_date").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
    out = rounded(ts.error_band(sums, "month_date", "y", "yhat"))
    z = 1.28 * F.col("rolling_mae")
    return rounded(out.withColumns({"lower": F.greatest(F.lit(0.0), F.col("yhat") - z), "upper": F.col("yhat") + z}))


# Monitoring -----------------------------------------------------------------------------------

_DRIFT = "total_enrolment total_demo total_bio".split()
cte("drift_stats", " UNION ALL ".join(f"""SELECT strftime(month_date, '%Y-%m') AS period, '{c}' AS feature, coalesce(avg({c}), 0) AS mean,
  coalesce(stddev_samp({c}), 0) AS std, count({c}) AS count FROM panel GROUP BY ALL""" for c in _DRIFT))
cte("drift_report", """SELECT period, feature, mean, ref_mean, rel, abs(rel) > 30 AS drift_flag FROM (
  SELECT *, CASE WHEN ref_mean <> 0 THEN (mean - ref_mean) / abs(ref_mean) * 100 WHEN mean = 0 THEN 0 ELSE 'inf'::DOUBLE END AS rel FROM (
    SELECT *, avg(CASE WHEN r <= 3 THEN mean END) OVER (PARTITION BY feature) AS ref_mean FROM (
      SELECT *, row_number() OVER (PARTITION BY feature ORDER BY period) AS r FROM drift_stats)))""")


@query("drift_stats_monthly", "E3", "SELECT period, feature, R[mean] AS mean, R[std] AS std, count FROM drift_stats")
def _drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.drift_stats(t.panel(spark, sf), "month_date", _DRIFT))


@query("drift_stats_weekly", "E3", """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS period,
  'value' AS feature, R[avg(value)] AS mean, R[coalesce(stddev_samp(value), 0)] AS std, count(value) AS count FROM events GROUP BY ALL""")
def _weekly(spark: SparkSession, sf: str) -> DataFrame:
    ev = t.table(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    return rounded(m.drift_stats(ev, "day", ["value"], "W"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return m.drift_flags(m.drift_stats(t.panel(spark, sf), "month_date", _DRIFT))


@query("drift_flags", "E4 W19", "SELECT period, feature, R[mean] AS mean, R[ref_mean] AS ref_mean, R[rel] AS rel_change_pct, drift_flag FROM drift_report")
def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_report(spark, sf))


@query("drift_summary", "E5", """SELECT count(DISTINCT feature) AS n_features_monitored, count(DISTINCT period) AS n_periods,
  CAST(count_if(drift_flag) AS BIGINT) AS total_drift_flags,
  count(DISTINCT CASE WHEN drift_flag THEN feature END) AS features_with_drift,
  CAST(count_if(drift_flag AND period = (SELECT max(period) FROM drift_report)) AS BIGINT) AS latest_period_flags FROM drift_report""")
def _drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return m.drift_summary(_report(spark, sf))


_ALERTS = """SELECT state, district, month_date, yhat, y, abs(y - yhat) AS abs_error, abs(y - yhat) / (y + 1e-6) AS rel_error, growth_rate, h AS high_load_alert,
  u AS underperforming_alert, CASE WHEN h = 1 AND u = 1 THEN 'both' WHEN h = 1 THEN 'high_load' WHEN u = 1 THEN 'underperforming' ELSE 'none' END AS alert_type
FROM (SELECT *, CAST(coalesce(yhat >= p90 AND growth_rate > 0.2, false) AS INTEGER) AS h,
    CAST(yhat >= p70 AND y < yhat AND abs(y - yhat) / (y + 1e-6) > 0.3 AS INTEGER) AS u
  FROM (SELECT *, (yhat - yhat2) / (yhat2 + 1e-6) AS growth_rate FROM forecast_s),
    (SELECT quantile_cont(yhat, 0.9) AS p90, quantile_cont(yhat, 0.7) AS p70 FROM forecast_s))"""


@query("alerts", "E6", f"""SELECT state, district, month_date, R[yhat] AS yhat, y, R[abs_error] AS abs_error, R[rel_error] AS rel_error,
  R[growth_rate] AS growth_rate, high_load_alert, underperforming_alert, alert_type FROM ({_ALERTS})""")
def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.alerts(t.forecast_table(spark, sf, True), K))


@query("alert_type_counts", "A28 E6", f"SELECT alert_type, count(*) AS n, R[count(*) * 100e0 / (SELECT count(*) FROM forecast_s)] AS pct FROM ({_ALERTS}) GROUP BY alert_type")
def _alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.value_counts(m.alerts(t.forecast_table(spark, sf, True), K), "alert_type"))


@query("retrain_decision", "E7", """
SELECT R[mae] AS mae, R[r2] AS r2, R[inc] AS mae_increase_pct, d AS features_with_drift,
  array_to_string(list_filter([CASE WHEN r2 < 0.5 THEN 'r2_below_minimum' END, CASE WHEN inc > 10 THEN 'mae_increased' END,
    CASE WHEN d >= 3 THEN 'features_drifting' END], lambda x: x IS NOT NULL), ',') AS reasons, r2 < 0.5 OR inc > 10 OR d >= 3 AS retrain
FROM (SELECT *, (mae - base) / base * 100 AS inc FROM
  (SELECT avg(abs(y - yhat2)) AS mae, 1 - sum((y - yhat2) * (y - yhat2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - yhat)) AS base FROM forecast_s),
  (SELECT count(DISTINCT CASE WHEN drift_flag THEN feature END) AS d FROM drift_report))""")
def _retrain(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    decision = m.retrain_decision(e.metrics_by(df, [], p="yhat2"), e.metrics_by(df, []), m.drift_summary(_report(spark, sf)))
    return joined(rounded(decision))


def _scoped(df: DataFrame, weak: DataFrame, p: str) -> DataFrame:
    part = e.metrics_by(e.rows_in_segments(df, weak), [], p=p).select(F.lit("weak").alias("scope"), "mae", "r2", "mape")
    return e.metrics_by(df, [], p=p).select(F.lit("overall").alias("scope"), "mae", "r2", "mape").unionByName(part)


# The champion's weak rows: states with the largest errors and months it under-predicts.
_WEAK_ROWS = """state IN (SELECT segment FROM (SELECT segment FROM errors_b WHERE kind = 'state' ORDER BY mae DESC, segment LIMIT 2))
  OR state IN (SELECT segment FROM (SELECT segment FROM errors_b WHERE kind = 'state' ORDER BY mape DESC, segment LIMIT 2))
  OR month_date IN (SELECT month_date FROM forecast_s GROUP BY month_date HAVING median((yhat2 - y) / y) < 0)"""


def _scope_sql(p: str, name: str) -> str:
    cols = f"""avg(abs(y - {p})) AS mae, 1 - sum((y - {p}) * (y - {p})) / nullif(var_pop(y) * count(*), 0) AS r2,
    avg(CASE WHEN y <> 0 THEN abs(y - {p}) / abs(y) END) * 100 AS mape"""
    return f"""{name} AS (SELECT 'overall' AS scope, {cols} FROM forecast_s UNION ALL SELECT 'weak', {cols} FROM forecast_s WHERE {_WEAK_ROWS})"""


@query("promotion_gate", "E8 E10", f"""WITH {_scope_sql('yhat2', 'a')}, {_scope_sql('yhat', 'b')}
SELECT scope, R[a.mae] AS champion_mae, R[a.r2] AS champion_r2, R[a.mape] AS champion_mape, R[b.mae] AS challenger_mae,
  R[b.r2] AS challenger_r2, R[b.mape] AS challenger_mape, R[(a.mae - b.mae) * 100 / a.mae] AS mae_gain_pct,
  array_to_string(list_filter([CASE WHEN (a.mae - b.mae) * 100 / a.mae >= 2 THEN NULL ELSE 'mae_gain_too_small' END,
    CASE WHEN a.r2 - b.r2 <= 0.01 THEN NULL ELSE 'r2_drop' END,
    CASE WHEN b.mape <= 1.05 * a.mape THEN NULL ELSE 'mape_worse' END], lambda x: x IS NOT NULL), ',') AS failed,
  coalesce((a.mae - b.mae) * 100 / a.mae >= 2 AND a.r2 - b.r2 <= 0.01 AND b.mape <= 1.05 * a.mape, false) AS promote
FROM a JOIN b USING (scope)""")
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    weak = cut_lineage(e.weak_segments(df, e.error_tables(df, p="yhat2"), 2, p="yhat2"))
    return joined(rounded(m.promotion_gate(_scoped(df, weak, "yhat2"), _scoped(df, weak, "yhat"))))


@query("segment_regressions", "E9", """SELECT kind, segment, R[a.mape] AS champion_mape, R[b.mape] AS challenger_mape,
  R[b.mape - a.mape] AS mape_delta FROM errors_a a JOIN errors_b b USING (kind, segment) WHERE b.mape - a.mape > 5""")
def _regressions(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    return rounded(m.segment_regressions(e.error_tables(df), e.error_tables(df, p="yhat2")))


@query("new_segment_regressions", "U5 E9", """WITH bad AS (SELECT kind, segment, b.mape - a.mape AS d FROM errors_a a JOIN errors_b b USING (kind, segment))
SELECT kind, segment, R[d] AS mape_delta FROM bad WHERE d > 5 AND (kind, segment) NOT IN (SELECT (kind, segment) FROM bad WHERE d > 12)""")
def _new_regressions(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    a, c = e.error_tables(df), e.error_tables(df, p="yhat2")
    new = m.new_regressions(m.segment_regressions(a, c, 5), m.segment_regressions(a, c, 12))
    return rounded(new.select("kind", "segment", "mape_delta"))


@query("experiment_comparison", "E10", """
WITH v AS (SELECT avg(abs(y - yhat2)) AS mae_a, avg(abs(y - yhat)) AS mae_b, sqrt(avg((y - yhat2) * (y - yhat2))) AS rmse_a,
  sqrt(avg((y - yhat) * (y - yhat))) AS rmse_b, 1 - sum((y - yhat2) * (y - yhat2)) / (var_pop(y) * count(*)) AS r2_a,
  1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2_b FROM forecast_s),
l AS (SELECT 'mae' AS metric, false AS higher_is_better, mae_a AS a, mae_b AS b FROM v UNION ALL SELECT 'rmse', false, rmse_a, rmse_b FROM v
  UNION ALL SELECT 'r2', true, r2_a, r2_b FROM v)
SELECT metric, higher_is_better, R[a] AS base_value, R[b] AS other_value, R[b - a] AS delta,
  CASE WHEN (b > a) = higher_is_better THEN 'mean3' ELSE 'lag1' END AS better,
  R[CASE WHEN higher_is_better THEN b - a ELSE a - b END * 100 / abs(a)] AS improvement_pct FROM l""")
def _experiments(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)

    def run(p: str, name: str) -> DataFrame:
        wide = e.metrics_by(df, [], p=p).select("mae", "rmse", "r2")
        return wide.unpivot([], ["mae", "rmse", "r2"], "metric", "value").select(F.lit(name).alias("run"), "*")

    runs = run("yhat2", "lag1").unionByName(run("yhat", "mean3")).withColumn("higher_is_better", F.col("metric") == "r2")
    return rounded(m.compare_metrics(runs, "lag1", "mean3"))


# Blending -------------------------------------------------------------------------------------

_BLEND = """SELECT w, 1 - w AS v, 1 - sum(d * d) / (var_pop(y) * count(*)) AS r2, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse
  FROM (SELECT y, w, y - (w * yhat + (1 - w) * yhat2) AS d FROM forecast_s, (SELECT unnest(range(21)) * 5 / 100e0 AS w)
    WHERE yhat2 IS NOT NULL) GROUP BY w"""


def _blended(spark: SparkSession, sf: str) -> DataFrame:
    df = t.forecast_table(spark, sf, True)
    joined = e.with_predictions(df.select(*K, "y", "yhat"), df.select(*K, "yhat2"), K).where("yhat2 is not null")
    return b.blend_grid(joined, "y", "yhat", "yhat2")


@query("blend_grid", "M11 J9 J4", f"SELECT R[w] AS weight_a, R[v] AS weight_b, R[r2] AS r2, R[mae] AS mae, R[rmse] AS rmse FROM ({_BLEND})")
def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_blended(spark, sf))


@query("best_blend", "M11 T7", f"""WITH g AS ({_BLEND})
SELECT metric, R[w] AS weight_a, R[v] AS weight_b, R[r2] AS r2, R[mae] AS mae, R[rmse] AS rmse,
  R[((SELECT mae FROM g WHERE w = 1) - mae) * 100 / (SELECT mae FROM g WHERE w = 1)] AS gain_over_a_pct,
  R[((SELECT mae FROM g WHERE w = 0) - mae) * 100 / (SELECT mae FROM g WHERE w = 0)] AS gain_over_b_pct FROM (
  SELECT 'mae' AS metric, * FROM g WHERE mae = (SELECT min(mae) FROM g) UNION ALL
  SELECT 'rmse', * FROM g WHERE rmse = (SELECT min(rmse) FROM g) UNION ALL SELECT 'r2', * FROM g WHERE r2 = (SELECT max(r2) FROM g))""")
def _best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.best_blends(_blended(spark, sf)))


@query("ranked_trials", "T6 M5", f"""SELECT R[w] AS weight_a, R[mae] AS mae, R[r2] AS r2 FROM ({_BLEND}) ORDER BY round(mae, 9), round(r2, 9) DESC LIMIT 5""")
def _trials(spark: SparkSession, sf: str) -> DataFrame:
    g = _blended(spark, sf)
    return rounded(b.rank_trials(g, "mae", "r2", 5).select("weight_a", "mae", "r2"))


@query("fold_metric_summary", "M4 E11", """
WITH f AS (SELECT year(month_date) AS fold, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
  1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2 FROM forecast_s GROUP BY ALL)
SELECT count(*) AS n_folds, R[avg(mae)] AS mae_mean, R[stddev_pop(mae)] AS mae_std, R[avg(rmse)] AS rmse_mean, R[stddev_pop(rmse)] AS rmse_std,
  R[avg(r2)] AS r2_mean, R[stddev_pop(r2)] AS r2_std,
  CASE WHEN avg(r2) >= 0.9 THEN 'excellent' WHEN avg(r2) >= 0.8 THEN 'good' ELSE 'needs_work' END AS level,
  CASE WHEN stddev_pop(r2) < 0.05 THEN 'stable' ELSE 'variable' END AS stability FROM f""")
def _fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    folds = e.metrics_by(t.forecast(spark, sf, True).withColumn("fold", F.year("month_date")), ["fold"])
    return rounded(b.fold_summary(folds))
