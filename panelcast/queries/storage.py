"""Sources, sinks, registry and streams: tables derived from the given ones are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import evaluate as e
from panelcast.operators.panel import monthly_sums
from panelcast.queries import tables as t
from panelcast.queries.registry import query, rounded
from panelcast.session import cut_lineage, scratch_path
from panelcast.sources import readers, sinks
from panelcast.streaming import corrections, series_state
from panelcast.streaming import incremental as inc

Y = "total_enrolment"


def _as_text(fact: DataFrame) -> DataFrame:
    """Daily facts the way they arrive: the date as dd-MM-yyyy text."""
    return fact.withColumn("date", F.date_format("date", "dd-MM-yyyy"))


@query("csv_glob_scan", "S1 K1 P1 A1 U1", "SELECT * FROM month_a")
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "enrolment")
    sinks.write_csv(_as_text(t.enrolment(spark, sf)), path)
    return monthly_sums(readers.read_daily_counts(spark, f"{path}/*.csv", t.ENROL), t.ENROL)


@query("csv_listed_files", "S2 U1", "SELECT * FROM month_b")
def _listed(spark: SparkSession, sf: str) -> DataFrame:
    path, fact = scratch_path(spark, "demographic"), cut_lineage(t.demographic(spark, sf))
    sinks.write_csv(_as_text(fact.where("year(date) < 1998")), f"{path}/early")
    sinks.write_csv(_as_text(fact.where("year(date) >= 1998")), f"{path}/late")
    listed = readers.read_listed_counts(spark, [f"{path}/early", f"{path}/absent", f"{path}/late"], t.DEMO)
    return monthly_sums(listed, t.DEMO)


@query("header_check", "S4", """SELECT 'orders' AS kind, CAST(1 AS BIGINT) AS n_headers, string_agg(column_name, ',') AS header, true AS consistent
  FROM (DESCRIBE orders) UNION ALL SELECT 'customer', 2, NULL, false""")
def _headers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tables as CSV, in two parts by a date or a balance that cover every row; the customers' columns stand in two orders."""
    path = scratch_path(spark, "headers")
    orders, customer = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    early, low = F.coalesce(F.col("o_orderdate") < F.lit("1995-07-01").cast("date"), F.lit(False)), F.coalesce(F.col("c_acctbal") < 4500, F.lit(False))
    sinks.write_csv(orders.where(early), f"{path}/orders/early")
    sinks.write_csv(orders.where(~early), f"{path}/orders/late")
    sinks.write_csv(customer.where(low), f"{path}/customer/a")
    sinks.write_csv(customer.where(~low).select(*reversed(customer.columns)), f"{path}/customer/b")
    out = readers.header_check(spark, {k: f"{path}/{k}" for k in ("orders", "customer")})
    return out.select("kind", "n_headers", F.when(F.col("consistent"), F.col("header")).alias("header"), "consistent")


@query("sample_scan", "S3", "SELECT CAST(least(count(*), 5000) AS BIGINT) AS n_rows FROM lineitem")
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return readers.sample_scan(t.table(spark, sf, "lineitem"), 5000).agg(F.count(F.lit(1)).alias("n_rows"))


@query("panel_by_month_on_disk", "K1 S5 P9", "SELECT * FROM panel")
def _panel(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    sinks.write_panel(t.panel(spark, sf), path)
    df = readers.load_table(spark, path, ["state", "district", Y])
    return df.withColumn("year_month", F.col("year_month").cast("string"))


@query("dated_csv", "S6 K1", "SELECT state, district, month_date, total_enrolment FROM panel_s")
def _dated(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "modeling")
    sinks.write_csv(t.enrol_panel(spark, sf, True), path)
    return readers.read_dated_csv(spark, path, "state string, district string, month_date date, total_enrolment bigint")


@query("prediction_tables", "S7 K2 J4 U2", """SELECT CAST(year(month_date) AS INTEGER) AS fold, state, district, month_date, y, R[yhat] AS prediction FROM forecast_s""")
def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "oof")
    df = t.forecast(spark, sf, True).withColumn("fold", F.year("month_date")).withColumnRenamed("yhat", "prediction")
    sinks.write_predictions(df.drop("yhat2"), path)
    return rounded(readers.read_predictions(spark, path))


@query("model_versions", "S8 K3", """SELECT state AS version, '2024-01-' || lpad(CAST(length(state) AS VARCHAR), 2, '0') AS created_at, R[avg(abs(y - yhat))] AS mae,
  R[sqrt(avg((y - yhat) * (y - yhat)))] AS rmse, R[1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))] AS r2,
  CASE WHEN state < 'B' THEN R[avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100] END AS mape FROM forecast_s GROUP BY state""")
def _versions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metadata")
    df = t.forecast(spark, sf, True)
    m = e.metrics_by(df, ["state"])
    stamp = F.format_string("2024-01-%02d", F.length("state"))
    new = m.where("state < 'B'").select(F.col("state").alias("version"), stamp.alias("created_at"), F.struct("mae", "rmse", "r2", "mape").alias("metrics"))
    cv = F.struct(F.col("mae").alias("mae_mean"), F.col("rmse").alias("rmse_mean"), F.col("r2").alias("r2_mean"))
    old = m.where("state >= 'B'").select(F.col("state").alias("model_version"), stamp.alias("saved_at"), cv.alias("cv"))
    sinks.write_metrics(new, m, e.safety_report(df, ["state"]), f"{path}/a")
    old.write.json(f"{path}/b/metrics")
    return rounded(readers.read_model_versions(spark, f"{path}/*/metrics", multiline=False).drop("params"))


@query("write_once_table", "K4", "SELECT state, district, month_date, total_enrolment FROM panel_n")
def _once(spark: SparkSession, sf: str) -> DataFrame:
    path, df = scratch_path(spark, "frozen"), t.enrol_panel(spark, sf)
    sinks.write_once(df, path)
    try:
        sinks.write_once(df.where("state = 'ASIA'"), path)
        raise AssertionError("a frozen table was overwritten")
    except Exception as refused:
        if "already exists" not in str(refused):
            raise
    return spark.read.parquet(path)


@query("experiment_log", "K5 K3", """SELECT 'mean3' AS run, R[avg(abs(y - yhat))] AS mae, count(*) AS n_samples FROM forecast_s
  UNION ALL SELECT 'lag1', R[avg(abs(y - yhat2))], count(*) FROM forecast_s""")
def _log(spark: SparkSession, sf: str) -> DataFrame:
    path, df = scratch_path(spark, "experiments"), t.forecast(spark, sf, True)
    for name, p in (("mean3", "yhat"), ("lag1", "yhat2")):
        sinks.append_log(e.metrics_by(df, [], p=p).select(F.lit(name).alias("run"), "mae", "n_samples"), path)
    return rounded(spark.read.parquet(path).drop("logged_at"))


@query("champion_pointers", "K6", """SELECT state, CASE WHEN r = 1 THEN 'current' ELSE 'previous' END AS slot, version FROM (
  SELECT state, strftime(month_date, '%Y-%m') AS version, row_number() OVER (PARTITION BY state ORDER BY mae, month_date DESC) AS r
  FROM (SELECT state, month_date, round(avg(abs(y - yhat)), 9) AS mae FROM forecast_s GROUP BY ALL)) WHERE r <= 2""")
def _champions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "champions")
    m = t.forecast(spark, sf, True).groupBy("state", "month_date").agg(F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 9).alias("mae"))
    # The better the month, the later its promotion.
    m.select("state", F.date_format("month_date", "yyyy-MM").alias("version"), (-F.col("mae")).alias("updated_at")).write.parquet(path)
    return sinks.champions(spark.read.parquet(path), ["state"]).select("state", "slot", "version")


@query("named_views", "K7 J1", "SELECT state, CAST(sum(total_enrolment) AS BIGINT) AS enrolment, CAST(sum(total_bio) AS BIGINT) AS bio FROM panel GROUP BY state")
def _views(spark: SparkSession, sf: str) -> DataFrame:
    sinks.register_views(dict(zip(("enrolment_monthly", "demographic_monthly", "biometric_monthly"), t.monthly(spark, sf), strict=True)))
    return spark.sql("""
        SELECT state, sum(age_0_5 + age_5_17 + age_18_greater) AS enrolment, sum(bio_age_5_17 + bio_age_17_) AS bio
        FROM enrolment_monthly JOIN demographic_monthly USING (state, district, month_date)
        JOIN biometric_monthly USING (state, district, month_date) GROUP BY state""")


# Streams --------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = t.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("incremental_monthly_events", "R1 A1", """SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month_date,
  CAST(count(*) AS BIGINT) AS n, R[sum(value)] AS value FROM events GROUP BY ALL""")
def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    stream = _event_stream(spark, sf).withColumn("n", F.lit(1).cast("bigint"))
    monthly = inc.monthly_stream(stream, ["event_type"], "ts", ["n", "value"])
    inc.run_available(monthly, inc.changed_rows_writer(f"{path}/panel"), f"{path}/checkpoint")
    return rounded(inc.latest_rows(spark, f"{path}/panel", ["event_type", "month_date"]))


@query("daily_event_windows", "R1", """SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
  CAST(count(*) AS BIGINT) AS n, R[sum(value)] AS value FROM events GROUP BY ALL""")
def _daily(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")]
    windows = inc.tumbling_stream(_event_stream(spark, sf), "ts", ["event_type"], aggs, lateness="60 days")
    inc.require_no_late_rows(inc.run_available(windows, inc.changed_rows_writer(f"{path}/days"), f"{path}/checkpoint"))
    out = inc.latest_rows(spark, f"{path}/days", ["event_type", "window_start"])
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("corrected_event_windows", "R1", """SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
  CAST(count(*) AS BIGINT) AS n, R[sum(value)] AS value FROM events GROUP BY ALL""")
def _corrected(spark: SparkSession, sf: str) -> DataFrame:
    """All events in shuffled files, one file a batch: most come late, and their days are restated."""
    path = scratch_path(spark, "stream")
    events = t.table(spark, sf, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    write = corrections.restating_writer(f"{path}/out", "ts", ["event_type"], {"n": F.lit(1).cast("bigint"), "value": F.col("value")})
    inc.run_available(stream, write, f"{path}/checkpoint")
    out = corrections.newest_windows(spark, f"{path}/out", ["event_type"])
    return rounded(out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "value"))


_ALERTS = """SELECT state, district, month_date, R[yhat] AS yhat, alert_type FROM (
  SELECT *, CASE WHEN h AND u THEN 'both' WHEN h THEN 'high_load' WHEN u THEN 'underperforming' ELSE 'none' END AS alert_type
  FROM (SELECT *, yhat >= p90 AND (yhat - yhat2) / (yhat2 + 1e-6) > 0.2 AS h,
      yhat >= p70 AND y < yhat AND abs(y - yhat) / (y + 1e-6) > 0.3 AS u
    FROM forecast, (SELECT quantile_cont(yhat, 0.9) AS p90, quantile_cont(yhat, 0.7) AS p70 FROM forecast)))"""


@query("incremental_alerts", "R2 E3 E6", _ALERTS)
def _refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Facts arrive as one file per two-year slice; the last version must equal the batch result."""
    path = scratch_path(spark, "refresh")
    fact = t.enrolment(spark, sf).select("state", "district", "date", (F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")).alias(Y))
    slices = fact.withColumn("slice", F.floor(F.year("date") / 2)).hint("rebalance", "slice")
    slices.write.partitionBy("slice").parquet(f"{path}/in")
    stream = spark.readStream.schema(slices.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    inc.incremental_refresh(spark, stream, ["state", "district"], "date", Y, f"{path}/out", f"{path}/checkpoint")
    versions = spark.read.parquet(f"{path}/out/alerts")
    last = versions.agg(F.max("version")).scalar()
    return rounded(versions.where(F.col("version") == last).select("state", "district", "month_date", "yhat", "alert_type"))


@query("alerts_from_series_state", "R2 E6 W1 W3", _ALERTS)
def _state_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The same alerts from features kept in stream state; facts arrive shuffled, a month in several batches."""
    path = scratch_path(spark, "state")
    fact = t.enrolment(spark, sf).select("state", "district", "date", (F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")).alias(Y))
    fact.repartition(3, F.xxhash64("date", "district", Y)).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    series_state.keep_features(stream, ["state", "district"], "date", Y, f"{path}/out", f"{path}/checkpoint")
    found = series_state.alerts_from_features(series_state.newest_features(spark, f"{path}/out", ["state", "district"]), ["state", "district"])
    return rounded(found.select("state", "district", "month_date", "yhat", "alert_type"))
