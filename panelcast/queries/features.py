"""Series, calendar, policy and group features and the composite feature tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import dates as d
from panelcast.functions import numbers as n
from panelcast.operators import calendars, groups
from panelcast.operators import series as ts
from panelcast.operators.fold_stats import fold_group_features
from panelcast.operators.panel import add_next_month_target
from panelcast.operators.series import DISTRICT, Series
from panelcast.operators.splits import assign_folds, expanding_folds
from panelcast.plans import features as plans
from panelcast.queries import tables as t
from panelcast.queries.registry import cte, query, rounded
from panelcast.session import cut_lineage

Y = "total_enrolment"
K = ["state", "district", "month_date"]
PHASES = {
    "phase_1": ("1995-01-01", "1996-12-31"),
    "phase_2": ("1997-01-01", "1998-12-31"),
    "phase_3": ("1999-01-01", "2001-12-31"),
}
CAMPAIGNS = (("1995-04-01", "1995-04-30"), ("1997-08-01", "1997-08-31"), ("2000-10-01", "2000-10-31"))
CONFIG = plans.FeatureConfig(phases=PHASES, campaigns=CAMPAIGNS)

W = "WINDOW w AS (PARTITION BY state, district ORDER BY month_date)"
BACK3 = "(w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
BACK6 = "(w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
ALL = "(PARTITION BY state, district)"

POLICY_SQL = """CAST(month_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS INTEGER) AS is_phase_1,
  CAST(month_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AS INTEGER) AS is_phase_2,
  CAST(month_date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' AS INTEGER) AS is_phase_3,
  CAST(month_date BETWEEN DATE '1995-04-01' AND DATE '1995-04-30' OR month_date BETWEEN DATE '1997-08-01'
    AND DATE '1997-08-31' OR month_date BETWEEN DATE '2000-10-01' AND DATE '2000-10-31' AS INTEGER) AS is_campaign_month,
  CAST(CAST(month_date > DATE '1995-04-30' AS INTEGER) + CAST(month_date > DATE '1997-08-31' AS INTEGER)
    + CAST(month_date > DATE '2000-10-31' AS INTEGER) AS INTEGER) AS campaign_count"""
SEASON_SQL = """CAST(month(month_date) IN (1, 8, 10, 11) AS INTEGER) AS is_festival_peak,
  CAST(month(month_date) IN (2, 3, 4) AS INTEGER) AS is_exam_month,
  CAST(month(month_date) = 2 AS INTEGER) AS is_budget_month, CAST(month(month_date) = 4 AS INTEGER) AS is_fy_start,
  CAST(month(month_date) = 3 AS INTEGER) AS is_fy_end, CAST(month(month_date) IN (7, 8, 9) AS INTEGER) AS is_monsoon,
  CAST(month(month_date) IN (3, 4, 10, 11) AS INTEGER) AS is_harvest"""
CYCLE_SQL = """R[sin(2 * pi() * month(month_date) / 12)] AS month_sin,
  R[cos(2 * pi() * month(month_date) / 12)] AS month_cos"""


@query("lag_features", "W1", f"""SELECT state, district, month_date, {Y},
  R[coalesce(lag({Y}, 1) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_1,
  R[coalesce(lag({Y}, 2) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_2,
  R[coalesce(lag({Y}, 3) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_3,
  R[coalesce(lag({Y}, 6) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_6 FROM panel_s {W}""")
def _lags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.enrol_panel(spark, sf, True).withColumns(ts.lag_cols(DISTRICT, Y, (0, -2, 1, 2, 3, 6))))


@query("calendar_month_lags", "W1 W20", f"""SELECT state, district, month_date, {Y},
  CAST(lag({Y}, 1) OVER w AS DOUBLE) AS {Y}_lag_1, CAST(lag({Y}, 12) OVER w AS DOUBLE) AS {Y}_lag_12 FROM gappy {W}""")
def _calendar_lags(spark: SparkSession, sf: str) -> DataFrame:
    return t.gappy(spark, sf).withColumns(ts.lag_cols(DISTRICT, Y, (1, 12), fill=False))


@query("rolling_features", "W3", f"""SELECT state, district, month_date, {Y},
  R[coalesce(avg({Y}) OVER {BACK3}, avg({Y}) OVER {ALL})] AS {Y}_rolling_3_mean,
  R[coalesce(stddev_samp({Y}) OVER {BACK3}, stddev_samp({Y}) OVER {ALL})] AS {Y}_rolling_3_std,
  R[coalesce(avg({Y}) OVER {BACK6}, avg({Y}) OVER {ALL})] AS {Y}_rolling_6_mean,
  R[coalesce(stddev_samp({Y}) OVER {BACK6}, stddev_samp({Y}) OVER {ALL})] AS {Y}_rolling_6_std FROM panel_s {W}""")
def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.enrol_panel(spark, sf, True).withColumns(ts.rolling_cols(DISTRICT, Y)))


@query("diff_and_pct_change", "W5 W6 F12", f"""SELECT state, district, month_date, {Y},
  CAST(coalesce({Y} - lag({Y}, 1) OVER w, 0) AS DOUBLE) AS {Y}_diff_1,
  CAST(coalesce({Y} - lag({Y}, 3) OVER w, 0) AS DOUBLE) AS {Y}_diff_3,
  R[coalesce(({Y} - lag({Y}, 1) OVER w) / nullif(CAST(lag({Y}, 1) OVER w AS DOUBLE), 0), 0)] AS {Y}_pct_change_1
  FROM panel_s {W}""")
def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    cols = ts.diff_cols(DISTRICT, Y, (1, 3)) | ts.pct_change_cols(DISTRICT, Y)
    return rounded(t.enrol_panel(spark, sf, True).withColumns(cols))


@query("next_month_target", "W2 P11", f"""SELECT * FROM (SELECT state, district, month_date, {Y},
  lead({Y}) OVER w AS target_enrolment_next_month FROM panel_s {W}) WHERE target_enrolment_next_month IS NOT NULL""")
def _target(spark: SparkSession, sf: str) -> DataFrame:
    return add_next_month_target(t.enrol_panel(spark, sf, True))


@query("stability_features", "W16", "SELECT state, district, month_date, " + ", ".join(
    f"R[{fn}({Y}) OVER {f}] AS roll_lag1m_{a}_{k}" for k, f in ((3, BACK3), (6, BACK6))
    for fn, a in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max"))) + f" FROM panel_s {W}")
def _stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.enrol_panel(spark, sf, True).select(*K, *[c.alias(k) for k, c in ts.stability_cols(DISTRICT, Y).items()]))


@query("rolling_median_features", "W17", f"""SELECT state, district, month_date,
  R[median(CAST({Y} AS DOUBLE)) OVER {BACK3}] AS {Y}_rolling_3_median,
  R[median(CAST({Y} AS DOUBLE)) OVER {BACK6}] AS {Y}_rolling_6_median FROM panel_s {W}""")
def _medians(spark: SparkSession, sf: str) -> DataFrame:
    cols = ts.rolling_median_cols(DISTRICT, Y)
    return rounded(t.enrol_panel(spark, sf, True).select(*K, *[c.alias(k) for k, c in cols.items()]))


@query("volume_segments", "W18 F11", f"""SELECT state, district, month_date, {Y}, CASE WHEN {Y} <= lo THEN 'low'
  WHEN {Y} <= hi THEN 'medium' ELSE 'high' END AS volume_bucket
  FROM (SELECT *, quantile_cont(med, 0.33) OVER {ALL} AS lo, quantile_cont(med, 0.67) OVER {ALL} AS hi
    FROM (SELECT *, median(CAST({Y} AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS med
      FROM panel_s {W}))""")
def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return ts.volume_segments(t.enrol_panel(spark, sf, True), Y)


@query("ratio_to_state_mean", "W14 J10 F12", f"""SELECT state, district, month_date, {Y},
  R[CASE WHEN m > 0 THEN {Y} / m ELSE 1 END] AS ratio_to_state_mean
  FROM (SELECT *, avg({Y}) OVER (PARTITION BY state, month_date) AS m FROM panel_s)""")
def _ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(groups.ratio_to_peers(cut_lineage(t.enrol_panel(spark, sf, True)), Y))


@query("district_count_on_rows", "J10", """SELECT p.*, n AS n_districts FROM panel_s p JOIN (
  SELECT state, month_date, count(DISTINCT district) AS n FROM panel_s GROUP BY ALL) USING (state, month_date)""")
def _district_count(spark: SparkSession, sf: str) -> DataFrame:
    return groups.add_distinct_count(t.enrol_panel(spark, sf, True), ["state", "month_date"], "district", "n_districts")


@query("group_long_term_stats", "A6 J2", f"""SELECT state, district, month_date, {Y},
  R[avg({Y}) OVER {ALL}] AS group_long_term_mean, R[stddev_samp({Y}) OVER {ALL}] AS group_long_term_std FROM panel_s""")
def _stats(spark: SparkSession, sf: str) -> DataFrame:
    df = t.enrol_panel(spark, sf, True)
    return rounded(groups.add_group_stats(df, groups.group_stats(df, K[:2], Y), K[:2]))


@query("seasonal_calendar_join", "F3 J3", f"SELECT state, district, month_date, {Y}, {SEASON_SQL} FROM panel_n")
def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    return calendars.add_calendar(t.enrol_panel(spark, sf), "month_date")


@query("quarter_and_cycle_features", "F1 F4 F5", f"""SELECT state, district, month_date, {Y},
  CAST(quarter(month_date) AS INTEGER) AS quarter, CAST(quarter(month_date) = 1 AS INTEGER) AS is_q1,
  CAST(quarter(month_date) = 2 AS INTEGER) AS is_q2, CAST(quarter(month_date) = 3 AS INTEGER) AS is_q3,
  CAST(quarter(month_date) = 4 AS INTEGER) AS is_q4, {CYCLE_SQL} FROM panel_n""")
def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    cols = d.quarter_flags("month_date") | d.month_cycle("month_date")
    return rounded(t.enrol_panel(spark, sf).withColumns(cols))


@query("order_day_parts", "F1 P3 F13", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend, strftime(o_orderdate, '%Y-%m') AS year_month,
  strftime(o_orderdate, '%b %Y') AS month_label FROM orders""")
def _day_parts(spark: SparkSession, sf: str) -> DataFrame:
    df = t.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day_date"))
    df = df.withColumns(d.calendar_parts("day_date"))
    return df.withColumns({"year_month": d.month_key("day_date"), "month_label": d.month_label("day_date")}).drop("day_date")


@query("fiscal_calendar", "F2", f"""SELECT state, district, month_date, {Y}, CAST(year(month_date) AS INTEGER) AS year,
  CAST(month(month_date) AS INTEGER) AS month, CAST(quarter(month_date) AS INTEGER) AS quarter,
  CAST(CASE WHEN month(month_date) >= 4 THEN year(month_date) ELSE year(month_date) - 1 END AS INTEGER) AS financial_year,
  CAST(month(month_date) = 4 AS INTEGER) AS is_financial_year_start,
  CAST(month(month_date) = 3 AS INTEGER) AS is_financial_year_end,
  CAST(month(month_date) IN (8, 9, 10, 11) AS INTEGER) AS is_festival_month FROM panel_n""")
def _fiscal(spark: SparkSession, sf: str) -> DataFrame:
    return t.enrol_panel(spark, sf).withColumns(d.fiscal_parts("month_date"))


@query("policy_phase_features", "J6 J7", f"SELECT state, district, month_date, {Y}, {POLICY_SQL} FROM panel_n")
def _policy(spark: SparkSession, sf: str) -> DataFrame:
    return t.enrol_panel(spark, sf).withColumns(d.policy_flags("month_date", PHASES, CAMPAIGNS))


_NATIONS = tuple(f"NATION_{i}" for i in range(25))
_IN = ",\n  ".join(f"CAST(coalesce(bool_or(name = '{n}'), false) AS INTEGER) AS in_{n}" for n in _NATIONS)


@query("interval_table_join", "J6 J7", f"""
WITH iv AS (SELECT n_name AS name, min(date) AS s, CASE WHEN n_name = 'NATION_7' THEN DATE '9999-12-31'
    ELSE CAST(min(date) + INTERVAL 40 DAY AS DATE) END AS e FROM (SELECT district AS n_name, date FROM daily_a) GROUP BY n_name),
d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)
SELECT day, CAST(n AS BIGINT) AS n, {_IN}, CAST(count(name) > 0 AS INTEGER) AS in_any_interval,
  CAST((SELECT count(*) FROM iv WHERE e < day) AS BIGINT) AS ended_count
FROM d LEFT JOIN iv ON day BETWEEN s AND e GROUP BY day, n""")
def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Forty days from each nation's first order; one interval never ends."""
    daily = cut_lineage(t.enrolment(spark, sf))
    end = F.when(F.col("district") == "NATION_7", F.lit("9999-12-31").cast("date")).otherwise(F.date_add(F.min("date"), 40))
    iv = daily.groupBy("district").agg(F.min("date").alias("start"), end.alias("end")).withColumnRenamed("district", "name")
    days = cut_lineage(t.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")))
    return calendars.ended_before_count(calendars.interval_flags(days, "day", iv, _NATIONS), "day", iv)


@query("trend_and_event_features", "F6 F7 F8", f"""SELECT state, district, month_date, {Y},
  CAST(k AS INTEGER) AS months_since_start, CAST(k * k AS INTEGER) AS months_since_start_sq,
  CAST(month_date >= DATE '1998-01-01' AS INTEGER) AS post_intervention,
  R[greatest((month_date - DATE '1998-01-01') / 30.0, 0)] AS post_intervention_time,
  CAST(month_date >= DATE '1996-03-01' AND month_date < DATE '1997-06-01' AS INTEGER) AS is_covid_impact,
  CAST(month_date >= DATE '1997-06-01' AND month_date < DATE '1998-01-01' AS INTEGER) AS is_covid_recovery,
  CAST(month_date >= DATE '1998-01-01' AS INTEGER) AS post_covid
FROM (SELECT *, (year(month_date) - year(f)) * 12 + month(month_date) - month(f) AS k
  FROM panel_n, (SELECT min(month_date) AS f FROM panel_n))""")
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.enrol_panel(spark, sf))
    first = df.agg(F.min("month_date")).scalar()
    cols = d.time_trend("month_date", first) | d.intervention("month_date", "1998-01-01", trend=True)
    return rounded(df.withColumns(cols | d.recovery_phases("month_date", "1996-03-01", "1997-06-01", "1998-01-01")))


@query("challenger_flags", "F9 F17", """
SELECT p.state, district, month_date, CAST(idx AS INTEGER) AS state_idx, CAST(m IN (4, 7) AS INTEGER) AS is_scheme_month,
  CAST(m IN (3, 9) AS INTEGER) AS is_deadline_month, CAST(m IN (4, 8, 10) AS INTEGER) AS is_campaign,
  CAST(m IN (3, 4, 7, 8, 9, 10) AS INTEGER) AS is_any_event, CAST(m IN (10, 11) AS INTEGER) AS is_holiday_peak,
  CAST(m = 4 AS INTEGER) AS is_fy_start, CAST(m = 3 AS INTEGER) AS is_fy_end, CAST(m % 3 = 1 AS INTEGER) AS is_quarter_start,
  CAST(m % 3 = 0 AS INTEGER) AS is_quarter_end, CAST(m IN (5, 6) AS INTEGER) AS is_drive_month,
  CAST(m = 12 AS INTEGER) AS is_closure_month, CAST(idx * m AS INTEGER) AS state_x_month,
  CAST(m * CAST(m IN (5, 6) AS INTEGER) AS INTEGER) AS month_x_drive
FROM (SELECT *, month(month_date) AS m FROM panel_n) p
JOIN (SELECT state, row_number() OVER (ORDER BY state) - 1 AS idx FROM (SELECT DISTINCT state FROM panel_n)) i
ON p.state = i.state""")
def _challenger(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.enrol_panel(spark, sf))
    df = groups.apply_label_index(df, groups.fit_label_index(df, "state"), "state")
    flags = d.challenger_flags("month_date", "state_idx", (4, 7), (3, 9), (4, 8, 10), (5, 6), (12,))
    return df.withColumns(flags).drop(Y)


@query("label_encoding_train_only", "F17 J5", """
WITH e AS (SELECT district, row_number() OVER (ORDER BY district) - 1 AS idx FROM (
  SELECT DISTINCT district FROM panel_s WHERE month_date <= DATE '1995-01-31'))
SELECT state, p.district, month_date, total_enrolment, CAST(coalesce(idx, -1) AS INTEGER) AS district_idx
FROM panel_s p LEFT JOIN e ON p.district = e.district""")
def _encode(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.enrol_panel(spark, sf, True))
    return groups.apply_label_index(df, groups.fit_label_index(df.where("month_date <= '1995-01-31'"), "district"), "district")


@query("one_hot_states", "F18", """SELECT state, district, month_date,
  CAST((SELECT count(DISTINCT state) FROM panel_n q WHERE q.state < p.state) AS INTEGER) AS hot_position,
  CAST((SELECT count(DISTINCT state) FROM panel_n) AS INTEGER) AS width FROM panel_n p""")
def _one_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.enrol_panel(spark, sf))
    df = groups.one_hot(df, ["state"]).fit(df).transform(df)
    hot = vector_to_array("state_vec")
    return df.select(*K, (F.array_position(hot, F.lit(1.0)) - 1).cast("int").alias("hot_position"), F.size(hot).alias("width"))


@query("target_transforms", "F10", f"""SELECT state, district, month_date, R[ln({Y} + 1.0)] AS y_log, R[sqrt({Y})] AS y_sqrt,
  R[exp(ln({Y} + 1.0)) - 1.0] AS y_from_log, R[sqrt({Y}) * sqrt({Y})] AS y_from_sqrt,
  R[ln(1 + greatest({Y}, 0))] AS y_log1p, R[greatest(exp(ln(1 + greatest({Y}, 0))) - 1, 0)] AS y_from_log1p FROM panel_s""")
def _transforms(spark: SparkSession, sf: str) -> DataFrame:
    df = t.enrol_panel(spark, sf, True).select(*K, n.log_transform(Y).alias("y_log"), n.sqrt_transform(Y).alias("y_sqrt"),
                                               n.log1p_floored(Y).alias("y_log1p"))
    return rounded(df.withColumns({"y_from_log": n.log_inverse("y_log"), "y_from_sqrt": n.sqrt_inverse("y_sqrt"),
                                   "y_from_log1p": n.expm1_floored("y_log1p")}))


@query("rounding_functions", "F11", """SELECT o_orderkey, CAST(round_even(o_totalprice / 2500, 0) AS DOUBLE) AS half_even,
  CAST(ceil(o_totalprice / 5000) AS BIGINT) AS up, CAST(floor(o_totalprice / 5000) AS BIGINT) AS down,
  CAST(trunc(-o_totalprice / 5000) AS BIGINT) AS cut, least(greatest(o_totalprice, 50000), 200000) AS clipped FROM orders""")
def _rounding(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", F.bround(p / 2500, 0).alias("half_even"), F.ceil(p / 5000).alias("up"), F.floor(p / 5000).alias("down"),
        (-p / 5000).cast("bigint").alias("cut"), F.least(F.greatest(p, F.lit(50000.0)), F.lit(200000.0)).alias("clipped"))


SERIES_SQL = f"""R[coalesce(lag({Y}, 1) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_1,
  R[coalesce(lag({Y}, 2) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_2,
  R[coalesce(lag({Y}, 3) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_3,
  R[coalesce(lag({Y}, 6) OVER w, avg({Y}) OVER {ALL})] AS {Y}_lag_6,
  R[coalesce(avg({Y}) OVER {BACK3}, avg({Y}) OVER {ALL})] AS {Y}_rolling_3_mean,
  R[coalesce(stddev_samp({Y}) OVER {BACK3}, stddev_samp({Y}) OVER {ALL})] AS {Y}_rolling_3_std,
  R[coalesce(avg({Y}) OVER {BACK6}, avg({Y}) OVER {ALL})] AS {Y}_rolling_6_mean,
  R[coalesce(stddev_samp({Y}) OVER {BACK6}, stddev_samp({Y}) OVER {ALL})] AS {Y}_rolling_6_std,
  CAST(coalesce({Y} - lag({Y}, 1) OVER w, 0) AS DOUBLE) AS {Y}_diff_1,
  R[coalesce(({Y} - lag({Y}, 1) OVER w) / nullif(CAST(lag({Y}, 1) OVER w AS DOUBLE), 0), 0)] AS {Y}_pct_change_1"""


@query("series_features", "C2 W1 W3 W5 W6", f"SELECT state, district, month_date, {Y}, {SERIES_SQL} FROM panel_s {W}")
def _series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ts.add_series_features(t.enrol_panel(spark, sf, True), Y, pct_change=True))


@query("baseline_features", "C3 J3 J6 F1 F5 F6 P15", f"""
SELECT state, district, month_date, {Y}, {SERIES_SQL}, {SEASON_SQL}, {POLICY_SQL}, {CYCLE_SQL},
  CAST(k AS INTEGER) AS months_since_start, CAST(k * k AS INTEGER) AS months_since_start_sq,
  CAST(year(month_date) AS INTEGER) AS year, CAST(month(month_date) AS INTEGER) AS month,
  CAST(quarter(month_date) AS INTEGER) AS quarter
FROM (SELECT *, (year(month_date) - year(f)) * 12 + month(month_date) - month(f) AS k
  FROM panel_s, (SELECT min(month_date) AS f FROM panel_s)) {W}""")
def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plans.sentinel_fill(plans.monthly_features(cut_lineage(t.enrol_panel(spark, sf, True)), Y, CONFIG)))


@query("sentinel_fill", "P15", f"""SELECT state, district, month_date, coalesce({Y}, -999) AS {Y},
  coalesce(CAST(lag({Y}, 1) OVER w AS DOUBLE), -999e0) AS {Y}_lag_1 FROM gappy {W}""")
def _sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return plans.sentinel_fill(t.gappy(spark, sf).withColumns(ts.lag_cols(DISTRICT, Y, (1,), fill=False)))


# Fold rows of the segment panel: 4 expanding folds, gap 1, one validation month.
cte("month_rank", "SELECT month_date, row_number() OVER (ORDER BY month_date) - 1 AS i FROM (SELECT DISTINCT month_date FROM panel_s)")
cte("fold_months", """SELECT CAST(4 - f AS INTEGER) AS fold, CASE WHEN i <= n - 3 - f THEN 'train' ELSE 'val' END AS role, month_date
  FROM month_rank, (SELECT max(i) + 1 AS n FROM month_rank), (SELECT unnest([0, 1, 2, 3]) AS f)
  WHERE i <= n - 3 - f OR i = n - 1 - f""")
cte("fold_rows", "SELECT p.*, fold, role FROM panel_s p JOIN fold_months m ON p.month_date = m.month_date")
cte("fold_stats", f"""SELECT fold, state, district, avg({Y}) AS gm, stddev_samp({Y}) AS gs FROM fold_rows
  WHERE role = 'train' GROUP BY ALL""")
cte("fold_all", f"SELECT fold, avg({Y}) AS am, stddev_samp({Y}) AS asd FROM fold_rows WHERE role = 'train' GROUP BY ALL")


def _fold_table(df: DataFrame) -> DataFrame:
    return expanding_folds(df, n_folds=4, gap_months=1, min_train_months=3)


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.enrol_panel(spark, sf, True))
    return assign_folds(df, _fold_table(df))


def _fold_sql(scope: str) -> str:
    part = f"PARTITION BY {scope}, state, district"
    return f"""
SELECT r.state, r.district, month_date, {Y}, r.fold, r.role,
  R[coalesce(l1, gm, am)] AS {Y}_lag_1, R[coalesce(l2, gm, am)] AS {Y}_lag_2, R[coalesce(l3, gm, am)] AS {Y}_lag_3,
  R[coalesce(l6, gm, am)] AS {Y}_lag_6, R[coalesce(m3, gm, am)] AS {Y}_rolling_3_mean,
  R[coalesce(s3, gs, asd)] AS {Y}_rolling_3_std, R[coalesce(m6, gm, am)] AS {Y}_rolling_6_mean,
  R[coalesce(s6, gs, asd)] AS {Y}_rolling_6_std, CAST(coalesce({Y} - l1, 0) AS DOUBLE) AS {Y}_diff_1,
  {SEASON_SQL}, {POLICY_SQL}, {CYCLE_SQL}, CAST(k AS INTEGER) AS months_since_start,
  CAST(k * k AS INTEGER) AS months_since_start_sq, CAST(year(month_date) AS INTEGER) AS year,
  CAST(month(month_date) AS INTEGER) AS month, CAST(quarter(month_date) AS INTEGER) AS quarter,
  CAST(CASE WHEN month(month_date) >= 4 THEN year(month_date) ELSE year(month_date) - 1 END AS INTEGER) AS financial_year
FROM (SELECT *, lag({Y}, 1) OVER w AS l1, lag({Y}, 2) OVER w AS l2, lag({Y}, 3) OVER w AS l3, lag({Y}, 6) OVER w AS l6,
    avg({Y}) OVER {BACK3} AS m3, stddev_samp({Y}) OVER {BACK3} AS s3, avg({Y}) OVER {BACK6} AS m6,
    stddev_samp({Y}) OVER {BACK6} AS s6,
    (year(month_date) - year(f)) * 12 + month(month_date) - month(f) AS k
  FROM (SELECT *, min(month_date) OVER (PARTITION BY {scope}) AS f FROM fold_rows)
  WINDOW w AS ({part} ORDER BY month_date)) r
LEFT JOIN fold_stats g ON r.fold = g.fold AND r.state = g.state AND r.district = g.district
JOIN fold_all a ON r.fold = a.fold"""


@query("fold_features_past_rows", "C4 A6 U2", _fold_sql("fold"))
def _fold_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plans.fold_features(_folds(spark, sf), Y, CONFIG, "full"))


@query("fold_features_within_split", "C4 A6", _fold_sql("fold, role"))
def _fold_only(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plans.fold_features(_folds(spark, sf), Y, CONFIG, "fold"))


_FOLD_GROUPS = f"""
SELECT r.state, r.district, month_date, {Y}, r.fold, role, R[coalesce(gm, am)] AS group_long_term_mean,
  R[coalesce(gs, asd)] AS group_long_term_std, R[coalesce(m3, gm, am)] AS rolling_3_mean,
  R[coalesce(m6, gm, am)] AS rolling_6_mean,
  R[CASE WHEN coalesce(sm, am) > 0 THEN {Y} / coalesce(sm, am) ELSE 1 END] AS ratio_to_state_mean
FROM (SELECT *, avg({Y}) OVER {BACK3} AS m3, avg({Y}) OVER {BACK6} AS m6 FROM fold_rows
  WINDOW w AS (PARTITION BY fold, role, state, district ORDER BY month_date)) r
LEFT JOIN fold_stats g ON r.fold = g.fold AND r.state = g.state AND r.district = g.district
LEFT JOIN (SELECT fold, state, avg({Y}) AS sm FROM fold_rows WHERE role = 'train' GROUP BY ALL) s
  ON r.fold = s.fold AND r.state = s.state
JOIN fold_all a ON r.fold = a.fold"""


@query("fold_group_aggregates", "C4 A6 J5 W14", _FOLD_GROUPS)
def _fold_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plans.train_group_features(_folds(spark, sf), Y))


@query("fold_statistics_from_prefixes", "C4 A6 W14", _FOLD_GROUPS)
def _fold_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """The same table from monthly partials: no copy of the panel enters a statistic."""
    df = cut_lineage(t.enrol_panel(spark, sf, True))
    return rounded(fold_group_features(df, _fold_table(df), Y))


@query("daily_context_features", "C5 F1 W1 W4 P12", """
WITH d AS (SELECT state, date, CAST(count(*) AS BIGINT) AS y FROM daily_a GROUP BY ALL)
SELECT * FROM (SELECT state, date, y, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(lag(y, 1) OVER w AS DOUBLE) AS y_lag_1,
  CAST(lag(y, 7) OVER w AS DOUBLE) AS y_lag_7, CAST(lag(y, 30) OVER w AS DOUBLE) AS y_lag_30,
  R[avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)] AS y_roll7_mean,
  R[avg(y) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)] AS y_roll30_mean
  FROM d WINDOW w AS (PARTITION BY state ORDER BY date)) WHERE y_lag_30 IS NOT NULL""")
def _daily(spark: SparkSession, sf: str) -> DataFrame:
    fact = t.enrolment(spark, sf)
    daily = fact.groupBy("state", "date").agg(F.sum(F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")).alias("y"))
    return rounded(plans.daily_context_features(daily, "y", Series(("state",), "date")))


@query("calendar_and_group_features", "C6 F2 A6 W3 W14", f"""
SELECT state, district, month_date, {Y}, CAST(year(month_date) AS INTEGER) AS year,
  CAST(month(month_date) AS INTEGER) AS month, CAST(quarter(month_date) AS INTEGER) AS quarter,
  CAST(CASE WHEN month(month_date) >= 4 THEN year(month_date) ELSE year(month_date) - 1 END AS INTEGER) AS financial_year,
  CAST(month(month_date) = 4 AS INTEGER) AS is_financial_year_start,
  CAST(month(month_date) = 3 AS INTEGER) AS is_financial_year_end,
  CAST(month(month_date) IN (8, 9, 10, 11) AS INTEGER) AS is_festival_month,
  R[avg({Y}) OVER {BACK3}] AS rolling_3_mean, R[avg({Y}) OVER {BACK6}] AS rolling_6_mean,
  R[avg({Y}) OVER {ALL}] AS group_long_term_mean, R[stddev_samp({Y}) OVER {ALL}] AS group_long_term_std,
  R[{Y} / avg({Y}) OVER (PARTITION BY state, month_date)] AS ratio_to_state_mean FROM panel_s {W}""")
def _enhanced(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plans.calendar_and_group_features(t.enrol_panel(spark, sf, True), Y))


@query("log_context_features", "C7 F1 W1 W3 W18 P12", f"""
SELECT state, district, month_date, {Y}, year, month, day, day_of_week, quarter, {Y}_lag_1, {Y}_lag_3, {Y}_lag_6, {Y}_lag_12,
  R[m3] AS {Y}_roll_mean_3, R[m6] AS {Y}_roll_mean_6,
  CASE WHEN {Y} <= lo THEN 'low' WHEN {Y} <= hi THEN 'medium' ELSE 'high' END AS volume_bucket
FROM (SELECT *, quantile_cont(med, 0.33) OVER {ALL} AS lo, quantile_cont(med, 0.67) OVER {ALL} AS hi FROM (
  SELECT *, CAST(year(month_date) AS INTEGER) AS year, CAST(month(month_date) AS INTEGER) AS month,
    CAST(day(month_date) AS INTEGER) AS day, CAST(isodow(month_date) - 1 AS INTEGER) AS day_of_week,
    CAST(quarter(month_date) AS INTEGER) AS quarter,
    CAST(lag({Y}, 1) OVER w AS DOUBLE) AS {Y}_lag_1, CAST(lag({Y}, 3) OVER w AS DOUBLE) AS {Y}_lag_3,
    CAST(lag({Y}, 6) OVER w AS DOUBLE) AS {Y}_lag_6, CAST(lag({Y}, 12) OVER w AS DOUBLE) AS {Y}_lag_12,
    avg({Y}) OVER {BACK3} AS m3, avg({Y}) OVER {BACK6} AS m6,
    median(CAST({Y} AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS med FROM panel_s {W}))
WHERE {Y}_lag_12 IS NOT NULL""")
def _log_context(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plans.log_context_features(t.enrol_panel(spark, sf, True), Y))
