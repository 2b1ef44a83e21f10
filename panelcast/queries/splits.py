"""Time-ordered splits, folds and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import ranking
from panelcast.operators import splits as s
from panelcast.queries import tables as t
from panelcast.queries.registry import query
from panelcast.session import cut_lineage

K = ["state", "district", "month_date"]
Y = "total_enrolment"
ORDER = ["month_date", "state", "district"]

_POS = "row_number() OVER (ORDER BY month_date, state, district) - 1"


@query("positional_split", "D1 T1", f"""SELECT state, district, month_date, {Y}, CAST({_POS} AS BIGINT) AS position,
  CASE WHEN {_POS} < CAST(floor((SELECT count(*) FROM panel_s) * 0.8e0) AS BIGINT) THEN 'train' ELSE 'val' END AS split
  FROM panel_s""")
def _positional(spark: SparkSession, sf: str) -> DataFrame:
    return s.positional_split(t.enrol_panel(spark, sf, True), ORDER, 0.2)


@query("date_bounded_split", "D2", f"""SELECT state, district, month_date, {Y}, CASE WHEN month_date <= DATE '1999-06-30' THEN 'train'
  WHEN month_date <= DATE '2000-06-30' THEN 'val' ELSE 'test' END AS split FROM panel_s""")
def _dates(spark: SparkSession, sf: str) -> DataFrame:
    return s.date_split(t.enrol_panel(spark, sf, True), "month_date", "1999-06-30", "2000-06-30")


@query("split_sizes", "D2 D7", """SELECT split, count(*) AS n_rows, min(month_date) AS first_date, max(month_date) AS last_date,
  count(DISTINCT month_date) AS n_months FROM (SELECT month_date, CASE WHEN month_date <= DATE '1999-06-30' THEN 'train'
  WHEN month_date <= DATE '2000-06-30' THEN 'val' WHEN month_date <= DATE '2001-03-31' THEN 'test' END AS split FROM panel_s)
  WHERE split IS NOT NULL GROUP BY split""")
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    df = s.date_split(t.enrol_panel(spark, sf, True), "month_date", "1999-06-30", "2000-06-30", "2001-03-31")
    return s.split_sizes(df, "month_date")


@query("last_months_split", "D3 W24 J8", f"""SELECT state, district, p.month_date, {Y},
  CASE WHEN i > (SELECT max(i) FROM month_rank) - 3 THEN 'val' ELSE 'train' END AS split
  FROM panel_s p JOIN month_rank m ON p.month_date = m.month_date""")
def _last(spark: SparkSession, sf: str) -> DataFrame:
    return s.last_months_split(cut_lineage(t.enrol_panel(spark, sf, True)), n_months=3).select(*K, Y, "split")


@query("cutoff_month", "D3", """SELECT month_date AS cutoff FROM month_rank WHERE i = (SELECT max(i) FROM month_rank) - 3""")
def _cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return s.cutoff_date(cut_lineage(t.enrol_panel(spark, sf, True)), n_months=3)


@query("tune_and_test_months", "J8 U2 D3", f"""SELECT state, district, p.month_date, {Y},
  CASE WHEN i > (SELECT max(i) FROM month_rank) - 2 THEN 'test' ELSE 'tune' END AS part
  FROM panel_s p JOIN month_rank m ON p.month_date = m.month_date""")
def _holdout(spark: SparkSession, sf: str) -> DataFrame:
    tune, test = s.holdout_months(cut_lineage(t.enrol_panel(spark, sf, True)), 2)
    return tune.withColumn("part", F.lit("tune")).unionByName(test.withColumn("part", F.lit("test")))


@query("month_index", "W24 U3", "SELECT CAST(i AS INTEGER) AS month_idx, month_date FROM month_rank")
def _months(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.month_index(t.enrol_panel(spark, sf, True))


@query("expanding_fold_table", "D4 W24", "SELECT fold, role, month_date FROM fold_months")
def _fold_table(spark: SparkSession, sf: str) -> DataFrame:
    return s.expanding_folds(t.enrol_panel(spark, sf, True), n_folds=4, gap_months=1, min_train_months=3)


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    df = cut_lineage(t.enrol_panel(spark, sf, True))
    return s.assign_folds(df, s.expanding_folds(df, n_folds=4, gap_months=1, min_train_months=3))


@query("expanding_fold_rows", "D4 J8", f"SELECT state, district, month_date, {Y}, fold, role FROM fold_rows")
def _fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)


@query("fold_checks", "D6", """SELECT fold, max(CASE WHEN role = 'train' THEN month_date END) AS train_max,
  min(CASE WHEN role = 'val' THEN month_date END) AS val_min, CAST(0 AS BIGINT) AS overlap_rows,
  max(CASE WHEN role = 'train' THEN month_date END) < min(CASE WHEN role = 'val' THEN month_date END) AS in_order
  FROM fold_rows GROUP BY fold""")
def _checks(spark: SparkSession, sf: str) -> DataFrame:
    return s.fold_checks(_assigned(spark, sf), K[:2])


@query("fold_summary", "D7", """SELECT fold, role, count(*) AS n_rows, min(month_date) AS first_date, max(month_date) AS last_date,
  count(DISTINCT month_date) AS n_months FROM fold_rows GROUP BY fold, role""")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return s.split_sizes(_assigned(spark, sf), "month_date", ("fold", "role"))


def _row_folds_sql(first: str) -> str:
    return f"""WITH r AS (SELECT *, {_POS} AS pos, (SELECT count(*) FROM panel_s) AS n FROM panel_s),
f AS (SELECT r.*, fold, n - (4 - fold) * (n // 4) AS start FROM r, (SELECT unnest([1, 2, 3]) AS fold))
SELECT state, district, month_date, {Y}, CAST(pos AS BIGINT) AS position, CAST(fold AS INTEGER) AS fold,
  CASE WHEN pos < start - 50 THEN 'train' ELSE 'val' END AS role FROM f
WHERE (pos >= {first} AND pos < start - 50) OR (pos >= start AND pos < start + n // 4)"""


@query("row_count_folds", "D5", _row_folds_sql("0"))
def _row_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Training takes every row before the gap."""
    return s.row_folds(cut_lineage(t.enrol_panel(spark, sf, True)), ORDER, n_splits=3, gap=50)


@query("row_count_folds_with_train_limit", "D5", _row_folds_sql("greatest(0, start - 50 - 3000)"))
def _row_folds_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The learner's sliding window: only the last 3,000 rows before the gap train."""
    return s.row_folds(cut_lineage(t.enrol_panel(spark, sf, True)), ORDER, n_splits=3, gap=50, max_train_size=3000)


@query("split_union", "U2 D2", f"""SELECT state, district, month_date, {Y} FROM panel_s WHERE month_date <= DATE '2000-06-30'""")
def _union(spark: SparkSession, sf: str) -> DataFrame:
    df = s.date_split(t.enrol_panel(spark, sf, True), "month_date", "1999-06-30", "2000-06-30").drop("split")
    return df.where("month_date <= '1999-06-30'").unionByName(
        df.where("month_date > '1999-06-30' and month_date <= '2000-06-30'"))
