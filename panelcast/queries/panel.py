"""Panel build, modeling table and exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.panel import model_dataset
from panelcast.queries import tables as t
from panelcast.queries.registry import query

PREV = ", ".join(f"{m} - lag({m}) OVER w AS {m}_diff_1, lag({m}) OVER w AS {m}_prev_1"
                 for m in ("total_enrolment", "total_demo", "total_bio"))

MODEL_TABLE = f"""SELECT * FROM (
  SELECT *, {PREV}, CAST(year(month_date) AS INTEGER) AS year, CAST(month(month_date) AS INTEGER) AS month
  FROM (SELECT *, lead(total_enrolment) OVER (PARTITION BY state, district ORDER BY month_date)
          AS target_enrolment_next_month FROM panel)
  WHERE target_enrolment_next_month IS NOT NULL
  WINDOW w AS (PARTITION BY state, district ORDER BY month_date))
WHERE total_enrolment_prev_1 IS NOT NULL"""


@query("model_dataset", "A1 J1 P3 P4 P7 W1 W2 W5 P11 P12 C8", MODEL_TABLE)
def _model_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return model_dataset(t.panel(spark, sf))


@query("enrolment_by_month", "A1 P3", "SELECT * FROM month_a")
def _enrol(spark: SparkSession, sf: str) -> DataFrame:
    return t.monthly(spark, sf)[0]


@query("demographic_by_month", "A1", "SELECT * FROM month_b")
def _demo(spark: SparkSession, sf: str) -> DataFrame:
    return t.monthly(spark, sf)[1]


@query("biometric_by_month", "A1", "SELECT * FROM month_c")
def _bio(spark: SparkSession, sf: str) -> DataFrame:
    return t.monthly(spark, sf)[2]


@query("district_month_panel", "J1 P7 P3", "SELECT * FROM panel")
def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return t.panel(spark, sf)


@query("flagship_growth", "A1 J1 W1 W2 W5 T3",
       f"""SELECT state, district, month_date, total_enrolment, total_enrolment_diff_1, target_enrolment_next_month
       FROM ({MODEL_TABLE}) ORDER BY total_enrolment_diff_1 DESC, state, district, month_date LIMIT 50""")
def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    return (
        model_dataset(t.panel(spark, sf))
        .select("state", "district", "month_date", "total_enrolment", "total_enrolment_diff_1",
                "target_enrolment_next_month")
        .orderBy(F.desc("total_enrolment_diff_1"), "state", "district", "month_date")
        .limit(50)
    )
