"""Calendar and interval dimensions and the joins that attach them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions.dates import seasonal_flags


def holiday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Seasonal flags for every month start from the month of ``start`` to ``end``."""
    bounds = F.sequence(
        F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month")
    )
    months = spark.range(1).select(F.explode(bounds).alias("month_date"))
    return months.withColumns(seasonal_flags("month_date"))


def calendar_of(df: DataFrame, date: str, before: int = 0, after: int = 0) -> DataFrame:
    """The calendar covering a table's dates, optionally padded by months on both sides."""
    ends = df.agg(
        F.add_months(F.trunc(F.min(date), "MM"), -before).alias("lo"),
        F.add_months(F.trunc(F.max(date), "MM"), after).alias("hi"),
    )
    months = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month_date"))
    return months.withColumns(seasonal_flags("month_date"))


def add_calendar(df: DataFrame, date: str, calendar: DataFrame | None = None) -> DataFrame:
    """Left join of the calendar on the month of ``date``; months it lacks get zeros.

    The calendar has one row per month (a century is 1,200 rows), hence broadcast.
    """
    cal = calendar if calendar is not None else calendar_of(df, date)
    flags = [c for c in cal.columns if c != "month_date"]
    cal = cal.withColumnRenamed("month_date", "_cal")
    joined = df.join(F.broadcast(cal), F.trunc(date, "MM") == F.col("_cal"), "left").drop("_cal")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in flags})


def interval_flags(
    df: DataFrame, date: str, intervals: DataFrame, names: Sequence[str], any_name: str = "in_any_interval"
) -> DataFrame:
    """Flags of the named intervals containing the date, for an interval table of any size.

    Distinct dates (calendar-bounded) meet the intervals by day: each interval is cut to the
    data's first and last date and expanded to its days, so the join is an equi-join and an open
    end costs nothing.  The result has one row per day of the data, hence broadcast.
    """
    span = df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi"))).scalar()
    cut = intervals.select("name", F.greatest("start", span["lo"]).alias("_a"), F.least("end", span["hi"]).alias("_z"))
    days = (
        cut.where("_a <= _z").select("name", F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))).alias(date))
        .groupBy(date)
        .agg(F.collect_set(F.when(F.col("name").isin(*names), F.col("name"))).alias("_in"))
    )
    joined = df.join(F.broadcast(days), date, "left")
    named = {f"in_{n}": F.coalesce(F.array_contains("_in", n), F.lit(False)).cast("int") for n in names}
    return joined.withColumns(named | {any_name: F.col("_in").isNotNull().cast("int")}).drop("_in")


def ended_before_count(df: DataFrame, date: str, intervals: DataFrame, name: str = "ended_count") -> DataFrame:
    """Number of intervals that ended before the date.

    A theta join in disguise: interval ends are counted per day and accumulated over the union
    of both date sets, then joined back on the date: one row per day, hence broadcast.
    """
    ends = intervals.groupBy(F.col("end").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    days = df.select(F.col(date).alias("_d"), F.lit(0).cast("bigint").alias("_n")).distinct()
    per_day = ends.unionByName(days).groupBy("_d").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    running = per_day.select(F.col("_d").alias(date), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(name))
    return df.join(F.broadcast(running), date, "left")
