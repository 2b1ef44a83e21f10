"""Daily count facts -> region x month panel -> modeling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.series import DISTRICT, Series, lead_col

KEYS = ("state", "district")

# Count bands of the three facts and the totals they add up to.
BANDS = {
    "total_enrolment": ("age_0_5", "age_5_17", "age_18_greater"),
    "total_demo": ("demo_age_5_17", "demo_age_17_"),
    "total_bio": ("bio_age_5_17", "bio_age_17_"),
}


def monthly_sums(
    fact: DataFrame, bands: Sequence[str], keys: Sequence[str] = KEYS, date: str = "date"
) -> DataFrame:
    """SUM of the bands by key and month; partial sums run before the shuffle, so hot keys collapse early."""
    month = F.trunc(date, "MM").alias("month_date")
    return fact.groupBy(*keys, month).agg(*[F.sum(b).alias(b) for b in bands])


def join_facts(*facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join of monthly facts on (keys, month).

    Every input is already hash-partitioned on these columns by its aggregation, so the joins
    add no exchange.
    """
    on = [*keys, "month_date"]
    out = facts[0]
    for f in facts[1:]:
        out = out.join(f, on, "inner")
    return out.withColumn("year_month", F.date_format("month_date", "yyyy-MM"))


def add_totals(panel: DataFrame, bands: dict[str, tuple[str, ...]] = BANDS) -> DataFrame:
    """Sum of the bands of every fact present in the panel."""
    totals = {}
    for total, parts in bands.items():
        if set(parts) <= set(panel.columns):
            expr = F.col(parts[0])
            for p in parts[1:]:
                expr = expr + F.col(p)
            totals[total] = expr
    return panel.withColumns(totals)


def add_next_month_target(panel: DataFrame, y: str = "total_enrolment", s: Series = DISTRICT) -> DataFrame:
    """Next row's value as target; rows without a successor are dropped."""
    name = f"target_{y.removeprefix('total_')}_next_month"
    return panel.withColumn(name, lead_col(s, y)).dropna(subset=[name])


def model_dataset(
    panel: DataFrame,
    measures: Sequence[str] = ("total_enrolment", "total_demo", "total_bio"),
    s: Series = DISTRICT,
) -> DataFrame:
    """Totals, next-month target, previous value and change per measure, calendar parts.

    The last month of every series is dropped before the lags are taken, the first one after.
    """
    df = add_next_month_target(add_totals(panel), s=s)
    prev = {f"{m}_prev_1": F.lag(m, 1).over(s.w) for m in measures}
    diff = {f"{m}_diff_1": F.col(m) - F.col(f"{m}_prev_1") for m in measures}
    parts = {"year": F.year(s.date), "month": F.month(s.date)}
    return df.withColumns(prev).withColumns(diff).withColumns(parts).dropna(subset=list(prev))
