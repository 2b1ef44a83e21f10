"""Capacity gaps of regions against their service centres."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.text import name_contains
from panelcast.operators.groups import lookup

# Defaults of the capacity model.
PER_CENTRE_CAPACITY = 5000
DEFAULT_CENTRES = 200
# Texts of the what-if recommendation.
GAP_CLOSED = "Adding %d centre(s) fully closes the gap. %s would have surplus capacity."
GAP_ACCEPTABLE = "Adding %d centre(s) reduces gap to acceptable level (<5%%). Recommended action."
GAP_REMAINS = "Gap remains at %.1f%%. Consider adding %d more centre(s) to fully close the gap."
NO_DATA = "No data available for %s in %s."


def month_or_latest(df: DataFrame, month: str | None, date: str = "month_date") -> DataFrame:
    """Rows of the requested month, or of the latest one when it has none."""
    key = F.date_format(date, "yyyy-MM")
    wanted = F.max(F.when(key == F.lit(month), F.trunc(date, "MM")))
    pick = df.agg(F.coalesce(wanted, F.max(F.trunc(date, "MM")))).scalar()
    return df.where(F.trunc(date, "MM") == pick)


def latest_month(df: DataFrame, date: str = "month_date") -> DataFrame:
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def with_centres(df: DataFrame, centres: DataFrame, default: int = DEFAULT_CENTRES) -> DataFrame:
    """Centre count of the state (columns state, centres), or the default."""
    return lookup(df, centres, ["state"], "centres", default)


def _steady(x: Column) -> Column:
    """Drop the last digits of a floating sum, which depend on the order of addition, before cutting or rounding up."""
    return F.round(x, 9)


def _whole(x: Column) -> Column:
    return _steady(x).cast("bigint")


def _extra(gap: Column, per_centre: float) -> Column:
    return F.greatest(F.ceil(_steady(gap / per_centre)), F.lit(0)).cast("bigint")


def state_needs(df: DataFrame, centres: DataFrame, pred: str = "yhat", per_centre: float = PER_CENTRE_CAPACITY,
                default: int = DEFAULT_CENTRES) -> DataFrame:
    """Latest month per state: forecast, capacity, gap and centres to add."""
    out = latest_month(df).groupBy("state").agg(F.sum(pred).alias("forecast"))
    out = with_centres(out, centres, default)
    out = out.withColumn("capacity", F.col("centres") * F.lit(float(per_centre)))
    out = out.withColumn("gap", F.col("forecast") - F.col("capacity"))
    return out.withColumn("extra_centres", _extra(F.col("gap"), per_centre))


def over_capacity_states(df: DataFrame, centres: DataFrame, month: str | None, top_k: int = 5, pred: str = "yhat",
                         per_centre: float = PER_CENTRE_CAPACITY, default: int = DEFAULT_CENTRES,
                         grain: Literal["row", "state"] = "row") -> DataFrame:
    """States over capacity in a month, largest gap first.

    ``grain="row"`` counts the state's centres once per district row, ``"state"`` once.  Rows are
    summed per state before the lookup, so no row is shuffled for the join.
    """
    sums = month_or_latest(df, month).groupBy("state").agg(F.sum(pred).alias("_f"), F.count(F.lit(1)).alias("_rows"))
    out = with_centres(sums, centres, default)
    seats = F.col("centres") * F.col("_rows") if grain == "row" else F.col("centres")
    out = out.withColumn("_c", seats * F.lit(float(per_centre)))
    out = out.withColumn("_gap", F.col("_f") - F.col("_c")).where("_gap > 0")
    out = out.orderBy(F.desc("_gap"), "state").limit(top_k)
    return out.select(
        "state",
        _whole(F.col("_f")).alias("forecast"),
        _whole(F.col("_c")).alias("capacity"),
        _whole(F.col("_gap")).alias("gap"),
        (F.col("_gap") / F.col("_c") * 100).alias("gap_pct"),
        _extra(F.col("_gap"), per_centre).alias("extra_centres"),
    )


def over_capacity_districts(df: DataFrame, centres: DataFrame, month: str | None, top_k: int = 5, pred: str = "yhat",
                            per_centre: float = PER_CENTRE_CAPACITY, default: int = DEFAULT_CENTRES) -> DataFrame:
    """Districts over their equal share of the state's capacity, largest gap in percent first."""
    key = F.date_format("month_date", "yyyy-MM")
    rows = df.where(key == F.lit(month)) if month else latest_month(df)
    share = rows.select("state", "district").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("_n"))
    share = with_centres(share, centres, default)
    share = share.select("state", (F.col("centres") * F.lit(float(per_centre)) / F.col("_n")).alias("_c"))
    rows = rows.join(share, "state")
    rows = rows.withColumn("_gap", F.col(pred) - F.col("_c")).withColumn("gap_pct", F.col("_gap") / F.col("_c") * 100)
    out = rows.where("_gap > 0").orderBy(F.desc("gap_pct"), "state", "district").limit(top_k)
    return out.select(
        "state",
        "district",
        _whole(F.col(pred)).alias("forecast"),
        _whole(F.col("_c")).alias("capacity"),
        _whole(F.col("_gap")).alias("gap"),
        "gap_pct",
        _extra(F.col("_gap"), per_centre).alias("extra_centres"),
    )


def needs_from_history(df: DataFrame, y: str = "y", pred: str = "yhat", per_centre: float = PER_CENTRE_CAPACITY) -> DataFrame:
    """Capacity inferred from the average month: whole centres (at least one), gap and centres to add."""
    months = df.agg(F.count_distinct(F.trunc("month_date", "MM"))).scalar()
    out = df.groupBy("state").agg(F.sum(y).alias("_y"), F.sum(pred).alias("_p"))
    out = out.select(
        "state",
        F.bround(_steady(F.col("_y") / months), 0).alias("actual_monthly_avg"),
        F.bround(_steady(F.col("_p") / months), 0).alias("forecast_monthly_avg"),
    )
    held = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("actual_monthly_avg") / per_centre))
    out = out.withColumn("current_centres", held)
    out = out.withColumn("current_capacity", F.col("current_centres") * F.lit(float(per_centre)))
    out = out.withColumn("gap", F.col("forecast_monthly_avg") - F.col("current_capacity"))
    return out.withColumns(
        {
            "gap_pct": F.bround(_steady(F.col("gap") / F.col("current_capacity") * 100), 1),
            "extra_centres": F.when(F.col("gap") > 0, _extra(F.col("gap"), per_centre)).otherwise(F.lit(0).cast("bigint")),
        }
    )


def what_if(df: DataFrame, centres: DataFrame, scenarios: Sequence[tuple[str, int, str | None]], pred: str = "yhat",
            per_centre: float = PER_CENTRE_CAPACITY, default: int = DEFAULT_CENTRES) -> DataFrame:
    """Effect of adding centres, many (region text, number, month) scenarios in one pass.

    Each row keeps the scenarios whose text occurs in its state or district name and whose month
    it belongs to (no month means the latest); the short scenario list travels as a literal.  One
    row for each scenario, numbered as listed: repeated ones are answered each by itself, one that
    matches nothing with zeros.
    """
    latest = df.agg(F.date_format(F.max("month_date"), "yyyy-MM")).scalar()
    listed = F.array(
        *[F.struct(F.lit(i).alias("scenario"), F.lit(r).alias("region"), F.lit(int(n)).alias("camps"), F.lit(m).cast("string").alias("month"))
          for i, (r, n, m) in enumerate(scenarios)]
    )
    key = F.date_format("month_date", "yyyy-MM")
    rows = df.withColumns({"_key": key, "_latest": latest})

    def concerns(s: Column) -> Column:
        place = name_contains("state", s["region"]) | name_contains("district", s["region"])
        return place & (F.col("_key") == F.coalesce(s["month"], F.col("_latest")))

    hits = rows.select(pred, "state", F.explode(F.filter(listed, concerns)["scenario"]).alias("_hit"))
    by_state = hits.groupBy("_hit", "state").agg(F.sum(pred).alias("_f"), F.count(F.lit(1)).alias("_rows"))
    sums = with_centres(by_state, centres, default).groupBy("_hit").agg(
        F.sum("_f").alias("_f"), (F.sum(F.col("centres") * F.col("_rows")) * F.lit(float(per_centre))).alias("_c")
    )
    asked = df.sparkSession.range(1).select(F.explode(listed).alias("s")).select("s.*")
    asked = asked.withColumn("month", F.coalesce("month", latest))
    added = F.col("camps") * F.lit(float(per_centre))
    sums = asked.join(sums, F.col("scenario") == F.col("_hit"), "left")
    sums = sums.withColumns({"_gap": F.col("_f") - F.col("_c"), "_cap": F.col("_c") + added})
    sums = sums.withColumn("_after", F.greatest(F.lit(0.0), F.col("_gap") - added))
    sums = sums.withColumn("gap_pct_after", F.when(F.col("_cap") > 0, F.col("_after") / F.col("_cap") * 100).otherwise(0.0))
    more = _extra(F.col("_after"), per_centre)
    advice = (
        F.when(F.col("_hit").isNull(), F.format_string(NO_DATA, "region", "month"))
        .when(F.col("_after") <= 0, F.format_string(GAP_CLOSED, "camps", "region"))
        .when(F.col("gap_pct_after") < 5, F.format_string(GAP_ACCEPTABLE, "camps"))
        .otherwise(F.format_string(GAP_REMAINS, "gap_pct_after", more))
    )

    def found(c: Column) -> Column:
        return F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(c)

    return sums.select(
        "scenario", "region", "month", "camps",
        found(_whole(F.col("_gap"))).alias("gap_before"),
        F.when(F.col("_c") > 0, F.col("_gap") / F.col("_c") * 100).otherwise(0.0).alias("gap_pct_before"),
        found(_whole(F.col("_after"))).alias("gap_after"),
        "gap_pct_after",
        advice.alias("recommendation"),
    )
