"""Capacity gaps on the forecast table; centres are the suppliers of a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import capacity as c
from panelcast.queries import tables as t
from panelcast.queries.registry import cte, query, rounded

cte("centres", """SELECT r_name AS state, count(*) AS centres FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' GROUP BY r_name""")
cte("seats", "SELECT f.*, coalesce(centres, 20) AS centres FROM forecast f LEFT JOIN centres USING (state)")


def _centres(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers per region; one region is left to the default."""
    s = t.table(spark, sf, "supplier").select("s_nationkey")
    where = s.join(t.regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).where("state <> 'EUROPE'")
    return where.groupBy("state").agg(F.count(F.lit(1)).alias("centres"))


@query("centre_lookup", "J5", "SELECT state, district, month_date, y, R[yhat] AS yhat, yhat2, centres FROM seats")
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.with_centres(t.forecast(spark, sf), _centres(spark, sf), 20))


@query("state_capacity_needs", "A17 P19 J5", """
SELECT state, R[f] AS forecast, n AS centres, R[n * 1.5] AS capacity, R[f - n * 1.5] AS gap,
  CAST(greatest(ceil(round((f - n * 1.5) / 1.5, 9)), 0) AS BIGINT) AS extra_centres
FROM (SELECT state, sum(yhat) AS f, max(centres) AS n FROM seats WHERE month_date = (SELECT max(month_date) FROM forecast) GROUP BY state)""")
def _needs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.state_needs(t.forecast_table(spark, sf), _centres(spark, sf), per_centre=1.5, default=20))


def _over(seats: str) -> str:
    return f"""SELECT state, CAST(trunc(round(f, 9)) AS BIGINT) AS forecast, CAST(trunc(round(cap, 9)) AS BIGINT) AS capacity, CAST(trunc(round(f - cap, 9)) AS BIGINT) AS gap,
  R[(f - cap) / cap * 100] AS gap_pct, CAST(ceil(round((f - cap) / 0.25, 9)) AS BIGINT) AS extra_centres
FROM (SELECT state, sum(yhat) AS f, {seats}(centres) * 0.25 AS cap FROM seats WHERE month_date = DATE '1998-03-01' GROUP BY state)
WHERE f > cap ORDER BY f - cap DESC, state LIMIT 4"""


@query("over_capacity_states", "A18 P17 T4", _over("sum"))
def _states(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.over_capacity_states(t.forecast_table(spark, sf), _centres(spark, sf), "1998-03", 4, per_centre=0.25, default=20))


@query("over_capacity_states_once", "A18 P17 T4", _over("max"))
def _states_once(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.over_capacity_states(t.forecast_table(spark, sf), _centres(spark, sf), "1998-03", 4, per_centre=0.25,
                                          default=20, grain="state"))


@query("over_capacity_districts", "A19 J10 T4", """
SELECT state, district, CAST(trunc(round(yhat, 9)) AS BIGINT) AS forecast, CAST(trunc(round(cap, 9)) AS BIGINT) AS capacity, CAST(trunc(round(yhat - cap, 9)) AS BIGINT) AS gap,
  R[(yhat - cap) / cap * 100] AS gap_pct, CAST(ceil(round(yhat - cap, 9)) AS BIGINT) AS extra_centres
FROM (SELECT s.*, centres * 1.0 / n AS cap FROM seats s JOIN (SELECT state, count(DISTINCT district) AS n FROM seats
    WHERE month_date = DATE '1998-03-01' GROUP BY state) USING (state) WHERE month_date = DATE '1998-03-01')
WHERE yhat > cap ORDER BY (yhat - cap) / cap DESC, state, district LIMIT 8""")
def _districts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.over_capacity_districts(t.forecast_table(spark, sf), _centres(spark, sf), "1998-03", 8, per_centre=1.0, default=20))


@query("capacity_from_history", "A20 F11", """
SELECT state, a AS actual_monthly_avg, p AS forecast_monthly_avg, n AS current_centres, n * 5e0 AS current_capacity, p - n * 5 AS gap,
  CAST(round_even(round((p - n * 5) / (n * 5) * 100, 9), 1) AS DOUBLE) AS gap_pct,
  CASE WHEN p - n * 5 > 0 THEN CAST(ceil(round((p - n * 5) / 5, 9)) AS BIGINT) ELSE 0 END AS extra_centres
FROM (SELECT *, CAST(greatest(1, floor(a / 5)) AS BIGINT) AS n FROM (
  SELECT state, round_even(round(sum(y) / (SELECT count(DISTINCT month_date) FROM forecast), 9), 0) AS a,
    round_even(round(sum(yhat) / (SELECT count(DISTINCT month_date) FROM forecast), 9), 0) AS p FROM forecast GROUP BY state))""")
def _history(spark: SparkSession, sf: str) -> DataFrame:
    return c.needs_from_history(t.forecast_table(spark, sf), per_centre=5)


_SCENARIOS = (
    ("asia", 3, "1998-03"), ("NATION_1", 5, "1998-03"), ("Africa", 1, None), ("america", 400, "1998-03"), ("nowhere", 2, None),
    ("asia", 3, "1998-03"), ("asia", 3, None), ("europe", 1, "1888-01"),
)


@query("what_if_scenarios", "A21 P18 J9", """
WITH s(scenario, region, camps, month) AS (VALUES (0, 'asia', 3, '1998-03'), (1, 'NATION_1', 5, '1998-03'), (2, 'Africa', 1, NULL),
  (3, 'america', 400, '1998-03'), (4, 'nowhere', 2, NULL), (5, 'asia', 3, '1998-03'), (6, 'asia', 3, NULL), (7, 'europe', 1, '1888-01')),
q AS (SELECT scenario, region, camps, coalesce(month, (SELECT strftime(max(month_date), '%Y-%m') FROM forecast)) AS month FROM s),
g AS (SELECT scenario, sum(yhat) AS f, sum(centres) * 0.25 AS c FROM seats JOIN q
  ON (contains(lower(state), lower(region)) OR contains(lower(district), lower(region)))
  AND strftime(month_date, '%Y-%m') = month GROUP BY ALL),
r AS (SELECT q.*, f, c, greatest(0, f - c - camps * 0.25) AS after, greatest(0, f - c - camps * 0.25) / (c + camps * 0.25) * 100 AS pct
  FROM q LEFT JOIN g USING (scenario))
SELECT scenario, region, month, camps, coalesce(CAST(trunc(round(f - c, 9)) AS BIGINT), 0) AS gap_before,
  CASE WHEN c IS NULL THEN 0.0 ELSE R[(f - c) / c * 100] END AS gap_pct_before,
  CASE WHEN c IS NULL THEN 0 ELSE CAST(trunc(round(after, 9)) AS BIGINT) END AS gap_after, CASE WHEN c IS NULL THEN 0.0 ELSE R[pct] END AS gap_pct_after,
  CASE WHEN c IS NULL THEN 'No data available for ' || region || ' in ' || month || '.'
    WHEN after <= 0 THEN 'Adding ' || camps || ' centre(s) fully closes the gap. ' || region || ' would have surplus capacity.'
    WHEN pct < 5 THEN 'Adding ' || camps || ' centre(s) reduces gap to acceptable level (<5%). Recommended action.'
    ELSE 'Gap remains at ' || format('{:.1f}', pct) || '%. Consider adding ' || CAST(ceil(round(after / 0.25, 9)) AS BIGINT)
      || ' more centre(s) to fully close the gap.' END AS recommendation FROM r""")
def _what_if(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.what_if(t.forecast_table(spark, sf), _centres(spark, sf), _SCENARIOS, per_centre=0.25, default=20))
