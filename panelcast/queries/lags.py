"""Autocorrelation and lag selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.operators import lags as l
from panelcast.queries import tables as t
from panelcast.queries.registry import cte, joined, query

Y = "total_enrolment"

cte("centred", f"""SELECT state, district, {Y} - avg({Y}) OVER (PARTITION BY state, district) AS x,
  row_number() OVER (PARTITION BY state, district ORDER BY month_date) AS i, count(*) OVER (PARTITION BY state, district) AS n FROM panel_s""")
cte("acf_rows", """SELECT a.state, a.district, a.n, k, sum(a.x * b.x) AS p
  FROM centred a JOIN (SELECT unnest(range(13)) AS k) ON k <= least(12, a.n // 2 - 1)
  JOIN centred b ON a.state = b.state AND a.district = b.district AND b.i = a.i - k WHERE a.n >= 14 GROUP BY ALL""")
cte("acf_lists", "SELECT state, district, n AS n_obs, list(p / p0 ORDER BY k) AS r, max(k) AS m FROM (SELECT *, first_value(p) "
    "OVER (PARTITION BY state, district ORDER BY k) AS p0 FROM acf_rows) GROUP BY ALL")
cte("levinson", """SELECT state, district, n_obs, r, m, 1 AS k, [r[2]] AS phi, [1e0, r[2]] AS pacf FROM acf_lists
  UNION ALL SELECT state, district, n_obs, r, m, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - p * phi[k + 1 - j]), [p]),
    list_append(pacf, p) FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
      / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS p FROM levinson WHERE k < m)""")
cte("pacf_lists", "SELECT state, district, n_obs, r, pacf, m FROM levinson WHERE k = m")
cte("lag_scores", """SELECT * FROM (SELECT state, district, unnest(range(1, m + 1)) AS lag, greatest(abs(r[lag + 1]), abs(pacf[lag + 1])) AS w
  FROM pacf_lists) WHERE w >= 0.2""")
cte("lag_picks", """SELECT state, district, lag FROM (SELECT *, row_number() OVER (PARTITION BY state, district ORDER BY w DESC, lag) AS rn FROM lag_scores) WHERE rn <= 5""")
cte("lag_sets", """SELECT p.state, p.district, list_sort(CASE WHEN list_contains(s, 1) OR len(s) >= 5 THEN s ELSE list_append(s, 1) END) AS lags
  FROM pacf_lists p LEFT JOIN (SELECT state, district, list(CAST(lag AS INTEGER)) AS s FROM lag_picks GROUP BY ALL) q
  ON p.state = q.state AND p.district = q.district""")


@query("autocorrelations", "A23 A24", """SELECT state, district, n_obs, CAST(k - 1 AS INTEGER) AS lag, round(r[k], 6) + 0e0 AS acf,
  round(pacf[k], 6) + 0e0 AS pacf FROM (SELECT *, unnest(range(1, m + 2)) AS k FROM pacf_lists)""")
def _acf(spark: SparkSession, sf: str) -> DataFrame:
    both = l.pacf(l.acf(t.enrol_panel(spark, sf, True), Y))
    return both.selectExpr("state", "district", "n_obs", "posexplode(arrays_zip(acf, pacf)) AS (lag, v)").selectExpr(
        "state", "district", "n_obs", "lag", "round(v.acf, 6) + 0D AS acf", "round(v.pacf, 6) + 0D AS pacf")


@query("significant_lags", "A25", "SELECT state, district, array_to_string(CAST(lags AS VARCHAR[]), ',') AS lags FROM lag_sets")
def _significant(spark: SparkSession, sf: str) -> DataFrame:
    return joined(l.significant_lags(l.pacf(l.acf(t.enrol_panel(spark, sf, True), Y))).select("state", "district", "lags"))


@query("recommended_lags", "A26", """WITH v AS (SELECT lag, count(*) AS votes FROM (SELECT unnest(lags) AS lag FROM lag_sets) GROUP BY lag),
n AS (SELECT greatest(1, CAST(floor(count(*) * 0.4e0) AS BIGINT)) AS need FROM (SELECT DISTINCT state, district FROM panel_s)),
c AS (SELECT lag FROM v, n WHERE votes >= need),
u AS (SELECT lag FROM c WHERE (SELECT count(*) FROM c) >= 3 UNION SELECT * FROM (SELECT lag FROM v
  WHERE (SELECT count(*) FROM c) < 3 ORDER BY votes DESC, lag LIMIT 5) UNION SELECT 1)
SELECT array_to_string(CAST(list(lag ORDER BY lag) AS VARCHAR[]), ',') AS lags FROM u""")
def _recommended(spark: SparkSession, sf: str) -> DataFrame:
    return joined(l.recommended_lags(t.enrol_panel(spark, sf, True), Y))


@query("lag_votes", "A26", "SELECT lag, count(*) AS votes FROM (SELECT unnest(lags) AS lag FROM lag_sets) GROUP BY lag")
def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return l.lag_votes(l.significant_lags(l.pacf(l.acf(t.enrol_panel(spark, sf, True), Y))))
