"""Exploratory aggregates, rankings, distinct values, parsing and quality checks on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import dates as d
from panelcast.functions import numbers as n
from panelcast.functions import text as x
from panelcast.operators import evaluate as e
from panelcast.operators import quality as q
from panelcast.operators import ranking as r
from panelcast.operators import summary as s
from panelcast.operators.capacity import latest_month, month_or_latest
from panelcast.operators.panel import model_dataset, monthly_sums
from panelcast.queries import tables as t
from panelcast.queries.registry import cte, query, rounded
from panelcast.session import cut_lineage

Y = "total_enrolment"
TOTALS = ("total_enrolment", "total_demo", "total_bio")
AGGS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}_sum, R[avg({m})] AS {m}_mean" for m in TOTALS)


@query("region_summary", "A2", f"SELECT state, {AGGS}, count(*) AS n_rows FROM panel GROUP BY state")
def _region(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.sum_and_mean(t.panel(spark, sf), ["state"], TOTALS))


@query("month_summary", "A3", f"SELECT month_date, {AGGS}, count(*) AS n_rows FROM panel GROUP BY month_date")
def _month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.sum_and_mean(t.panel(spark, sf), ["month_date"], TOTALS))


@query("region_month_rollup", "A3", f"""SELECT state, month_date, CAST(sum({Y}) AS BIGINT) AS total, R[avg({Y})] AS mean,
  count(*) AS n FROM panel_s GROUP BY ROLLUP (state, month_date)""")
def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.sums_by_levels(t.enrol_panel(spark, sf, True), "state", "month_date", Y))


@query("national_totals", "A4", "SELECT month_date, sum(y) AS y, R[sum(yhat)] AS yhat FROM forecast GROUP BY month_date")
def _national(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.forecast(spark, sf).groupBy("month_date").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat")))


@query("describe_lineitem", "A5", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, R[avg({c})] AS mean,
  R[stddev_samp({c})] AS std, R[min({c})] AS min, R[quantile_cont({c}, 0.25)] AS q25, R[quantile_cont({c}, 0.5)] AS q50,
  R[quantile_cont({c}, 0.75)] AS q75, R[max({c})] AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _describe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.describe(t.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("null_audit", "P23", f"""SELECT 'state' AS "column", CAST(0 AS BIGINT) AS nulls, 0e0 AS null_pct
  UNION ALL SELECT 'month_date', 0, 0e0 UNION ALL
  SELECT '{Y}', CAST(count_if({Y} IS NULL) AS BIGINT), R[count_if({Y} IS NULL) * 100e0 / count(*)] FROM gappy""")
def _nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.null_audit(t.gappy(spark, sf), ["state", "month_date", Y]))


@query("key_coverage", "P24 P10", """SELECT count(DISTINCT state) AS n_states, count(DISTINCT district) AS n_districts,
  count(DISTINCT (state, district)) AS n_pairs, count(DISTINCT month_date) AS n_months, min(month_date) AS first_month,
  max(month_date) AS last_month FROM panel_s""")
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return s.key_coverage(t.enrol_panel(spark, sf, True))


@query("share_of_total", "A10 T3", f"""SELECT district, CAST(sum({Y}) AS BIGINT) AS total,
  R[sum({Y}) * 100e0 / (SELECT sum({Y}) FROM panel_s)] AS coverage_pct FROM panel_s GROUP BY district
  ORDER BY total DESC, district LIMIT 10""")
def _share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.top_share(t.enrol_panel(spark, sf, True), "district", Y, 10))


@query("value_counts", "A28", """SELECT o_orderstatus, count(*) AS n, R[count(*) * 100e0 / (SELECT count(*) FROM orders)] AS pct
  FROM orders GROUP BY o_orderstatus""")
def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.value_counts(t.table(spark, sf, "orders"), "o_orderstatus"))


@query("sample_counts_by_state", "A27", """SELECT state, count(DISTINCT district) AS n_units, R[avg(abs(y - yhat))] AS mae,
  count(*) AS n_rows FROM forecast_s GROUP BY state ORDER BY n_rows DESC, state LIMIT 12""")
def _samples(spark: SparkSession, sf: str) -> DataFrame:
    out = e.group_accuracy(t.forecast(spark, sf, True), ["state"]).select("state", "n_units", "mae", "n_rows")
    return rounded(out.orderBy(F.desc("n_rows"), "state").limit(12))


@query("largest_states", "A29 J8", f"""SELECT p.* FROM panel_s p WHERE state IN (SELECT state FROM panel_s GROUP BY state
  ORDER BY count(DISTINCT district) DESC, state LIMIT 2)""")
def _largest(spark: SparkSession, sf: str) -> DataFrame:
    return e.largest_groups(cut_lineage(t.enrol_panel(spark, sf, True)), "state", "district", 2)


@query("groups_with_min_rows", "P20", """SELECT state, district, count(*) AS n_rows FROM panel_s GROUP BY ALL HAVING count(*) >= 60""")
def _min_rows(spark: SparkSession, sf: str) -> DataFrame:
    return s.groups_with_at_least(t.enrol_panel(spark, sf, True), ["state", "district"], 60)


@query("largest_and_smallest", "T3", f"""SELECT * FROM (SELECT *, 'largest' AS side FROM panel_s ORDER BY {Y} DESC, state, district,
  month_date LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'smallest' AS side FROM panel_s ORDER BY {Y}, state, district, month_date LIMIT 10)""")
def _extremes(spark: SparkSession, sf: str) -> DataFrame:
    df, ties = t.enrol_panel(spark, sf, True), ["state", "district", "month_date"]
    return r.top_k(df, F.desc(Y), ties, 10).withColumn("side", F.lit("largest")).unionByName(
        r.top_k(df, F.asc(Y), ties, 10).withColumn("side", F.lit("smallest")))


@query("worst_districts_per_state", "T5 P22", """SELECT state, district, R[mae] AS mae, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(mae, 9) DESC, district) AS rank
  FROM (SELECT state, district, avg(abs(y - yhat)) AS mae FROM forecast_s GROUP BY ALL)) WHERE rank <= 3""")
def _worst(spark: SparkSession, sf: str) -> DataFrame:
    errors = t.forecast(spark, sf, True).groupBy("state", "district").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    return rounded(r.top_k_per_group(errors, ["state"], F.round("mae", 9).desc(), ["district"], 3))


@query("keep_first_duplicate", "T2", """SELECT o_custkey, month_date, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_date, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _first(spark: SparkSession, sf: str) -> DataFrame:
    df = t.table(spark, sf, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "MM").alias("month_date"),
                                             "o_orderkey", "o_totalprice")
    return r.keep_first(df, ["o_custkey", "month_date"], ["o_orderkey"])


@query("global_positions", "T1 D1", """SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS BIGINT) AS position FROM lineitem""")
def _positions(spark: SparkSession, sf: str) -> DataFrame:
    df = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate")
    ranked = r.global_position(df, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return ranked.drop("l_partkey", "l_suppkey", "l_shipdate")


@query("distinct_pairs", "U3", "SELECT DISTINCT state, district FROM panel_s")
def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return t.enrol_panel(spark, sf, True).select("state", "district").distinct()


@query("union_of_parts", "U1", """SELECT * FROM month_a WHERE year(month_date) < 1998 UNION ALL
  SELECT * FROM month_a WHERE year(month_date) >= 1998""")
def _parts(spark: SparkSession, sf: str) -> DataFrame:
    fact = t.enrolment(spark, sf)
    parts = fact.where("year(date) < 1998").unionByName(fact.where("year(date) >= 1998"))
    return monthly_sums(parts, t.ENROL)


@query("one_series", "P16", f"SELECT * FROM panel_s WHERE state = 'ASIA' AND district LIKE 'NATION\\_%/BUILDING' ESCAPE '\\' ORDER BY district, month_date")
def _one(spark: SparkSession, sf: str) -> DataFrame:
    df = t.enrol_panel(spark, sf, True)
    return df.where((F.col("state") == "ASIA") & F.col("district").like("NATION\\_%/BUILDING")).orderBy("district", "month_date")


@query("region_text_filter", "P18 F13", "SELECT * FROM panel_s WHERE contains(lower(state), 'a.') OR contains(lower(district), 'nation_1')")
def _region_text(spark: SparkSession, sf: str) -> DataFrame:
    hit = x.name_contains("state", F.lit("A.")) | x.name_contains("district", F.lit("Nation_1"))
    return t.enrol_panel(spark, sf, True).where(hit)


@query("latest_month_rows", "P19", "SELECT * FROM panel_s WHERE month_date = (SELECT max(month_date) FROM panel_s)")
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest_month(t.enrol_panel(spark, sf, True))


@query("month_or_latest", "P17", """SELECT 'asked' AS part, * FROM panel_s WHERE month_date = DATE '1997-05-01' UNION ALL
  SELECT 'fallback', * FROM panel_s WHERE month_date = (SELECT max(month_date) FROM panel_s)""")
def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    df = t.enrol_panel(spark, sf, True)
    asked = month_or_latest(df, "1997-05").select(F.lit("asked").alias("part"), "*")
    return asked.unionByName(month_or_latest(df, "2031-01").select(F.lit("fallback").alias("part"), "*"))


@query("actual_and_forecast_long", "P21 P8", """SELECT state, district, month_date, 'Actual' AS type, y AS value FROM forecast
  UNION ALL SELECT state, district, month_date, 'Forecast', R[yhat] FROM forecast""")
def _long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.to_long(t.forecast(spark, sf), ["state", "district", "month_date"], {"y": "Actual", "yhat": "Forecast"}))


@query("mape_grid", "P22", "SELECT state, " + ", ".join(
    f"R[avg(CASE WHEN month(month_date) = {k} THEN abs(y - yhat) / abs(y) END) * 100] AS m{k:02d}" for k in range(1, 13))
    + " FROM forecast_s GROUP BY state")
def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.mape_grid(t.forecast(spark, sf, True), range(1, 13)))


_PLACES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _by_place(value: str) -> str:
    return ", ".join(f"""CAST({value} FILTER (state = '{p}') AS BIGINT) AS "{p}\"""" for p in _PLACES)


@query("transposed_totals", "P22", f"""SELECT 'total' AS measure, {_by_place(f"sum({Y})")} FROM panel_n
  UNION ALL SELECT 'n', {_by_place("count(*)")} FROM panel_n""")
def _transposed(spark: SparkSession, sf: str) -> DataFrame:
    sums = t.enrol_panel(spark, sf).groupBy("state").agg(F.sum(Y).alias("total"), F.count(F.lit(1)).alias("n"))
    return s.transposed(sums, "measure", ["total", "n"], _PLACES, "state")


@query("worst_district_pivot", "P22 T5", """WITH m AS (SELECT state, district, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(mae, 9) DESC, district) AS rank
  FROM (SELECT state, district, avg(abs(y - yhat)) AS mae FROM forecast_s GROUP BY ALL)) WHERE rank <= 3)
SELECT f.state, strftime(f.month_date, '%Y-%m') AS month, R[max(abs(y - yhat)) FILTER (rank = 1)] AS worst_1,
  R[max(abs(y - yhat)) FILTER (rank = 2)] AS worst_2, R[max(abs(y - yhat)) FILTER (rank = 3)] AS worst_3
FROM forecast_s f JOIN m USING (state, district) GROUP BY ALL""")
def _worst_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly errors of the three worst districts of every state, one column each."""
    df = t.forecast_table(spark, sf, True).withColumn("error", F.abs(F.col("y") - F.col("yhat")))
    mae = df.groupBy("state", "district").agg(F.avg("error").alias("mae"))
    worst = r.top_k_per_group(mae, ["state"], F.round("mae", 9).desc(), ["district"], 3)
    rows = df.join(worst.select("state", "district", "rank"), ["state", "district"])
    month = F.date_format("month_date", "yyyy-MM").alias("month")
    out = rows.groupBy("state", month).pivot("rank", [1, 2, 3]).agg(F.max("error"))
    return rounded(out.withColumnsRenamed({str(k): f"worst_{k}" for k in (1, 2, 3)}))


cte("dates_dirty", """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'n/a ' || o_orderkey ELSE strftime(o_orderdate, '%d-%m-%Y') END
  AS date_text, CASE WHEN o_orderkey % 97 = 0 THEN 'many' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS count_text FROM orders""")


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    o, key = t.table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.date_format(F.to_date("o_orderdate"), "dd-MM-yyyy")
    return o.select("o_orderkey", F.when(key % 101 == 0, F.concat(F.lit("n/a "), key.cast("string"))).otherwise(day).alias("date_text"),
                    F.when(key % 97 == 0, "many").otherwise((key % 50).cast("string")).alias("count_text"))


@query("strict_date_parse", "P1 P4", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month_date FROM orders""")
def _strict(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders").select("o_orderkey", F.date_format(F.to_date("o_orderdate"), "dd-MM-yyyy").alias("date_text"))
    o = o.withColumn("date", d.strict_date("date_text")).withColumn("ym", d.month_key("date"))
    return o.select("o_orderkey", "date", d.month_start("ym").alias("month_date"))


@query("lenient_parse", "P2 P5", """SELECT o_orderkey, CAST(try_strptime(date_text, '%d-%m-%Y') AS DATE) AS date,
  coalesce(TRY_CAST(count_text AS BIGINT), 0) AS n FROM dates_dirty WHERE try_strptime(date_text, '%d-%m-%Y') IS NOT NULL""")
def _lenient(spark: SparkSession, sf: str) -> DataFrame:
    df = _dirty(spark, sf).withColumns({"date": d.lenient_date("date_text"), "n": n.lenient_long("count_text")})
    return df.where("date is not null").select("o_orderkey", "date", "n")


NAMES = {"ASIA PACIFIC": "ASIA", "AM.": "AMERICA", "MID EAST": "MIDDLE EAST"}
cte("names_dirty", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN lower(state) WHEN o_orderkey % 7 = 2 THEN '  ' || state || ' '
  WHEN o_orderkey % 7 = 3 AND state = 'ASIA' THEN 'Asia  Pacific' WHEN o_orderkey % 7 = 3 AND state = 'AMERICA' THEN 'Am.'
  WHEN o_orderkey % 7 = 4 AND state = 'MIDDLE EAST' THEN 'Mid East' ELSE state END AS name FROM orders JOIN cust ON o_custkey = c_custkey""")
cte("names_clean", """SELECT o_orderkey, name, CASE c WHEN 'ASIA PACIFIC' THEN 'ASIA' WHEN 'AM.' THEN 'AMERICA'
  WHEN 'MID EAST' THEN 'MIDDLE EAST' ELSE c END AS canonical
  FROM (SELECT *, regexp_replace(trim(upper(name)), '\\s+', ' ', 'g') AS c FROM names_dirty)""")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    key, state = F.col("o_orderkey") % 7, F.col("state")
    name = (
        F.when(key == 1, F.lower(state)).when(key == 2, F.concat(F.lit("  "), state, F.lit(" ")))
        .when((key == 3) & (state == "ASIA"), "Asia  Pacific").when((key == 3) & (state == "AMERICA"), "Am.")
        .when((key == 4) & (state == "MIDDLE EAST"), "Mid East").otherwise(state)
    )
    j = o.join(t.customers(spark, sf, False), F.col("o_custkey") == F.col("c_custkey"))
    return x.canonical_names(j.select("o_orderkey", name.alias("name")), "name", NAMES)


@query("canonical_names", "P25 P6", "SELECT * FROM names_clean")
def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf)


@query("name_change_report", "P25", """SELECT name, canonical, count(*) AS rows_changed FROM names_clean WHERE name <> canonical GROUP BY ALL""")
def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return x.name_change_report(_names(spark, sf), "name")


@query("composite_keys", "F14 F13 P6", """SELECT o_orderkey, state || '_' || district AS group_id, trim('  ' || lower(district) || ' ') AS clean
  FROM orders JOIN cust ON o_custkey = c_custkey""")
def _keys(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(t.customers(spark, sf, False), F.col("o_custkey") == F.col("c_custkey"))
    j = j.withColumn("padded", F.concat(F.lit("  "), F.lower("district"), F.lit(" ")))
    return j.select("o_orderkey", x.composite_key("state", "district").alias("group_id"), x.trimmed("padded").alias("clean"))


@query("quality_report", "P9 P10 P11 P13", f"""SELECT count(*) AS n_rows, count(DISTINCT month_date) AS n_months,
  CAST(count_if({Y} IS NULL) AS BIGINT) AS null_targets, CAST(0 AS BIGINT) AS negative_targets,
  CAST(0 AS BIGINT) AS rows_with_null_features, true AS target_is_numeric FROM gappy""")
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return q.quality_report(q.require_columns(t.gappy(spark, sf), ["state", "district", Y]), Y, "month_date")


@query("feature_projection", "P14 P12 C9", f"""SELECT state, district, month_date, age_0_5, age_5_17, age_18_greater, demo_age_5_17,
  demo_age_17_, bio_age_5_17, bio_age_17_, total_demo, total_bio, total_enrolment, total_enrolment_prev_1, total_demo_prev_1,
  total_bio_prev_1, year, month, target_enrolment_next_month
  FROM (SELECT * FROM (
    SELECT *, lag(total_enrolment) OVER w AS total_enrolment_prev_1, lag(total_demo) OVER w AS total_demo_prev_1,
      lag(total_bio) OVER w AS total_bio_prev_1, CAST(year(month_date) AS INTEGER) AS year, CAST(month(month_date) AS INTEGER) AS month
    FROM (SELECT *, lead(total_enrolment) OVER (PARTITION BY state, district ORDER BY month_date)
            AS target_enrolment_next_month FROM panel)
    WHERE target_enrolment_next_month IS NOT NULL WINDOW w AS (PARTITION BY state, district ORDER BY month_date))
  WHERE total_enrolment_prev_1 IS NOT NULL)""")
def _projection(spark: SparkSession, sf: str) -> DataFrame:
    df = model_dataset(t.panel(spark, sf))
    target = "target_enrolment_next_month"
    numeric, _ = q.feature_list(df, target, "month_date")
    return df.select("state", "district", "month_date", *numeric, target)


MESSAGES = {
    0: ("Which states are over capacity in ", "ym", "?"),
    1: ("What if we add 12 centres in ", "state", " next year"),
    2: ("Please export the table of ", "state", ""),
    3: ("Explain the chart of ", "state", ""),
    4: ("Status of enrolment id ", "key", ""),
    5: ("Good morning from ", "district", ""),
    6: ("Simulate 7 camps for ", "state", " in 2024-13"),
}
cte("messages", "SELECT o_orderkey, CASE o_orderkey % 7 " + " ".join(
    f"WHEN {k} THEN '{a}' || " + {"ym": "strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m')", "key": "CAST(o_orderkey AS VARCHAR)"}.get(c, c)
    + f" || '{z}'" for k, (a, c, z) in MESSAGES.items()) + " END AS message FROM orders JOIN cust ON o_custkey = c_custkey")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderkey").cast("string").alias("key"),
        d.month_key(F.add_months(F.to_date("o_orderdate"), 300)).alias("ym"))
    j = o.join(t.customers(spark, sf, False), F.col("o_custkey") == F.col("c_custkey"))
    texts = F.array(*[F.concat(F.lit(a), F.col(c), F.lit(z)) for a, c, z in MESSAGES.values()])
    return j.select("o_orderkey", texts[(F.col("o_orderkey") % 7).cast("int")].alias("message"))


_TRIAGE = f"""SELECT o_orderkey, message, CASE
  WHEN regexp_matches(message, '{x.SENSITIVE_PATTERN}') THEN 'unsafe_personal'
  WHEN regexp_matches(lower(message), '{x.EXPORT_PATTERN}') THEN 'raw_export'
  WHEN regexp_matches(lower(message), '{"|".join(x.OVER_CAPACITY_WORDS)}') THEN 'over_capacity'
  WHEN regexp_matches(lower(message), '{"|".join(x.SIMULATION_WORDS)}') THEN 'simulate'
  WHEN regexp_matches(lower(message), '{"|".join(x.EXPLAIN_WORDS)}') THEN 'explain_dashboard'
  ELSE 'unsupported' END AS intent,
  nullif(regexp_extract(message, '{x.MONTH_PATTERN}'), '') AS asked_month,
  greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(message, '{x.NUMBER_PATTERN}'), '') AS BIGINT), 1)) AS asked_camps,
  CASE WHEN contains(lower(message), 'africa') THEN 'AFRICA' WHEN contains(lower(message), 'america') THEN 'AMERICA'
    WHEN contains(lower(message), 'asia') THEN 'ASIA' WHEN contains(lower(message), 'europe') THEN 'EUROPE'
    WHEN contains(lower(message), 'middle east') THEN 'MIDDLE EAST' END AS asked_region FROM messages"""


@query("message_triage", "F19", _TRIAGE)
def _triage(spark: SparkSession, sf: str) -> DataFrame:
    return x.triage(_messages(spark, sf), "message", REGIONS)


@query("intent_counts", "F19 A28", f"SELECT intent, count(*) AS n, R[count(*) * 100e0 / (SELECT count(*) FROM orders)] AS pct FROM ({_TRIAGE}) GROUP BY intent")
def _intents(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(e.value_counts(x.triage(_messages(spark, sf), "message", REGIONS), "intent"))
