"""The given tables cast into the roles of the panel: three count facts and what follows from them.

State is the region, district the nation (optionally split by market segment).  Customers have
almost as many order days as orders, so summing by customer and day first would move all rows once
more for nothing: the narrow projection meets its dimension directly and is summed once, to nation
and day, with partial sums on the map side.  A customer or order with a large share of the rows
skews one side of an equi-join only, which adaptive execution splits.  Suppliers do repeat within a
day and a month; their lines are summed before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.panel import add_totals, join_facts, monthly_sums
from panelcast.operators.series import DISTRICT, densify_months
from panelcast.queries.registry import cte
from panelcast.session import cut_lineage

ENROL = ("age_0_5", "age_5_17", "age_18_greater")
DEMO = ("demo_age_5_17", "demo_age_17_")
BIO = ("bio_age_5_17", "bio_age_17_")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _n(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Nation and region names: 25 rows at every scale factor, hence broadcast."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    names = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return F.broadcast(names.select("n_nationkey", F.col("r_name").alias("state"), F.col("n_name").alias("nation")))


def customers(spark: SparkSession, sf: str, by_segment: bool) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = c.join(regions(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    district = F.concat_ws("/", "nation", "c_mktsegment") if by_segment else F.col("nation")
    return c.select("c_custkey", "state", district.alias("district"))


def _ones(cond: Column, name: str) -> Column:
    return cond.cast("bigint").alias(name)


def _daily(rows: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Rows of 0 / 1 bands summed to (state, district, date): at most nations x days rows."""
    return rows.groupBy("state", "district", "date").agg(*[F.sum(b).alias(b) for b in bands])


def enrolment(spark: SparkSession, sf: str, by_segment: bool = False, summed: bool = True) -> DataFrame:
    """Daily order counts in three priority bands; not ``summed``, the rows for a coarser sum to take up."""
    level = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.to_date("o_orderdate").alias("date"),
        _ones(level.isin("1", "2"), ENROL[0]),
        _ones(level == "3", ENROL[1]),
        _ones(~level.isin("1", "2", "3"), ENROL[2]),
    )
    placed = rows.join(customers(spark, sf, by_segment), F.col("o_custkey") == F.col("c_custkey")).select("state", "district", "date", *ENROL)
    return _daily(placed, ENROL) if summed else placed


def demographic(spark: SparkSession, sf: str, summed: bool = True) -> DataFrame:
    """Daily line counts in two status bands, placed by customer.

    Orders meet their customer first, so lineitem, the largest table, moves once.
    """
    final = F.col("l_linestatus") == "F"
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("date"), _ones(final, DEMO[0]), _ones(~final, DEMO[1])
    )
    owner = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    owner = owner.join(customers(spark, sf, False), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "state", "district")
    placed = lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select("state", "district", "date", *DEMO)
    return _daily(placed, DEMO) if summed else placed


def biometric(spark: SparkSession, sf: str, summed: bool = True) -> DataFrame:
    """Daily line counts in two quantity bands, placed by supplier; not ``summed``, months of each supplier."""
    date = F.to_date("l_shipdate") if summed else F.trunc("l_shipdate", "MM")
    entity = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", date.alias("date"))
        .agg(_n(F.col("l_quantity") <= 25, BIO[0]), _n(F.col("l_quantity") > 25, BIO[1]))
    )
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    where = s.join(regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    placed = entity.join(where, F.col("l_suppkey") == F.col("s_suppkey")).select("state", F.col("nation").alias("district"), "date", *BIO)
    return _daily(placed, BIO) if summed else placed


def monthly(spark: SparkSession, sf: str, by_segment: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three facts by (state, district, month), each summed once."""
    return (
        monthly_sums(enrolment(spark, sf, by_segment, summed=False), ENROL),
        monthly_sums(demographic(spark, sf, summed=False), DEMO),
        monthly_sums(biometric(spark, sf, summed=False), BIO),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Nation x month panel of all three facts."""
    return add_totals(join_facts(*monthly(spark, sf)))


def enrol_panel(spark: SparkSession, sf: str, by_segment: bool = False) -> DataFrame:
    """Enrolment alone by month: district is the nation or the nation's market segment."""
    return add_totals(monthly(spark, sf, by_segment)[0]).drop(*ENROL)


def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    """The panel materialized for operators that read their input more than once."""
    return cut_lineage(panel(spark, sf))


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Segment panel on the full calendar: an absent month is a null.

    Densifying reads the panel for its ends, its keys and its values, so it is materialized first.
    """
    return densify_months(cut_lineage(enrol_panel(spark, sf, True)), ["state", "district"])


def spiky(spark: SparkSession, sf: str) -> DataFrame:
    """Nation panel where every 37th (month, nation) cell is ten times too high."""
    at = F.year("month_date") * 12 + F.month("month_date")
    key = F.regexp_extract("district", r"(\d+)$", 1).cast("int")
    spike = F.when((at * 5 + key) % 37 == 0, 10).otherwise(1)
    return enrol_panel(spark, sf).withColumn("total_enrolment", F.col("total_enrolment") * spike)


def gappy_spiky(spark: SparkSession, sf: str) -> DataFrame:
    """Segment panel with natural gaps and every 37th month of a series ten times too high."""
    at = F.year("month_date") * 12 + F.month("month_date")
    key = F.regexp_extract("district", r"_(\d+)/", 1).cast("int") + F.length("district")
    spike = F.when((at * 5 + key) % 37 == 0, 10).otherwise(1)
    return gappy(spark, sf).withColumn("total_enrolment", F.col("total_enrolment") * spike)


def forecast(spark: SparkSession, sf: str, by_segment: bool = False) -> DataFrame:
    """Two model-free forecasts: mean of the past three rows, and the last row."""
    s = DISTRICT
    return (
        enrol_panel(spark, sf, by_segment)
        .select(
            "state",
            "district",
            "month_date",
            F.col("total_enrolment").cast("double").alias("y"),
            F.avg("total_enrolment").over(s.prev(3)).alias("yhat"),
            F.lag("total_enrolment", 1).over(s.w).cast("double").alias("yhat2"),
        )
        .where("yhat is not null")
    )


def forecast_table(spark: SparkSession, sf: str, by_segment: bool = False) -> DataFrame:
    """The forecasts materialized for operators that read their input more than once."""
    return cut_lineage(forecast(spark, sf, by_segment))


cte(
    "cust",
    """SELECT c_custkey, r_name AS state, n_name AS district, n_name || '/' || c_mktsegment AS segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "daily_a",
    """SELECT state, district, segment, CAST(o_orderdate AS DATE) AS date,
      CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1 ELSE 0 END AS age_0_5,
      CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 1 ELSE 0 END AS age_5_17,
      CASE WHEN substr(o_orderpriority, 1, 1) NOT IN ('1', '2', '3') THEN 1 ELSE 0 END AS age_18_greater
    FROM orders JOIN cust ON o_custkey = c_custkey""",
)
cte(
    "daily_b",
    """SELECT state, district, CAST(l_shipdate AS DATE) AS date,
      CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS demo_age_5_17,
      CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END AS demo_age_17_
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey""",
)
cte(
    "daily_c",
    """SELECT r_name AS state, n_name AS district, CAST(l_shipdate AS DATE) AS date,
      CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END AS bio_age_5_17,
      CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS bio_age_17_
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
)
for _name, _bands in (("a", ENROL), ("b", DEMO), ("c", BIO)):
    _sums = ", ".join(f"CAST(sum({b}) AS BIGINT) AS {b}" for b in _bands)
    cte(
        f"month_{_name}",
        f"""SELECT state, district, CAST(date_trunc('month', date) AS DATE) AS month_date, {_sums}
    FROM daily_{_name} GROUP BY ALL""",
    )
cte(
    "panel",
    """SELECT a.state, a.district, a.month_date, age_0_5, age_5_17, age_18_greater, demo_age_5_17, demo_age_17_,
      bio_age_5_17, bio_age_17_, strftime(a.month_date, '%Y-%m') AS year_month,
      age_0_5 + age_5_17 + age_18_greater AS total_enrolment, demo_age_5_17 + demo_age_17_ AS total_demo,
      bio_age_5_17 + bio_age_17_ AS total_bio
    FROM month_a a JOIN month_b b ON a.state = b.state AND a.district = b.district AND a.month_date = b.month_date
    JOIN month_c c ON a.state = c.state AND a.district = c.district AND a.month_date = c.month_date""",
)
cte(
    "panel_n",
    "SELECT state, district, month_date, age_0_5 + age_5_17 + age_18_greater AS total_enrolment FROM month_a",
)
cte(
    "panel_s",
    """SELECT state, segment AS district, CAST(date_trunc('month', date) AS DATE) AS month_date,
      CAST(count(*) AS BIGINT) AS total_enrolment FROM daily_a GROUP BY ALL""",
)
cte(
    "gappy",
    """SELECT k.state, k.district, m.month_date, p.total_enrolment
    FROM (SELECT DISTINCT state, district FROM panel_s) k
    CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(month_date) FROM panel_s),
      (SELECT max(month_date) FROM panel_s), INTERVAL 1 MONTH)) AS DATE) AS month_date) m
    LEFT JOIN panel_s p ON p.state = k.state AND p.district = k.district AND p.month_date = m.month_date""",
)
cte(
    "spiky",
    """SELECT state, district, month_date, total_enrolment * CASE WHEN ((year(month_date) * 12 + month(month_date)) * 5
      + CAST(regexp_extract(district, '(\\d+)$', 1) AS INTEGER)) % 37 = 0 THEN 10 ELSE 1 END AS total_enrolment
    FROM panel_n""",
)
cte(
    "gappy_spiky",
    """SELECT state, district, month_date, total_enrolment * CASE WHEN ((year(month_date) * 12 + month(month_date)) * 5
      + CAST(regexp_extract(district, '_(\\d+)/', 1) AS INTEGER) + length(district)) % 37 = 0
      THEN 10 ELSE 1 END AS total_enrolment FROM gappy""",
)
for _name, _from in (("forecast", "panel_n"), ("forecast_s", "panel_s")):
    cte(
        _name,
        f"""SELECT * FROM (SELECT state, district, month_date, CAST(total_enrolment AS DOUBLE) AS y,
      avg(total_enrolment) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS yhat,
      CAST(lag(total_enrolment) OVER w AS DOUBLE) AS yhat2
    FROM {_from} WINDOW w AS (PARTITION BY state, district ORDER BY month_date)) WHERE yhat IS NOT NULL""",
    )
