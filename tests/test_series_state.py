"""Features kept in stream state against windows over the whole panel."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.operators.series import Series
from panelcast.session import scratch_path
from panelcast.streaming.series_state import keep_features, newest_features

SCHEMA = "k string, g string, d date, v long"


def batch(df):
    s = Series(("k", "g"), "month_date")
    panel = df.where("d IS NOT NULL").groupBy("k", "g", F.trunc("d", "MM").alias("month_date")).agg(F.sum("v").cast("double").alias("y"))
    return panel.withColumns({
        **{f"lag_{k}": F.lag("y", k).over(s.w) for k in (1, 3)}, "rolling_3_mean": F.avg("y").over(s.prev(3)), "rolling_3_std": F.stddev_samp("y").over(s.prev(3)),
    })


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_a_restart_equal_the_batch(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b"]), rng.choice(["x", None]), date(2021, 1, 1) + timedelta(days=rng.randrange(500)), rng.choice([None, 1, 7, 30])) for _ in range(160)]
    rows += [("a", "x", None, 5), ("c", "x", date(2022, 3, 3), None)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    path, seen = scratch_path(spark, "state"), 0
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):  # every part is a run of its own that goes on from the checkpoint
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(2).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        keep_features(stream, ["k", "g"], "d", "v", f"{path}/out", f"{path}/checkpoint", (1, 3), (3,))
        seen = b
        got = newest_features(spark, f"{path}/out", ["k", "g"])
        want = batch(spark.createDataFrame(rows[:seen], SCHEMA))
        key = lambda r: (r["k"], r["g"] or "", r["month_date"])
        for x, y in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            for c in want.columns:
                assert x[c] == (pytest.approx(y[c]) if isinstance(y[c], float) else y[c]), (c, x, y)
