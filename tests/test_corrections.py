"""Late and shuffled arrival against the batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.session import scratch_path
from panelcast.streaming import incremental as inc
from panelcast.streaming.corrections import newest_windows, restating_writer

SCHEMA = "k string, ts timestamp, v long"


def rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(20 * 24 * 60)), rng.choice([None, 1, 5])) for _ in range(n)]


def run(spark, path, parts, first=0, again=None):
    """Files one after the other; ``again`` runs that batch a second time, as after a failure."""
    sums = {"n": F.lit(1).cast("bigint"), "v": F.col("v")}
    write = restating_writer(f"{path}/out", "ts", ["k"], sums)

    def sink(batch, batch_id):
        write(batch, batch_id)
        if batch_id == again:
            write(batch, batch_id)

    for i, part in enumerate(parts, first):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        inc.run_available(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), sink, f"{path}/checkpoint")


def expected(spark, data):
    df = spark.createDataFrame(data, SCHEMA).where("ts IS NOT NULL")
    return {(r["k"], r["d"]): (r["n"], r["v"]) for r in df.groupBy("k", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_equals_the_batch(spark, seed):
    data = rows(seed=seed) + [("a", None, 3)]
    random.Random(seed).shuffle(data)
    path = scratch_path(spark, "late")
    run(spark, path, [data[:150], data[150:290]], again=1)
    run(spark, path, [data[290:]], 2)  # the stream starts again from its checkpoint
    out = newest_windows(spark, f"{path}/out", ["k"]).collect()
    assert {(r["k"], r["window_start"]): (r["n"], r["v"]) for r in out} == expected(spark, data)
    assert {r["version"] for r in out} >= {2, 3} and any(r["restated"] for r in out)


def test_late_rows_are_kept_aside_and_named(spark):
    day = datetime(2024, 3, 1)
    path = scratch_path(spark, "late")
    run(spark, path, [[("a", day, 1), ("a", day + timedelta(days=9), 1)], [("a", day, 5), ("a", day + timedelta(days=9), 1), ("b", day + timedelta(days=1), 2)]])
    late = spark.read.parquet(f"{path}/out/late").select("k", "ts", "v", "batch_id").collect()
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in late) == [("a", 5, 1), ("b", 2, 1)]
    out = {(r["k"], r["window_start"]): (r["v"], r["version"], r["restated"]) for r in newest_windows(spark, f"{path}/out", ["k"]).collect()}
    assert out == {("a", day): (6, 2, True), ("a", day + timedelta(days=9)): (2, 2, False), ("b", day + timedelta(days=1)): (2, 1, True)}
