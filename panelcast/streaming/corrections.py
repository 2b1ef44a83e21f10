"""Windows that late rows correct: nothing is dropped, closed windows are restated with a version.

Every batch leaves mergeable sums by key and window.  A window the batch touches is written again from the sums
of all batches so far, so the newest version of each window is the batch result of all rows that have arrived,
whatever their order.  Rows of windows that were closed when they came also go to a side table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _latest_time(spark: SparkSession, path: str, batch_id: int) -> object | None:
    """Largest event time of the batches before this one."""
    if not batch_id:
        return None
    seen = spark.read.schema("batch_id bigint, latest timestamp").parquet(f"{path}/progress")
    return seen.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]


def restating_writer(path: str, ts: str, keys: Sequence[str], sums: Mapping[str, Column], width: str = "1 day",
                     lateness: str = "2 days") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink.  ``sums`` are summed per key and window; a window is closed ``lateness`` after its end.

    Below ``path``: ``sums`` (what each batch adds), ``late`` (rows of closed windows as they came), ``windows``
    (keys, window_start, sums, version, restated) and ``progress``, each with a folder a batch.  A batch that is
    run again replaces its folders and reads only those before it, so it writes the same.  Rows without a time
    are left out; a null key is a key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        time = F.col(ts).cast("timestamp")
        window = F.window(time, width)
        latest = _latest_time(spark, path, batch_id)
        closed = F.lit(False) if latest is None else F.col("_w.end") <= F.lit(latest).cast("timestamp") - F.expr(f"interval {lateness}")
        rows = batch.where(time.isNotNull()).withColumn("_w", window).withColumn("_late", closed).persist()
        try:
            rows.where("_late").drop("_w", "_late").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            added = rows.groupBy(*keys, F.col("_w.start").alias("window_start")).agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.max("_late").alias("late"))
            added.write.mode("overwrite").parquet(f"{path}/sums/batch_id={batch_id}")
            done = rows.agg(F.max(time).alias("latest")).select(F.lit(batch_id).cast("bigint").alias("batch_id"), "latest")
            done.write.mode("overwrite").parquet(f"{path}/progress/number={batch_id}")
        finally:
            rows.unpersist()
        schema = added.schema
        touched = spark.read.schema(schema).parquet(f"{path}/sums/batch_id={batch_id}")
        ends = touched.agg(F.min("window_start"), F.max("window_start")).first()
        if ends[0] is None:
            return
        so_far = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(f"{path}/sums")
        so_far = so_far.where((F.col("batch_id") <= batch_id) & F.col("window_start").between(*ends))
        total = so_far.groupBy(*keys, "window_start").agg(
            *(F.sum(n).alias(n) for n in sums), F.count(F.lit(1)).cast("int").alias("version"), F.max("batch_id").alias("_last"),
            F.coalesce(F.max(F.when(F.col("batch_id") == batch_id, F.col("late"))), F.lit(False)).alias("restated"),
        )
        total.where(F.col("_last") == batch_id).drop("_last").write.mode("overwrite").parquet(f"{path}/windows/batch_id={batch_id}")

    return write


def newest_windows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every window."""
    rows = spark.read.parquet(f"{path}/windows")
    rest = [c for c in rows.columns if c not in (*keys, "window_start", "batch_id")]
    newest = rows.groupBy(*keys, "window_start").agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return newest.select(*keys, "window_start", "_r.*")
