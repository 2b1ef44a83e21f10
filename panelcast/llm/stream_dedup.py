"""Exact deduplication as a stateful stream.

One stream fingerprints every row of new files (digest, size, stable id, content locator) into an
append-only log.  A second stream aggregates the log by digest; its keyed state lies on disk (RocksDB),
has no expiry and keeps for each digest the largest id with the locator of its content, and the number of
rows.  Both resume from their checkpoints, so later files are compared with all earlier ones.

Results are read from the log and from the state store itself.  Where a digest was hit more than once the
contents are fetched by locator and compared byte by byte; rows that merely share a digest with the row
that stays are grouped among themselves by their full text.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import cut_lineage, scratch_path

#: State on disk; a store is closed when its task has committed, so that only running tasks hold one open.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
_LOG = "doc_id bigint, size bigint, digest binary, path string, row bigint"


def normalised(text: Column) -> Column:
    """A-Z folded, everything else as it is; null is empty.  ``lower`` does just that for ASCII, and fast."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(rows: DataFrame) -> DataFrame:
    """Rows with the place of their content: file and row in it."""
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")
    )


def _pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a single file only from a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[]{}") else f"{path[:-1]}[{path[-1]}]"


def update(
    spark: SparkSession, folder: str, schema: T.StructType, state: str, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30
) -> None:
    """Take the Parquet files below ``folder`` that ``state`` has not seen into its log and its index.

    Interrupted or repeated, it goes on where its checkpoints end; a file is taken once.
    """
    new = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(_pattern(folder))
    text = normalised(F.col("text"))
    prints = _located(new).select("doc_id", F.octet_length(text).cast("bigint").alias("size"), digest(text).alias("digest"), "path", "row")
    log = prints.writeStream.format("parquet").option("checkpointLocation", f"{state}/log_checkpoint").trigger(availableNow=True)
    log.start(f"{state}/log").awaitTermination()
    before = {k: spark.conf.get(k) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        index = (
            spark.readStream.schema(_LOG).parquet(f"{state}/log").groupBy("digest", "size")
            .agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count("*").alias("n"))
        )
        run = index.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{state}/index").trigger(availableNow=True)
        run.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _index(spark: SparkSession, state: str) -> DataFrame:
    """(digest, size, keep, n) as the state store holds them."""
    stored = spark.read.format("statestore").load(f"{state}/index")
    keep, n = (f.name for f in stored.schema["value"].dataType.fields)
    return stored.select(F.col("key.digest").alias("digest"), F.col("key.size").alias("size"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def _differing(spark: SparkSession, folder: str, schema: T.StructType, marked: DataFrame) -> DataFrame:
    """Rows whose text is not that of the row their digest keeps, with their text."""
    hits = marked.where("n > 1").select("path", "row", "digest", "size", F.col("keep.path").alias("_path"), F.col("keep.row").alias("_row"))
    # all texts move once to meet the hits; only those of the hits are kept, and read twice
    texts = cut_lineage(_located(spark.read.schema(schema).parquet(folder)).join(hits, ["path", "row"]))
    stays = F.expr("path = _path AND row = _row")
    kept = texts.where(stays).select("digest", "size", F.col("text").alias("_text"))
    pairs = texts.where(~stays).join(kept, ["digest", "size"])
    same = F.col("text").eqNullSafe(F.col("_text")) | (normalised(F.col("text")) == normalised(F.col("_text")))
    return pairs.where(~same).select("path", "row", "doc_id", "digest", "size", normalised(F.col("text")).alias("text"))


def result(spark: SparkSession, folder: str, schema: T.StructType, state: str) -> DataFrame:
    """doc_id, path, row, digest, keep (doc_id, path, row), group_size and kept of every row taken so far."""
    log = spark.read.schema(_LOG).parquet(f"{state}/log")
    marked = log.join(_index(spark, state), ["digest", "size"])
    apart = cut_lineage(_differing(spark, folder, schema, marked))
    if not apart.isEmpty():
        own = apart.groupBy("digest", "size", "text").agg(F.max(F.struct("doc_id", "path", "row")).alias("_keep"), F.count("*").alias("_n"))
        moved = apart.join(own, ["digest", "size", "text"]).select("path", "row", "_keep", "_n")
        lost = apart.groupBy("digest", "size").agg(F.count("*").alias("_lost"))
        marked = marked.join(moved, ["path", "row"], "left").join(lost, ["digest", "size"], "left")
        marked = marked.withColumn("n", F.coalesce("_n", F.col("n") - F.coalesce("_lost", F.lit(0)))).withColumn("keep", F.coalesce("_keep", "keep"))
    return marked.select("doc_id", "path", "row", "digest", "keep", F.col("n").alias("group_size"), F.expr("keep.path = path AND keep.row = row").alias("kept"))


def deduplicate(
    spark: SparkSession, folder: str, state: str | None = None, schema: T.StructType | None = None, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Bring ``state`` (new by default, below the checkpoint folder) up to date with ``folder`` and return ``result``.

    Rows have doc_id (integer) and text; other columns are ignored.  Texts are equal when they are the same
    after folding A-Z; null counts as empty.  Of equal texts the row with the largest doc_id stays, a null
    one counting least; of rows that repeat that id too, the last by file and place.  No files, no rows.
    """
    schema = schema or spark.read.parquet(folder).schema
    narrow = T.StructType([f for f in schema.fields if f.name in ("doc_id", "text")])
    state = state or scratch_path(spark, "dedup")
    update(spark, folder, narrow, state, digest)
    return result(spark, folder, narrow, state)
