"""CSV, Parquet and JSON scans with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.dates import strict_date
from panelcast.operators.quality import require_columns, require_rows

DATE_FORMAT = "dd-MM-yyyy"


def count_schema(counts: Sequence[str]) -> T.StructType:
    """Raw daily facts: state, district, date as text, then the count columns."""
    text = [T.StructField(c, T.StringType()) for c in ("state", "district", "date")]
    return T.StructType(text + [T.StructField(c, T.LongType()) for c in counts])


def read_daily_counts(spark: SparkSession, paths: str | Sequence[str], counts: Sequence[str], fmt: str = DATE_FORMAT) -> DataFrame:
    """All parts of a glob or list in one scan, dates parsed strictly; no inference pass over the data."""
    raw = spark.read.schema(count_schema(counts)).option("header", True).csv(paths)
    return raw.withColumn("date", strict_date("date", fmt))


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The listed paths or globs that are there, asked of the file system they live on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).globStatus(hp):
            found.append(p)
    return found


def read_listed_counts(spark: SparkSession, paths: Sequence[str], counts: Sequence[str], fmt: str = DATE_FORMAT) -> DataFrame:
    """Explicit file list; missing files are skipped, none at all is an error."""
    found = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    return read_daily_counts(spark, found, counts, fmt)


def sample_scan(df: DataFrame, n: int = 5000) -> DataFrame:
    """First n rows for a look at a source; Spark stops reading once it has them."""
    return df.limit(n)


# How Spark spells a path, and how Arrow's file systems do.
SPELLINGS = ((r"^file:/(?!/)", "file:///"), (r"^s3[an]:", "s3:"))


def _first_line_udf(limit: int = 1 << 20):
    """First line of each file, read in the task through the file system the path names; a longer one is an error."""
    spellings = SPELLINGS

    def read(path: str) -> str:
        for spark_way, arrow_way in spellings:
            path = re.sub(spark_way, arrow_way, path)
        fs, name = pafs.FileSystem.from_uri(path)
        text = b""
        with fs.open_input_stream(name) as stream:
            while b"\n" not in text and (chunk := stream.read(4096)):
                text += chunk
                if len(text) > limit and b"\n" not in text:
                    raise ValueError(f"no line end in the first {limit} bytes of {path}")
        return text.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")

    # Nested, so that it travels by value and executors need no copy of this package.
    @F.pandas_udf(T.StringType())
    def first_line(paths: pd.Series) -> pd.Series:
        return paths.map(read)

    return first_line


def header_check(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """Per kind of file: number of files and of distinct headers, and whether all agree.

    Files are listed without their content; tasks then read just the first line of each.
    """
    first_line, parts = _first_line_udf(), None
    for kind, path in sources.items():
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        head = listed.where("length > 0").select(F.lit(kind).alias("kind"), first_line("path").alias("header"))
        parts = head if parts is None else parts.unionByName(head)
    return parts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_distinct("header").alias("n_headers"),
        F.first("header").alias("header"),
    ).withColumn("consistent", F.col("n_headers") == 1)


def load_table(spark: SparkSession, path: str, required: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """A modeling table that exists, has the required columns and at least one row."""
    if not existing_paths(spark, [path]):
        raise FileNotFoundError(path)
    return require_rows(require_columns(spark.read.format(fmt).load(path), required, path), path)


def read_dated_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV whose schema carries DateType columns in ISO form."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Out-of-fold predictions."""
    return require_columns(spark.read.parquet(path), ["fold", "y", "prediction"], path)


METADATA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("saved_at", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.StructType([T.StructField(c, T.DoubleType()) for c in ("mae", "rmse", "r2", "mape")])),
        T.StructField("cv", T.StructType([T.StructField(c, T.DoubleType()) for c in ("mae_mean", "rmse_mean", "r2_mean")])),
    ]
)


def read_model_versions(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Metadata documents as a table: alternate keys coalesced, missing ones null, newest first."""
    raw = spark.read.schema(METADATA).option("multiLine", multiline).json(path)
    return raw.select(
        F.coalesce("version", "model_version").alias("version"),
        F.coalesce("created_at", "saved_at").alias("created_at"),
        F.coalesce("metrics.mae", "cv.mae_mean").alias("mae"),
        F.coalesce("metrics.rmse", "cv.rmse_mean").alias("rmse"),
        F.coalesce("metrics.r2", "cv.r2_mean").alias("r2"),
        F.col("metrics.mape").alias("mape"),
        "params",
    ).orderBy(F.desc("created_at"), F.desc("version"))
