"""A training-data pipeline over ``documents``: each stage is one corpus operator, written and read again.

quality rules -> exact copies -> near copies -> mix of the sources -> token ids.  Every stage but the last
returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe
from panelcast.llm.jaccard import jaccard_components
from panelcast.llm.mixing import mixed
from panelcast.llm.quality import keep_good
from panelcast.llm.queries import PATTERN, RANKS
from panelcast.llm.stream_dedup import deduplicate
from panelcast.session import cut_lineage, scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules accept."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _folder(spark: SparkSession, docs: DataFrame) -> str:
    """The folder whose files ``docs`` is; anything but a plain scan of one folder is written to a new one."""
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    folders = {f.rpartition("/")[0] for f in docs.inputFiles()} if plain else set()
    if len(folders) == 1:
        folder = folders.pop()
        if {*spark.read.parquet(folder).inputFiles()} == {*docs.inputFiles()}:
            return folder
    folder = scratch_path(spark, "stream-input")
    docs.write.parquet(folder)
    return folder


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; the stream takes the files the rows stand in."""
    folder = _folder(spark, docs)
    kept = deduplicate(spark, folder).where("kept").select(F.col("path").alias("_path"), F.col("row").alias("_row"))
    rows = spark.read.schema(docs.schema).parquet(folder).select(
        F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")
    )
    return rows.join(kept, ["_path", "_row"], "left_semi").select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a shingle similarity of 3/4, directly or through others, the one with the least doc_id stays.

    Rows are told apart by id and text.  Of rows that share the least doc_id the one with the least hash stays;
    a null doc_id comes last.  Texts without a word are linked with nothing and stay.
    """
    rows = cut_lineage(jaccard_components(docs).where("component_set IS NOT NULL").select("doc_id", "row_hash", "component_set"))
    stays = rows.groupBy("component_set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_hash")).alias("_first"))
    gone = rows.join(stays, "component_set").where("row_hash <> _first.row_hash").select(F.col("row_hash").alias("_gone")).distinct()
    return docs.join(gone, F.xxhash64("doc_id", "text") == F.col("_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents as the mix takes them, in training order."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (packed little-endian unsigned 32-bit) and whether they decode to the text."""
    rows = bpe.encode(docs.select("doc_id", "source", "text"), RANKS, PATTERN, back=True)
    same = F.col("_bytes") == F.coalesce("text", F.lit("")).cast("binary")
    n = (F.octet_length("_ids") / 4).cast("bigint").alias("n_tokens")
    return rows.select("doc_id", "source", n, F.col("_ids").alias("ids"), same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The stages fit, hash and encode; they are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
