"""The pipeline's stages over a small folder of tables, each against what its operator promises."""

import importlib
import os
import sys

import pytest

from panelcast.session import scratch_path

from .data import documents, fold, texts, words
from .test_jaccard import brute as components_of

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark):
    folder = scratch_path(spark, "pipeline-test")
    rows = texts(9)
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_follow_each_other(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append((name, docs.columns, [r["doc_id"] for r in docs.collect()]))
    assert all(c == columns for _, c, _ in kept[:-1]) and len(kept) == 5
    good, exact, near, mix, tokens = (ids for _, _, ids in kept)
    assert set(good) <= {i for i, t in enumerate(rows) if len(words(t)) >= 50}
    least = {}
    for i in good:
        least[fold(rows[i])] = max(least.get(fold(rows[i]), -1), i)
    assert sorted(exact) == sorted(least.values())
    assert sorted(near) == sorted({c for _, _, c in components_of(sorted(exact), [rows[i] for i in sorted(exact)])})
    assert set(mix) <= set(near) and sorted(mix) == sorted(tokens) and max(mix.count(i) for i in set(mix)) <= 3
    assert all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in docs.collect())


def test_run_applies_the_stages(spark, tables):
    folder, _ = tables
    assert sorted(pipeline.run(spark, folder).columns) == ["doc_id", "ids", "n_tokens", "round_trip", "source"]


def test_the_stream_reads_the_files_of_a_plain_scan_only(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pipeline._folder(spark, docs).endswith("/documents.parquet")
    part = docs.where("doc_id < 20")
    assert spark.read.parquet(pipeline._folder(spark, part)).count() == 20
    assert sorted(r["doc_id"] for r in pipeline.exact_copies(spark, part, folder).collect()) == list(range(20))
    one = spark.read.parquet(docs.inputFiles()[0])
    assert spark.read.parquet(pipeline._folder(spark, one)).count() == one.count()


def test_one_document_of_each_group_stays(spark):
    """Near copies whose ids are null, or one and the same."""
    def near(word):
        common = [f"{word}{i}" for i in range(60)]
        return [" ".join([*common, f"{word}end{k}"]) for k in range(3)]

    rows = [*near("a"), *near("b"), *near("c"), None, ""]
    docs = documents(spark, rows, [None, None, None, 5, 5, 7, None, 5, 5, None, 5])
    kept = sorted((str(r["doc_id"]), r["text"] and r["text"][0]) for r in pipeline.near_copies(spark, docs, "").where("text <> ''").collect())
    assert kept == [("5", "b"), ("5", "c"), ("None", "a")]
    assert pipeline.near_copies(spark, docs, "").where("text IS NULL OR text = ''").count() == 2
