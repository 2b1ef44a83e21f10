import random

import numpy as np
from pyspark.sql import functions as F

from panelcast.llm import langid
from panelcast.llm.words import buffers

import pyarrow as pa

from .data import documents

LETTERS = {"aa": "abcdef", "bb": "ghijkl", "cc": "defghi"}


def corpus(spark, n=90):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(LETTERS)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(30)), lang if i % 10 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_presence_counts_every_ngram_once():
    rows = ["Ab ab", "", "é1é", "日本語 日本", "..."]
    found, letter = langid.presence(*buffers(pa.array(rows)), langid.KernelConfig(buckets=1 << 20))
    folded = ["ab ab", "", "é é", "日本語 日本", "   "]
    for x, t in zip(found, folded, strict=True):
        grams = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "}
        assert x.sum() == len(grams)
    assert letter.tolist() == [True, False, True, True, False]
    assert (found[0] == langid.presence(*buffers(pa.array(["AB AB"])), langid.KernelConfig(buckets=1 << 20))[0][0]).all()


def test_batches_agree_with_single_texts():
    rows = ["abc def", "ghi", "", "x y z abc"]
    together, _ = langid.presence(*buffers(pa.array(rows)), langid.KernelConfig())
    for x, t in zip(together, rows, strict=True):
        assert (x == langid.presence(*buffers(pa.array([t])), langid.KernelConfig())[0][0]).all()


def test_learns_and_answers(spark):
    docs = corpus(spark)
    model = langid.fit(docs.where("doc_id < 60"), F.xxhash64("doc_id"))
    assert model.labels == ("aa", "bb", "cc") and model.landmarks.shape[1] <= 96
    out = langid.identify(docs.select("doc_id", "text"), model).collect()
    right = [r["lang_pred"] == list(LETTERS)[r["doc_id"] % 3] for r in out if r["doc_id"] >= 60]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    again = langid.fit(docs.where("doc_id < 60").repartition(7), F.xxhash64("doc_id"))
    assert (again.weights == model.weights).all() and (again.landmarks == model.landmarks).all()


def test_odd_texts_and_tables(spark):
    docs = documents(spark, [None, "", "123 !!", "a", "abc " * 20000, "abc", "abc"], [1, None, 3, 4, 5, 6, 6]).drop("lang")
    model = langid.fit(corpus(spark), F.xxhash64("doc_id"))
    got = langid.identify(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    assert [r["lang_pred"] for r in got.collect()] == ["und", "und", "und", "aa", "aa", "aa", "aa"]
    assert langid.fit(corpus(spark).withColumn("lang", F.lit(None).cast("string")), F.xxhash64("doc_id")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(documents(spark, []).drop("lang"), model).count() == 0
