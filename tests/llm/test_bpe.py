import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelcast.llm import bpe

from .data import documents, texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def judge():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    letters = "abeinrst .,'\n0ÄéßσжЩ日🙂\x00"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(200)] + [
        "<|endoftext|>", "a" * 3000, "ab" * 700, " " * 900, "日本語" * 200, "é" * 129, "!?" * 600, "it's we'll I'd", "\U0001f600" * 90,
    ]


def test_ids_and_round_trip(spark, judge):
    rows = texts() + odd_texts()
    docs = documents(spark, rows)
    ids = bpe.encode(docs, PATH, PATTERN)
    assert ids.columns == [*docs.columns, "_ids"]
    for r in bpe.decode(ids.withColumn("kept", ids["_ids"]), PATH, PATTERN).collect():
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["kept"]), "<u4").tolist() == judge.encode_ordinary(text)
        assert bytes(r["_bytes"]) == text.encode()
    both = bpe.encode(docs, PATH, PATTERN, back=True).select("doc_id", "_ids", "_bytes")
    assert sorted(both.collect()) == sorted(bpe.decode(ids.withColumn("k", ids["_ids"]), PATH, PATTERN).selectExpr("doc_id", "k AS _ids", "_bytes").collect())


def test_blocks_of_long_texts_and_a_small_cache(judge, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    monkeypatch.setattr(bpe, "CACHE", 50)
    t = bpe.Tokenizer(PATH, PATTERN)
    for text in (" ".join(x for x in texts(2) if x), "z" * 500):
        ids = t.encode([text, "short", None])
        assert np.frombuffer(ids[0], "<u4").tolist() == judge.encode_ordinary(text)
        assert t.decode(ids[0]) == text.encode() and ids[2] == b""


def test_refused_column_and_empty_table(spark):
    with pytest.raises(ValueError):
        bpe.encode(documents(spark, ["a"]).withColumnRenamed("key", "_ids"), PATH, PATTERN)
    assert bpe.encode(documents(spark, []), PATH, PATTERN).count() == 0
