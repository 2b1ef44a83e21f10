import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import pieces
from panelcast.llm.resample import GainPlanes, ResampleConfig, bucket_counts, resample, weights

from .data import documents, fold, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = np.zeros(256, bool)
SOLID[48:58] = SOLID[97:123] = SOLID[128:] = True


def features(text, low, high, buckets):
    w = WORD.findall(fold(text))
    grams = [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    return w, [zlib.crc32(g.encode()) % buckets for g in grams]


def brute(rows, ids, target, c):
    docs = [features(t, *c.orders, c.buckets) for t in rows]
    s, t = (Counter(b for _, own in x for b in own) for x in (docs, [features(t, *c.orders, c.buckets) for t in target]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(c.scale * math.log((t[b] + 1) * (all_s + c.buckets) / ((s[b] + 1) * (all_t + c.buckets)))) for b in range(c.buckets)]
    out = []
    for i, (w, own) in zip(ids, docs, strict=True):
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"{c.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(own), weight, weight + math.floor(-c.scale * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= c.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: c.share[0] * len(able) // c.share[1]]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn) :]] + [(*r, None) for r in out if r[1] < c.min_words])


@pytest.mark.parametrize("config", [ResampleConfig(), ResampleConfig((1, 3), 61, 100, 5, (1, 2), 7), ResampleConfig((2, 2), 1000)])
def test_equals_brute_force(spark, config):
    rows = texts() + ["Émile's 9 lives_now", "idiot " * 40 + "é" * 300]
    ids = [None if k % 13 == 4 else k // 2 if k % 5 else k for k in range(len(rows))]
    target = [x for x in texts(9, 8) if x][:20] + [None, ""]
    out = resample(documents(spark, rows, ids), documents(spark, target), config).collect()
    assert Counter(map(tuple, out)) == brute(rows, ids, target, config)


def test_empty_tables_and_clashes(spark):
    empty, some = documents(spark, []), documents(spark, ["a few words"])
    assert resample(empty, some).collect() == []
    assert [(r["n_words"], r["n_features"], r["rank"]) for r in resample(some, empty).collect()] == [(3, 3, None)]
    assert weights(some, empty).columns == ["doc_id", "lang", "source", "n_chars", "n", "size", "label", "bucket", "_row", "key", "n_words", "n_features", "weight"]
    with pytest.raises(ValueError):
        weights(some.withColumnRenamed("n", "Weight"), empty)


def test_planes_give_the_exact_sum():
    rng = np.random.default_rng(3)
    for top in (1, 7, 13000):
        gain = rng.integers(-top, top + 1, 997)
        gain[:3] = 0, -top, top
        row, bucket = rng.integers(0, 600, 20000), rng.integers(0, 40, 20000) ** 2 % 997
        want = np.bincount(row, gain[bucket], 601).astype(np.int64)
        assert (GainPlanes(gain).weigh(row, bucket, 601) == want).all()


def test_one_hot_row_of_equal_documents(spark):
    rows = ["the same twenty words " * 10] * 400 + texts()
    ids = [1] * 400 + list(range(len(texts())))
    out = resample(documents(spark, rows, ids), documents(spark, texts(9, 8))).collect()
    assert Counter(map(tuple, out)) == brute(rows, ids, texts(9, 8), ResampleConfig())


@pytest.mark.parametrize("limit", [7, 64, 1 << 20])
def test_blocks_hold_every_run_once(limit):
    rng = random.Random(limit)
    rows = ["".join(rng.choice("ab é  -") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(60)] + ["x" * 900, None, " " * 90, "a" * 5 + " " * 50 + "b"]
    found = [[] for _ in rows]
    pairs = [[] for _ in rows]
    for b in pieces.blocks(pa.array(rows, pa.string()), SOLID, 2, None, limit):
        runs = [b.values[s:e].tobytes().decode() for s, e in zip(b.start, b.end, strict=True)]
        for i in range(b.own):
            found[b.row[i]].append(runs[i])
            if i + 1 < len(runs) and b.row[i + 1] == b.row[i]:
                pairs[b.row[i]].append((runs[i], runs[i + 1]))
    want = [re.findall("[abé x]+".replace(" ", ""), t or "") for t in rows]
    assert found == want
    assert pairs == [list(zip(w, w[1:])) for w in want]


def test_crc_of_runs():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 500)
    end = start + rng.integers(0, 200, 500)
    assert pieces.crc32(values, start, end).tolist() == [zlib.crc32(values[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    before = np.full(500, zlib.crc32(b"head"), np.uint32)
    assert pieces.crc32(values, start, end, before).tolist() == [zlib.crc32(b"head" + values[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_a_very_long_text(spark):
    """50 MB in one text: weighed block by block, equal to the sum over its parts."""
    part = " ".join(f"w{i % 3000}" for i in range(200_000))
    long = " ".join([part] * 45)
    target = documents(spark, ["w1 w2 w3 " * 50])
    got = weights(spark.createDataFrame([(1, long)], "doc_id long, text string"), target).first()
    assert len(long) > 50_000_000 and got["n_features"] == 45 * 200_000
    c = ResampleConfig()
    s = bucket_counts(spark.createDataFrame([(part,)], "text string"), c) * 45
    t = bucket_counts(target, c)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10000) / ((int(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t, strict=True)]
    assert got["weight"] == sum(g * int(n) for g, n in zip(gain, s, strict=True))
