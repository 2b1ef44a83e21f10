import zlib

import numpy as np

from panelcast.llm import sharding
from panelcast.llm.sharding import ShardConfig, Splitters, shard_by_bytes

from .data import documents, texts


def check(rows, ids, out, shards):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out)
    assert got == sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, rows, strict=True))
    total, most = sum(r["size"] for r in out), max((r["size"] for r in out), default=0)
    for s in range(shards):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= most


def test_bytes_law(spark):
    rows = texts()
    out = shard_by_bytes(documents(spark, rows), ShardConfig(shards=7)).collect()
    check(rows, list(range(len(rows))), out, 7)


def test_one_text_in_most_rows_is_split_by_id(spark):
    rows = ["the same text again and again"] * 900 + texts()
    ids = list(range(len(rows)))
    config = ShardConfig(shards=10, samples_per_range=4)
    out = shard_by_bytes(documents(spark, rows), config).collect()
    check(rows, ids, out, 10)
    again = shard_by_bytes(documents(spark, rows).repartition(9, "doc_id"), config).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in out}


def test_equal_texts_stand_together(spark):
    rows = [f"text {i % 50} " + "x" * (i % 50) for i in range(1000)]
    out = shard_by_bytes(documents(spark, rows), ShardConfig(shards=5)).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["doc_id"] % 50, set()).add(r["shard"])
    assert sum(len(s) - 1 for s in shards.values()) <= 4  # only the splitters' own texts are cut


def test_splitters_place_ties():
    s = Splitters([(5, 10), (5, 20), (9, 0), (5, 10)])
    key, ids = np.array([4, 5, 5, 5, 5, 9, 9, 10]), np.array([99, 9, 10, 15, 20, -1, 0, 0])
    assert s.place(key, ids).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_odd_tables(spark):
    rows, ids = [None, "", "a", "a", "b" * 100000], [None, None, 1, 1, 2]
    check(rows, ids, shard_by_bytes(documents(spark, rows, ids), ShardConfig(shards=3)).collect(), 3)
    assert shard_by_bytes(documents(spark, [])).count() == 0
    check(["one"], [1], shard_by_bytes(documents(spark, ["one"], [1]), ShardConfig(shards=1)).collect(), 1)


def test_no_range_holds_more_rows_than_allowed(spark, monkeypatch):
    """Many tiny texts beside a few long ones: ranges are cut by rows too, but for one key and id."""
    rows = ["x" * 100_000 if i % 1000 == 0 else None if i % 3 else "" for i in range(20_000)]
    ids = [7 if 100 <= i < 1500 and rows[i] is None else i for i in range(20_000)]
    seen, real = [], sharding._parts

    def spy(held, config, usual):
        seen.append((held["n"], held["low"] == held["high"], real(held, config, usual)))
        return seen[-1][2]

    monkeypatch.setattr(sharding, "_parts", spy)
    out = shard_by_bytes(documents(spark, rows, ids), ShardConfig(shards=7, rows_per_range=500, ranges_per_shard=1)).collect()
    check(rows, ids, out, 7)
    last = seen[-next(k for k in range(1, len(seen) + 1) if sum(n for n, _, _ in seen[-k:]) == len(rows)) :]
    assert all(n <= 500 or single for n, single, _ in last) and any(single and n > 500 for n, single, _ in last)
    assert max(n for n, _, _ in seen) > 2000  # the first sample alone leaves full ranges
