import math

import pytest
from pyspark.sql import functions as F

from panelcast.llm.mixing import MixConfig, integral, mix_plan, mixed, rotating, targets

from .data import documents, texts, words


def water(sizes, weights, cap):
    """Targets by raising one level step by step: the level at which capped shares add up to the total."""
    total = min(sum(sizes), cap * sum(sizes))
    lo, hi = 0.0, total * 10 + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, cap * s) for w, s in zip(weights, sizes, strict=True)) < total else (lo, mid)
    return [min(hi * w, cap * s) for w, s in zip(weights, sizes, strict=True)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1, 50], [0, 10, 5], [5], [7, 0], [1, 10**6, 3, 4, 5]])
def test_targets(sizes):
    weights = [1.0 + i % 3 for i in range(len(sizes))]
    assert targets(sizes, weights, 3) == pytest.approx(water(sizes, weights, 3), rel=1e-9, abs=1e-6)
    assert targets([], [], 3) == []


@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_plan(spark, rows_per_range):
    rows = texts()
    docs = documents(spark, rows)
    config = MixConfig(rows_per_range=rows_per_range)
    plan = mix_plan(docs, ["doc_id"], config).collect()
    assert sorted(r["_doc"]["doc_id"] for r in plan) == list(range(len(rows)))
    sources = sorted({r["source"] for r in plan}, key=lambda s: (s is None, s or ""))
    held = [sum(r["size"] for r in plan if r["source"] == s) for s in sources]
    wanted = targets(held, [1.0 + i % 3 for i in range(len(sources))], 3)
    for i, s in enumerate(sources):
        own = [r for r in plan if r["source"] == s]
        assert {r["target"] for r in own} == {wanted[i]} and {r["source_size"] for r in own} == {held[i]}
        assert abs(sum(r["taken"] for r in own) - wanted[i]) <= max(r["size"] for r in own)
        # the running share of words used up at each position is the schedule's integral
        copies = sorted((t, r["size"]) for r in own for t in r["positions"])
        done, (_, w0), (_, w1) = 0.0, *rotating(i)
        for t, size in copies:
            share = (w0 * t + (w1 - w0) * t * t / 2) / integral(rotating(i))
            assert share * wanted[i] == pytest.approx(done + size / 2, abs=1e-6 * max(1, held[i]))
            done += size
    for r in plan:
        assert r["size"] == len(words(rows[r["_doc"]["doc_id"]])) and r["taken"] == r["size"] * len(r["positions"]) <= 3 * r["size"]
        assert all(0 <= t <= 1 for t in r["positions"])


def test_storage_does_not_matter_and_the_mix_is_sorted(spark):
    docs = documents(spark)
    key = F.col("_doc.doc_id")
    one = {r[0]: r[1:] for r in mix_plan(docs, ["doc_id"]).select(key, "taken", "positions").collect()}
    two = {r[0]: r[1:] for r in mix_plan(docs.repartition(5, "text"), ["doc_id"]).select(key, "taken", "positions").collect()}
    assert one == two
    mix = mixed(docs)
    assert mix.columns == docs.columns
    at = sorted((t, i) for i, (_, ts) in one.items() for t in ts)
    ids = [r["doc_id"] for r in mix.collect()]
    assert sorted(ids) == sorted(i for _, i in at)
    places = {}
    for k, i in enumerate(ids):
        places.setdefault(i, []).append(k)
    order = [t for _, t in sorted((k, t) for i, ks in places.items() for k, t in zip(ks, sorted(one[i][1]), strict=True))]
    assert order == sorted(order)


def test_equal_rows_have_all_their_copies(spark):
    docs = documents(spark, ["a b c d"] * 3 + ["e f"] * 2, [1, 1, 1, 2, 2]).withColumn("n", F.lit(1)).withColumn("label", F.lit(1)).withColumn("source", F.lit("s"))
    docs = docs.withColumn("lang", F.lit("en"))
    assert sorted(r["doc_id"] for r in mixed(docs).collect()) == [1, 1, 1, 2, 2]


def test_schedules_with_level_and_steep_parts(spark):
    config = MixConfig(schedule=lambda i: [(0.0, 0.0), (0.5, 2.0), (0.5000001, 1.0), (1.0, 1.0)])
    plan = mix_plan(documents(spark), ["doc_id"], config).collect()
    assert all(0 <= t <= 1 and not math.isnan(t) for r in plan for t in r["positions"])


def test_empty_and_wordless_tables(spark):
    assert mix_plan(documents(spark, []), ["doc_id"]).count() == 0
    plan = mix_plan(documents(spark, [None, "", " "], [None, 1, 1]), ["doc_id"]).collect()
    assert [(r["taken"], r["target"]) for r in plan] == [(0, 0.0)] * 3
    assert mixed(documents(spark, [None, ""])).count() == 0
