import hashlib

from pyspark.sql import functions as F

from panelcast.llm.stream_dedup import deduplicate
from panelcast.session import scratch_path

from .data import documents, fold, texts


def got(rows):
    return sorted(
        ((r["doc_id"] is None, r["doc_id"] or 0), r["keep"]["doc_id"], r["group_size"], r["kept"]) for r in rows
    )


def brute(ids, rows):
    groups = {}
    for i, t in zip(ids, rows, strict=True):
        groups.setdefault(fold(t), []).append(i)
    return sorted(((i is None, i or 0), max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)])) for i, t in zip(ids, rows, strict=True))


def stored(spark, docs):
    path = scratch_path(spark, "dedup-test")
    docs.repartition(4, "doc_id").write.parquet(path)
    return path


def test_equals_brute_force(spark):
    rows = texts()
    out = deduplicate(spark, stored(spark, documents(spark, rows))).collect()
    assert got(out) == brute(list(range(len(rows))), rows)
    by_id = {r["doc_id"]: bytes(r["digest"]).hex() for r in out}
    assert all(by_id[i] == hashlib.sha256(fold(t).encode()).hexdigest() for i, t in enumerate(rows))


def test_later_files_meet_earlier_ones(spark):
    path, state = scratch_path(spark, "dedup-test"), scratch_path(spark, "dedup-state")
    documents(spark, ["Same", "other"], [1, 2]).write.parquet(path)
    assert got(deduplicate(spark, path, state).collect()) == brute([1, 2], ["Same", "other"])
    documents(spark, ["SAME", "third"], [3, 4]).write.mode("append").parquet(path)
    for _ in range(2):  # a second look takes nothing twice
        assert got(deduplicate(spark, path, state).collect()) == brute([1, 2, 3, 4], ["Same", "other", "SAME", "third"])


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = texts()
    out = deduplicate(spark, stored(spark, documents(spark, rows)), digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)).collect()
    assert got(out) == brute(list(range(len(rows))), rows)


def test_null_and_repeated_ids(spark):
    out = deduplicate(spark, stored(spark, documents(spark, ["a", "A", "a", "b", None, ""], [None, 5, 5, None, 1, 2]))).collect()
    assert sorted((str(r["doc_id"]), str(r["keep"]["doc_id"]), r["group_size"]) for r in out) == [
        ("1", "2", 2), ("2", "2", 2), ("5", "5", 3), ("5", "5", 3), ("None", "5", 3), ("None", "None", 1),
    ]
    assert sum(r["kept"] for r in out) == 3


def test_no_rows(spark):
    assert deduplicate(spark, stored(spark, documents(spark, []))).count() == 0
