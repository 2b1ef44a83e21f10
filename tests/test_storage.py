"""Readers, sinks, registry and streams."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelcast.operators.panel import monthly_sums
from panelcast.session import cut_lineage, drop_scratch, scratch_path, shared_dir
from panelcast.sources import readers, sinks
from panelcast.streaming import incremental as inc

FACT = "state string, district string, date date, n bigint"


def fact(spark, days, value=1):
    return spark.createDataFrame([("S", "a", d, value) for d in days], FACT)


def test_listed_files(spark):
    path = scratch_path(spark, "t")
    sinks.write_csv(fact(spark, [date(2024, 1, 5)]).withColumn("date", F.date_format("date", "dd-MM-yyyy")), f"{path}/a")
    assert readers.read_listed_counts(spark, [f"{path}/a", f"{path}/gone"], ["n"]).first()["date"] == date(2024, 1, 5)
    with pytest.raises(FileNotFoundError):
        readers.read_listed_counts(spark, [f"{path}/gone"], ["n"])
    with pytest.raises(FileNotFoundError):
        readers.load_table(spark, f"{path}/gone")


def test_write_once_and_append(spark):
    path = scratch_path(spark, "t")
    df = fact(spark, [date(2024, 1, 5)])
    sinks.write_once(df, f"{path}/frozen")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(df.limit(0), f"{path}/frozen")
    for _ in range(2):
        sinks.append_log(df, f"{path}/log")
    assert spark.read.parquet(f"{path}/log").count() == 2


def test_champion_history(spark):
    registry = scratch_path(spark, "t")
    for v, at in (("v1", "2024-01-01 00:00:00"), ("v3", "2024-03-01 00:00:00"), ("v2", "2024-02-01 00:00:00")):
        sinks.set_champion(spark, registry, v, at, f"/models/{v}")
    assert sinks.current_champion(spark, registry).first()["version"] == "v3"
    slots = {r["slot"]: r["version"] for r in sinks.champions(spark.read.parquet(f"{registry}/champions")).collect()}
    assert slots == {"current": "v3", "previous": "v2"}


def test_of_two_promotions_one_wins(spark, monkeypatch):
    registry = scratch_path(spark, "t")
    sinks.promote(spark, registry, "v1", None, "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        sinks.promote(spark, registry, "v2", None, "2024-01-02 00:00:00")  # v1 came first
    write = sinks.set_champion
    monkeypatch.setattr(sinks, "set_champion", lambda *_: None)
    sinks.promote(spark, registry, "v2", "v1", "2024-01-02 00:00:00")  # claims its place and dies
    monkeypatch.setattr(sinks, "set_champion", write)
    with pytest.raises(ValueError):
        sinks.promote(spark, registry, "v3", "v1", "2024-01-03 00:00:00")  # saw v1 too, but comes second
    sinks.promote(spark, registry, "v2", "v1", "2024-01-02 00:00:00")
    sinks.promote(spark, registry, "v3", "v2", "2024-01-03 00:00:00")
    assert [r["version"] for r in sinks.champions(spark.read.parquet(f"{registry}/champions")).orderBy("slot").collect()] == ["v3", "v2"]


def test_months_are_pruned_on_read(spark):
    path = scratch_path(spark, "t")
    df = fact(spark, [date(2024, 1, 5), date(2024, 2, 5)]).withColumn("year_month", F.date_format("date", "yyyy-MM"))
    sinks.write_panel(df, path)
    one = spark.read.parquet(path).where("year_month = '2024-02'")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(year_month" in one._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch_over_several_runs(spark):
    path = scratch_path(spark, "t")
    parts = [fact(spark, [date(2024, 1, 5), date(2024, 2, 1)]), fact(spark, [date(2024, 1, 9), date(2024, 3, 1)], 4)]
    seen = None
    for p in parts:
        p.write.mode("append").parquet(f"{path}/in")
        seen = p if seen is None else seen.unionByName(p)
        stream = spark.readStream.schema(FACT).parquet(f"{path}/in")
        monthly = inc.monthly_stream(stream, ["state", "district"], "date", ["n"])
        inc.run_available(monthly, inc.changed_rows_writer(f"{path}/out"), f"{path}/checkpoint")
        got = inc.latest_rows(spark, f"{path}/out", ["state", "district", "month_date"])
        want = monthly_sums(seen, ["n"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    inc.compact(spark, f"{path}/out", ["state", "district", "month_date"], f"{path}/compact")
    assert spark.read.parquet(f"{path}/compact").count() == 3


def test_late_rows_are_counted(spark):
    path = scratch_path(spark, "t")
    schema = "ts timestamp, k string"
    aggs = [F.count(F.lit(1)).alias("n")]
    for at in ("2024-05-01 00:00:00", "2024-05-10 00:00:00", "2024-01-01 00:00:00"):
        spark.createDataFrame([(at, "a")], "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k").write.mode("append").parquet(f"{path}/in")
        stream = inc.tumbling_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), "ts", ["k"], aggs, lateness="1 day")
        query = inc.run_available(stream, inc.changed_rows_writer(f"{path}/out"), f"{path}/checkpoint")
    assert inc.rows_dropped_as_late(query) == 1
    with pytest.raises(ValueError, match="1 rows"):
        inc.require_no_late_rows(query)


def test_folded_batches_keep_the_newest_rows(spark):
    path, keys = scratch_path(spark, "t"), ["k"]
    write = inc.changed_rows_writer(path)
    for b, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("c", 3)], [("b", 4)])):
        write(spark.createDataFrame(rows, "k string, v int"), b)
    before = sorted(inc.latest_rows(spark, path, keys).collect())
    for _ in range(2):  # a repeated fold changes nothing
        inc.fold_batches(spark, path, keys, 3)
        assert sorted(inc.latest_rows(spark, path, keys).collect()) == before == [("a", 2), ("b", 4), ("c", 3)]
        assert spark.read.parquet(path).count() == 3
    write(spark.createDataFrame([("a", 9)], "k string, v int"), 4)
    assert dict(inc.latest_rows(spark, path, keys).collect()) == {"a": 9, "b": 4, "c": 3}


def test_refresh_folds_as_it_goes(spark):
    path = scratch_path(spark, "t")
    for month in (1, 2, 3, 4, 5):
        fact(spark, [date(2024, month, 5)] * month).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    inc.incremental_refresh(spark, stream, ["state", "district"], "date", "n", f"{path}/out", f"{path}/checkpoint", compact_every=2)
    panel = inc.latest_rows(spark, f"{path}/out/panel", ["state", "district", "month_date"])
    assert sorted(r["n"] for r in panel.collect()) == [1, 2, 3, 4, 5]
    assert spark.read.parquet(f"{path}/out/panel").count() == 5


def test_a_header_is_bounded_and_paths_are_spelled_for_arrow(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("b" * (2 << 20))
    with pytest.raises(Exception, match="no line end"):
        readers.header_check(spark, {"x": str(tmp_path / "x")}).collect()
    spelled = "s3a://bucket/key"
    for spark_way, arrow_way in readers.SPELLINGS:
        spelled = readers.re.sub(spark_way, arrow_way, spelled)
    assert spelled == "s3://bucket/key"


def test_scratch_tables_are_dropped_together(spark):
    df = cut_lineage(fact(spark, [date(2024, 1, 5)]))
    path = scratch_path(spark, "t")
    df.write.parquet(path)
    assert spark.read.parquet(path).count() == 1
    drop_scratch(spark)
    assert not readers.existing_paths(spark, [path])
    drop_scratch(spark)
    assert cut_lineage(fact(spark, [date(2024, 1, 5)])).count() == 1  # a later job starts a folder of its own


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_header_check_writes_whole_tables(spark, monkeypatch):
    from panelcast.queries import storage

    written, write = {}, storage.sinks.write_csv

    def counted(df, path):
        kind = path.split("/")[-2]
        written[kind] = written.get(kind, 0) + df.count()
        write(df, path)

    monkeypatch.setattr(storage.sinks, "write_csv", counted)
    sf = "/root/testdata/sf0.001"
    out = {r["kind"]: r["n_headers"] for r in storage._headers(spark, sf).collect()}
    assert out == {"orders": 1, "customer": 2}
    assert written == {k: spark.read.parquet(f"{sf}/{k}.parquet").count() for k in ("orders", "customer")}
