import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyarrow import fs
from pyspark.errors import AnalysisException

from panelcast.llm import warc
from panelcast.session import scratch_path

from .data import documents


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, first int, payload string")


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def rows_of(n=60):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abc <>é") for _ in range(rng.randrange(0, 3000)))) for i in range(n)]
    rows += [(n + i, None if i % 3 else "http://x/ a\r\nb", rows[i % 5][2]) for i in range(20)]
    return rows + [(200, "u", None), (201, "u", ""), (202, "u", "x" * 300000), (150, "u", "x" * 300000), (203, "u", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("split", [1, 97, 5000, 1 << 24])
def test_round_trip_for_any_split(spark, split):
    rows = rows_of()
    config = warc.WarcConfig(split_bytes=split if split > 1 else 211)
    folder, manifest = warc.write_archives(pages(spark, rows).repartition(3), config=config)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    out = warc.read_archives(spark, folder, config=config).withColumn("page_id", warc.page_number("record_id")).withColumn("of", warc.page_number("refers_to")).collect()
    assert len(out) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    by_id = {r["page_id"]: r for r in out}
    for i, url, h in rows:
        r, h = by_id[i], h or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), sha(h))
        assert (r["record_type"], r["of"]) == (("response", None) if first[h] == i else ("revisit", first[h]))
        assert r["record_type"] == "revisit" or (bytes(r["payload"]) == h.encode() and r["digest_ok"])
        assert r["target_uri"] == (None if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"))


def test_short_payloads_are_never_revisits(spark):
    folder, _ = warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), config=warc.WarcConfig(revisit_bytes=3))
    assert sorted((r["record_id"], r["record_type"]) for r in warc.read_archives(spark, folder).collect()) == [
        ("<urn:page:1>", "response"), ("<urn:page:2>", "response"), ("<urn:page:3>", "response"), ("<urn:page:4>", "revisit"),
    ]


def test_any_gzip_tool_reads_the_files_and_magic_inside_a_record_is_no_member(tmp_path):
    inner = zlib.compress(b"noise", 0) + warc.MAGIC + b"\x00" * 20 + gzip.compress(b"not a record")
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    member = gzip.compress(head + block + b"\r\n\r\n", compresslevel=0)  # stored: the inner bytes stand in the file as they are
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk" + member * 3)
    size = len(path.read_bytes())
    for step in (7, 50, size):
        found = [x for a in range(0, size, step) for x in warc._scan(str(path), a, min(size, a + step), True)]
        assert [x[1] for x in found] == [4, 4 + len(member), 4 + 2 * len(member)] and all(x[-1] == inner for x in found)
    path.write_bytes(member + member[:-9])
    with pytest.raises(ValueError):
        list(warc._scan(str(path), 0, 2 * len(member), True))


def test_nulls_repeats_and_nothing(spark):
    folder, _ = warc.write_archives(pages(spark, [(None, None, "a"), (None, None, "a"), (1, "u", "b"), (1, "u", "b")]))
    out = warc.read_archives(spark, folder).collect()
    assert sorted((r["record_id"], r["record_type"]) for r in out) == [("<urn:page:1>", "response")] * 2 + [("<urn:page:>", "response")] * 2
    folder, manifest = warc.write_archives(pages(spark, []))
    assert manifest.count() == 0 and warc.read_archives(spark, folder).count() == 0
    with pytest.raises(AnalysisException):
        warc.read_archives(spark, scratch_path(spark, "nowhere"))


def test_folders_are_full_uris(spark, tmp_path):
    """Writers get the folder as Spark resolves it, so a path without a scheme lies where Spark reads it."""
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    folder, manifest = warc.write_archives(documents(spark, ["a"]).selectExpr("doc_id page_id", "'u' url", "text html"), str(tmp_path / "x"))
    assert folder == f"file:{tmp_path}/x" and manifest.count() == 1 and warc.read_archives(spark, folder).count() == 1
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://made")
    conf.set("fs.viewfs.mounttable.made.link./warc", f"file:{tmp_path}")
    try:
        assert warc.qualified(spark, "/warc/y") == "viewfs://made/warc/y"
    finally:
        conf.set("fs.defaultFS", before)


def test_names_of_stores():
    for uri, want in (("file:/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("/a/b", "/a/b")):
        system, path = warc.open_path(uri)
        assert isinstance(system, fs.LocalFileSystem) and path == want
    for scheme in ("s3", "s3a", "s3n"):
        system, path = warc.open_path(f"{scheme}://bucket/a/b?region=us-east-1")
        assert system.type_name == "s3" and path == "bucket/a/b"
