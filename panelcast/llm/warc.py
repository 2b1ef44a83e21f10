"""WARC archives: one gzip member a record, written by executors and read back in byte ranges.

Writer.  Pages with equal payloads are found by digest; the one with the least id is a ``response``,
the others are ``revisit`` records that refer to it.  A task writes one file under a temporary name and
renames it, so a repeated task leaves one whole file.

Reader.  Files are cut into byte ranges.  A task looks for the gzip magic in its range; a candidate
counts when its decoded bytes begin with a WARC version line, which separates members from the same
bytes inside compressed data.  The task owns the members that start inside its range and reads past the
end of the range for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.workers import tidy
from panelcast.session import cut_lineage, scratch_path

MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class WarcConfig:
    """Payloads of at least ``revisit_bytes`` that were seen before become revisits."""

    revisit_bytes: int = 0
    level: int = 6
    split_bytes: int = 16 << 20
    date: str = "1970-01-01T00:00:00Z"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark resolves it: a path without a scheme lies in the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a full URI, for use inside a task; Hadoop's names for a store are mapped to Arrow's."""
    scheme = uri.partition(":")[0] if ":" in uri else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: dict, config: WarcConfig) -> bytes:
    payload = page["payload"]
    revisit = page["first"] is not None and page["page_id"] is not None and page["first"] != page["page_id"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page['page_id'] is None else page['page_id']}>",
        f"WARC-Date: {config.date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if page["url"] is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", page["url"]))
    if revisit:
        head += [
            f"WARC-Refers-To: <urn:page:{page['first']}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    gz = zlib.compressobj(config.level, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _writer(folder: str, config: WarcConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = open_path(folder)
        final = f"{base}/part-{task.partitionId():06d}.warc.gz"
        temporary, records, out = f"{base}/.{task.taskAttemptId()}.tmp", 0, None
        for batch in batches:
            for page in (page for a in range(0, batch.num_rows, 64) for page in batch.slice(a, 64).to_pylist()):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(temporary)
                out.write(_record(page, config))
                records += 1
        if out is None:
            return
        out.close()
        try:
            system.move(temporary, final)
        except OSError:  # some stores refuse to replace: another attempt of this task has written the same records
            if system.get_file_info(final).type != fs.FileType.File:
                raise
            system.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([records], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, config: WarcConfig = WarcConfig()) -> tuple[str, DataFrame]:
    """Write a record for every row of ``pages`` (page_id, url, html); the folder and a manifest (path, records).

    ``folder`` is a shared place all executors can write to, by default a new one below the checkpoint folder.
    Null html is an empty payload; null url leaves the target out, control characters and spaces in it are
    percent-encoded.  A null page_id cannot be referred to: such a row is always a response.  Rows that repeat
    the least id of a payload are all responses.  Other columns are ignored.  An empty table leaves an empty folder.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "warc"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("_sha", F.sha2("payload", 256)).withColumn("_size", F.octet_length("payload"))
    first = keyed.groupBy("_sha", "_size").agg(F.min("page_id").alias("first"))
    first = first.select("_sha", "_size", F.when(F.col("_size") >= config.revisit_bytes, F.col("first")).alias("first"))
    joined = keyed.join(first, ["_sha", "_size"]).select("page_id", "url", "payload", "first")
    return folder, cut_lineage(joined.mapInArrow(tidy(_writer(folder, config)), "path string, records bigint"))


def _member(raw: memoryview, more: Iterator[bytes]) -> tuple[bytes, int] | None:
    """Decoded bytes and length of the gzip member at the start of ``raw``; None if it is no WARC record."""
    gz, out, used = zlib.decompressobj(31), [], 0
    step, at = 1 << 16, 0
    try:
        while not gz.eof:
            piece = raw[at : at + step] if at < len(raw) else next(more, b"")
            if not len(piece):
                if sum(map(len, out)) >= len(_VERSION):
                    raise ValueError("an archive ends inside a record")
                return None
            at += len(piece)
            out.append(gz.decompress(piece))
            used += len(piece) - len(gz.unused_data)
            if len(out) == 1 and not _VERSION.startswith(out[0][: len(_VERSION)]):
                return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, used) if data.startswith(_VERSION) else None


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if name}


_ROW = "path string, start bigint, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _parse(data: bytes, path: str, start: int, with_payload: bool) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, mark, payload = block.partition(b"\r\n\r\n")
    kind, claimed = warc.get("warc-type"), warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if not warc.get("content-type", "").startswith("application/http") or not mark:
        http, payload = b"", block
    if kind == "revisit":  # the payload is elsewhere; its length is that of the response it stands for
        length = _headers(http).get("content-length")
        return path, start, kind, warc.get("warc-record-id"), warc.get("warc-target-uri"), warc.get("warc-refers-to"), int(length) if length else None, claimed, None, None
    own = base32_sha1(payload)
    ok = None if claimed is None else own == claimed
    return path, start, kind, warc.get("warc-record-id"), warc.get("warc-target-uri"), warc.get("warc-refers-to"), len(payload), own, ok, payload if with_payload else None


def _scan(path: str, start: int, end: int, with_payload: bool) -> Iterator[tuple]:
    """Records whose members start in [start, end)."""
    system, name = open_path(path)
    with system.open_input_file(name) as f:
        size = f.size()
        f.seek(start)
        raw = f.read(min(size, end + len(MAGIC) - 1) - start)
        view, at = memoryview(raw), 0
        while True:
            at = raw.find(MAGIC, at)
            if at < 0 or start + at >= end:
                return

            def beyond() -> Iterator[bytes]:
                place = start + len(raw)
                while place < size:
                    f.seek(place)
                    piece = f.read(1 << 20)
                    place += len(piece)
                    yield piece

            found = _member(view[at:], beyond())
            if found is None:
                at += 1
                continue
            yield _parse(found[0], path, start + at, with_payload)
            at += found[1]
            if at >= len(raw):
                return


def _reader(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                rows, held = [], 0
                for row in _scan(path, start, end, with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) == 4096 or held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, config: WarcConfig = WarcConfig()) -> DataFrame:
    """One row per record of the ``.warc.gz`` files in ``folder``, each record a gzip member of its own.

    The digest of a response is that of the payload read; ``digest_ok`` says whether the header agrees (null
    without one).  A revisit has the digest and length it declares, and no payload.  A missing header is null.
    A file that ends inside a record is an error, and so is a missing folder.  An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")  # the contents are not read
    step = config.split_bytes
    splits = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))).alias("start"), "length"
    )
    splits = splits.select("path", "start", F.least(F.col("start") + step, F.col("length")).alias("end"))
    dealt = splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return dealt.mapInArrow(tidy(_reader(with_payload)), _ROW)


def page_number(uri: str) -> F.Column:
    """The page id in a record id this module writes."""
    return F.regexp_extract(uri, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
