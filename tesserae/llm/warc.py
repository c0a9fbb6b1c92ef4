"""WARC archives: writing one gzip member per record, and a reader that splits large files.

Writing: every task packs its rows into archives of its own and gives them their final names
when it is done, so a task that is tried again leaves no half archive and a repeated attempt
writes the same name. Records of equal large payloads are stored once: the one with the
largest page id is a response, the others revisit it.

Reading: files are cut into byte ranges without being read first. A task scans its range for
gzip magic, decodes a few bytes at each candidate and takes it for a member only if they
begin with a WARC version line and a whole header block, of any length, follows; it owns every record that
begins inside its range and reads on past the end for the last one. Magic bytes inside
compressed data fail that test, so a range needs no index and no neighbour.

Files are reached through Arrow's file systems, so a folder may be any URI they know. It must
be one that all tasks reach: by default a new folder below ``spark.checkpoint.dir``.

Defined cases: a null payload is empty; a null url is empty; a null page id is written as
``null`` and read back as null; equal ids are separate records, and all those
with the largest id of a payload are responses; a record without the headers of this writer is read with nulls;
members that cannot be decoded are skipped; an empty table gives no archive, which reads back
as an empty table; other columns are ignored.
"""

from __future__ import annotations


import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import shared_dir

#: Payloads smaller than this are always stored.
REVISIT_FROM = 1000
#: Bytes of a member inflated first, and tasks of a reading stage at most.
MEMBER_BYTES = 1 << 14
MOST_TASKS = 20_000
#: Bytes of archive per byte range of the reader.
SPLIT_BYTES = 8 << 20
#: Bytes of payload after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes fetched at a time.
READ_BYTES = 1 << 20
#: Bytes of archive that are decoded first to see whether a member begins there.
OPENING_BYTES = 4096

#: Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, digest string, full_length bigint, payload binary"
RECORDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("digest", pa.string()),
        ("full_length", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def uri(path: str) -> str:
    return path if "://" in path or not path.startswith("/") else f"file://{path}"


def locate(path: str) -> tuple[fs.FileSystem, str]:
    path = uri(path)
    # file:/x is how Hadoop writes a local path.
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


# writing ---------------------------------------------------------------------------------


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, full_length, refers_to): which records to store and which to revisit.

    Only digests and ids are aggregated. A payload with a third of all copies joins as a skewed
    key, which adaptive execution splits.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha1("payload"), "full_length": F.octet_length("payload").cast("bigint")})
    large = rows.filter(F.col("full_length") >= REVISIT_FROM).select("digest", "page_id")
    last = large.groupBy("digest").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    last = last.filter("copies > 1").drop("copies")
    rows = rows.join(last, "digest", "left")
    other = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    rows = rows.withColumn("refers_to", F.when(other, F.col("kept_id"))).drop("kept_id")
    return rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def encode_record(page_id, url: str, payload: bytes | None, digest: str, full_length: int, refers_to) -> bytes:
    """One record as a gzip member."""
    body = payload or b""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_length}\r\n\r\n".encode()
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head.append(("Content-Length", str(len(http) + len(body))))
    block = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + http + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(block) + packer.flush()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records below ``folder``; returns (path, bytes) of every archive, stored.

    The list of archives is the manifest a reader works from: files of lost attempts are not in it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = locate(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        number, out, size, done = 0, None, 0, []

        def close() -> None:
            nonlocal out, size, number
            if out is not None:
                written = out.tell()
                out.close()
                # Each attempt has names of its own: a late one can't replace what the manifest lists.
                name = f"{root}/part-{context.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
                system.move(part, name)
                done.append((name, written))
                out, size, number = None, 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    part = f"{root}/.{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(part)
                out.write(
                    encode_record(row["page_id"], row["url"], row["payload"], row["digest"], row["full_length"], row["refers_to"])
                )
                size += len(row["payload"] or b"")
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"]
        )

    spark = records.sparkSession
    rows = records.select("page_id", "url", "payload", "digest", "full_length", "refers_to")
    manifest = f"{folder.rstrip('/')}/manifest"
    rows.mapInArrow(task, "path string, bytes bigint").write.parquet(manifest)
    return spark.read.schema("path string, bytes bigint").parquet(manifest)


def new_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")


# reading ---------------------------------------------------------------------------------


@dataclass
class Record:
    start: int
    headers: dict[str, str]
    block: bytes


def _begins_record(window: _Window, position: int) -> bool:
    """Whether a member begins at ``position`` and its data begin with a whole header block."""
    unpack, opening, taken = zlib.decompressobj(31), b"", position
    tail, step = b"", OPENING_BYTES
    while not unpack.eof:
        chunk = window.at(taken, step)
        if not chunk:
            return False
        try:
            piece = unpack.decompress(chunk)
        except zlib.error:
            return False
        taken += len(chunk)
        if len(opening) < len(VERSION):
            opening += piece[: len(VERSION) - len(opening)]
            if not VERSION.startswith(opening):
                return False
        # The blank line may lie across two pieces.
        if b"\r\n\r\n" in tail + piece:
            return opening == VERSION
        tail, step = (tail + piece)[-3:], min(4 * step, READ_BYTES)
    return False


def _headers(block: bytes) -> tuple[dict[str, str], bytes] | None:
    end = block.find(b"\r\n\r\n")
    if not block.startswith(VERSION) or end < 0:
        return None
    out = {}
    for line in block[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out, block[end + 4 :]


class _Window:
    """Bytes of a file from a position on, fetched in steps."""

    def __init__(self, stream, start: int, size: int):
        self.stream, self.size, self.base, self.data = stream, size, start, b""

    def upto(self, end: int) -> None:
        """Have all bytes before ``end``, as far as the file goes."""
        end = min(end, self.size)
        have = self.base + len(self.data)
        if end > have:
            self.stream.seek(have)
            self.data += self.stream.read(max(end - have, min(READ_BYTES, self.size - have)))

    def forget(self, position: int) -> None:
        self.data = self.data[position - self.base :]
        self.base = position

    def at(self, position: int, length: int) -> bytes:
        self.upto(position + length)
        return self.data[position - self.base : position - self.base + length]


def records_in(stream, size: int, start: int, end: int) -> Iterator[Record]:
    """Records whose gzip member begins in ``[start, end)`` of a stream of ``size`` bytes."""
    window = _Window(stream, start, size)
    position = start
    while position < end:
        window.upto(min(end + len(GZIP_MAGIC), position + READ_BYTES))
        found = window.data.find(GZIP_MAGIC, position - window.base)
        have = window.base + len(window.data)
        if found < 0 or window.base + found >= end:
            if have >= min(end + len(GZIP_MAGIC), size):
                return
            # The magic may lie across the end of what was fetched.
            position = max(position, have - len(GZIP_MAGIC) + 1)
            window.forget(position)
            continue
        position = window.base + found
        if position - window.base >= READ_BYTES:
            window.forget(position)
        if not _begins_record(window, position):
            position += 1
            continue
        # A member: inflate it whole, fetching as needed; its end is where the search goes on.
        unpack = zlib.decompressobj(31)
        pieces, taken, step = [], position, MEMBER_BYTES
        try:
            while not unpack.eof:
                # Small members are common: what is fetched beyond one is copied, so steps begin small.
                chunk = window.at(taken, step)
                if not chunk:
                    break
                pieces.append(unpack.decompress(chunk))
                taken, step = taken + len(chunk), min(2 * step, READ_BYTES)
                if taken - window.base >= 4 * READ_BYTES:
                    window.forget(taken)
        except zlib.error:
            unpack = None
        if unpack is None or not unpack.eof:
            # A broken member: look for the next one right behind its magic.
            position += 1
            window = _Window(stream, position, size)
            continue
        whole = _headers(b"".join(pieces))
        yield Record(position, *whole)
        position = taken - len(unpack.unused_data)
        if position < window.base:
            window.base, window.data = position, unpack.unused_data + window.data


def _row(record: Record) -> dict:
    length = int(record.headers.get("content-length", len(record.block)) or 0)
    block = record.block[:length]
    http, gap, payload = block.partition(b"\r\n\r\n")
    full = len(payload)
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            full = int(value)
    digest = record.headers.get("warc-payload-digest", "")
    kind = record.headers.get("warc-type")
    return {
        "record_id": record.headers.get("warc-record-id"),
        "record_type": kind,
        "refers_to": record.headers.get("warc-refers-to"),
        "target_uri": record.headers.get("warc-target-uri"),
        "digest": digest.partition(":")[2] or None,
        "full_length": full,
        "payload": payload if gap and kind != "revisit" else None,
    }


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the archives in a folder or matching a pattern; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).selectExpr("path", "length AS bytes")


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of (path, bytes) archives; every ``split_bytes`` of a file are a unit of work."""
    last = F.floor((F.greatest(F.col("bytes"), F.lit(1)) - 1) / split_bytes)
    splits = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    splits = splits.select("path", "bytes", (F.col("n") * split_bytes).alias("start"))
    # The number is given: these rows are light and the work behind them is not.
    count = archives.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    splits = splits.repartition(int(min(count, MOST_TASKS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                system, path = locate(split["path"])
                rows, held = [], 0
                with system.open_input_file(path) as stream:
                    for record in records_in(stream, split["bytes"], split["start"], split["start"] + split_bytes):
                        rows.append(_row(record))
                        held += len(record.block)
                        if held >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return splits.mapInArrow(task, RECORD_SCHEMA)


def page_number(urn):
    """The page id in a record id column; null for ``null`` and foreign ids."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
