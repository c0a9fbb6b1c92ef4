"""Archives inside archives: files of tar shards that hold further tar and gzip members.

:func:`read_files` gives one row per file, however deep it lies. Inner archives are opened inside
the stream of the outer one, so a task holds one buffer per level and one file, never an archive.

A plain tar file is cut between its members into ranges of at least ``SPLIT_BYTES``: a first job
walks over the headers, seeking past the contents, and each range is then read by a task of its
own, so a tar file of a thousand class archives is read by a thousand tasks. A compressed archive
cannot be entered in its middle and is one range.

Defined cases: what is broken ends the archive that holds it, and the archives around it go on; a
file cut short is left out; archives deeper than ``depth`` are not opened; each of these is a row
with a NULL ``name`` and the reason in ``error`` where ``errors`` is ``report``. Links, folders and
devices are no files. A gzip member that holds no tar is a file named without its ``.gz``. An
empty file is a row with an empty payload. A name that comes twice gives two rows.
"""

from __future__ import annotations

import gzip
import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.session import materialise
from tesserae.sources.archive import BATCH_BYTES, _batch, _uri, expand_shards

#: A range of a plain tar file ends with the first member that makes it this long.
SPLIT_BYTES = 128 << 20
#: Levels of archives that are opened, the outermost being the first.
DEPTH = 4
#: Tasks of one job at most; each then reads several ranges.
MAX_TASKS = 100_000
#: Bytes fetched at once while headers are walked.
HEADER_BYTES = 1 << 14

RANGES = "archive string, start bigint, stop bigint"
_RANGES_ARROW = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
FILES = "archive string, start bigint, nr bigint, inner string, name string, payload binary, error string"
_FILES_ARROW = pa.schema(
    [("archive", pa.string()), ("start", pa.int64()), ("nr", pa.int64()), ("inner", pa.string())]
    + [("name", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
)
#: Between the names of an archive and of what lies in it.
INSIDE = "!/"
_TAR = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
_BROKEN = (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError)


class _Part:
    """The bytes [start, stop) of an open file as a stream."""

    def __init__(self, source, start: int, stop: int):
        source.seek(start)
        self.source, self.left = source, stop - start

    def read(self, size: int = -1) -> bytes:
        got = self.source.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(got)
        return got


def _members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    while (info := tar.next()) is not None:
        yield info
        # The module keeps every header it has seen; a stream never goes back to one.
        tar.members.clear()


def ranges_of(source, size: int, split_bytes: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Ranges of whole members of a file; one range for everything that is no plain tar file."""
    cuts = [0]
    try:
        with tarfile.open(fileobj=source, mode="r:") as tar:
            for info in _members(tar):
                if tar.pax_headers:
                    # Headers for the whole archive would be missing in later ranges.
                    return [(0, size)]
                if info.offset - cuts[-1] >= split_bytes:
                    cuts.append(info.offset)
    except _BROKEN:
        # Members before the damage are still found, and the reader of the last range reports it.
        pass
    return list(zip(cuts, [*cuts[1:], size]))


def walk(stream, inner: str, names: tuple[str, ...] | None, depth: int) -> Iterator[tuple]:
    """(inner, name, payload, error) of the files of one tar stream and of the archives in it."""
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for info in _members(tar):
                if info.isfile():
                    yield from _open(tar.extractfile(info), inner, info.name, info.size, names, depth)
    except _BROKEN as exc:
        yield inner, None, None, f"{inner}: {exc}"


def _open(stream, inner: str, name: str, size: int | None, names, depth: int) -> Iterator[tuple]:
    low = name.lower()
    place = f"{inner}{INSIDE}{name}" if inner else name
    if low.endswith(_TAR) or low.endswith(".gz"):
        if depth <= 1:
            yield inner, None, None, f"{place}: archives lie deeper than allowed"
        elif low.endswith(_TAR):
            yield from walk(stream, place, names, depth - 1)
        else:
            with gzip.GzipFile(fileobj=stream) as plain:
                yield from _open(plain, inner, name[:-3], None, names, depth - 1)
    elif names is None or low.endswith(names):
        try:
            payload = stream.read()
            if size is not None and len(payload) < size:
                raise EOFError("unexpected end of data")
        except _BROKEN as exc:
            yield inner, None, None, f"{place}: {exc}"
        else:
            yield inner, name, payload, None


def list_archives(path: str) -> list[str]:
    """Files of a path with number ranges and commas; a folder stands for all its archives in name order."""
    out = []
    for one in expand_shards(path):
        system, root = fs.FileSystem.from_uri(_uri(one))
        if system.get_file_info(root).type != fs.FileType.Directory:
            out.append(one)
            continue
        scheme = one.split("://")[0] + "://" if "://" in one else ""
        found = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
        out.extend(scheme + f for f in sorted(found) if f.lower().endswith(_TAR))
    return out


def cut(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, start, stop) of the ranges of all archives; a missing file is one empty range."""
    paths = list_archives(path)
    archives = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(max(1, min(len(paths), MAX_TASKS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(one))
                info, found = system.get_file_info(name), [(0, 0)]
                if info.is_file:
                    with io.BufferedReader(system.open_input_file(name), HEADER_BYTES) as source:
                        found = ranges_of(source, info.size, split_bytes)
                yield pa.RecordBatch.from_pylist([dict(zip(_RANGES_ARROW.names, (one, *f))) for f in found], _RANGES_ARROW)

    return archives.mapInArrow(task, RANGES)


def read_files(
    spark: SparkSession,
    path: str,
    ext: list[str] | None = None,
    depth: int = DEPTH,
    errors: str = "skip",
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(archive, start, nr, inner, name, payload, error) of all files whose name ends with one of ``ext``.

    ``inner`` names the archives between the outermost and the file, empty without any;
    (archive, start, nr) is the order of the files in the archives.
    """
    names = tuple(f".{e.lower().lstrip('.')}" for e in ext) if ext else None
    ranges = materialise(cut(spark, path, split_bytes))
    report = errors == "report"

    def rows(one: str, start: int, stop: int) -> Iterator[tuple]:
        try:
            system, name = fs.FileSystem.from_uri(_uri(one))
            with system.open_input_file(name) as source:
                yield from walk(_Part(source, start, stop), "", names, depth)
        except OSError as exc:
            yield "", None, None, f"{one}: {exc}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for nr, row in enumerate(rows(one, start, stop)):
                    if row[3] is not None and not report:
                        continue
                    held.append((one, start, nr, *row))
                    size += len(row[2] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(held, _FILES_ARROW)
                        held, size = [], 0
                if held:
                    yield _batch(held, _FILES_ARROW)

    tasks = max(1, min(ranges.count(), MAX_TASKS))
    return ranges.repartition(tasks).mapInArrow(task, FILES)


def labelled_images(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, start, nr, inner, name, label, payload) of all JPEG files; the label is part of the name."""
    files = read_files(spark, path, ["jpg", "jpeg"], **options).filter(F.col("name").isNotNull())
    label = text.label_from_name("name").alias("label")
    return files.select("archive", "start", "nr", "inner", "name", label, "payload")
