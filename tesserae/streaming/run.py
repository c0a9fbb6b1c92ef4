"""Starting streams, and the table an updating stream keeps current."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.session import materialise, shared_dir


def file_stream(
    spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of a folder as they arrive. Each file is read exactly once per checkpoint."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def shard_stream(
    spark: SparkSession, folder: str, ledger: str, rows: str = "members", ext: list[str] | None = None, shards_per_trigger: int | None = None
) -> DataFrame:
    """Rows of archives as they arrive in a folder, each shard read as a stream by one task.

    ``ledger`` is a folder that belongs to the query like its checkpoint; ``rows`` is ``members`` or ``samples``.
    """
    from tesserae.sources import archive

    archive.register(spark)
    reader = spark.readStream.format("samples").option("ledger", ledger).option("rows", rows)
    reader = reader.option("tasks", spark.sparkContext.defaultParallelism)
    if ext:
        reader = reader.option("ext", ",".join(ext))
    if shards_per_trigger:
        reader = reader.option("shardsPerTrigger", shards_per_trigger)
    return reader.load(folder)


def archive_stream(spark: SparkSession, folder: str, pattern: str = "*.tar", files_per_trigger: int = 1000) -> DataFrame:
    """(shard, key, ext, payload) of small archives as they arrive; each is held whole. See :func:`shard_stream`."""
    from tesserae.sources.archive import decode_archives

    # Fixed value: the schema of Spark's binary file source.
    files = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(files).option("pathGlobFilter", pattern)
    return decode_archives(reader.option("maxFilesPerTrigger", files_per_trigger).load(folder))


def work_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now and append it to a parquet table; safe to call again."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()


#: Batches that are folded into one snapshot of the newest rows.
FOLD = 20


def update_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> None:
    """Process what is there now and store changed rows under their batch number.

    A batch that is repeated after a failure overwrites its own folder, so nothing counts twice. With
    ``keys`` every ``FOLD`` batches become one snapshot of the newest row per key, so files do not
    grow with the number of batches.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))
        if keys and number % FOLD == FOLD - 1:
            fold(batch.sparkSession, path, keys, number)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    query = writer.outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _versions(path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=number``."""
    system, root = _folder(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        name, _, number = info.base_name.partition("=")
        if name == kind and system.get_file_info(f"{info.path}/_SUCCESS").type != fs.FileType.NotFound:
            out.append(int(number))
    return sorted(out)


def _remove(path: str, kind: str, numbers: list[int]) -> None:
    system, root = _folder(path)
    for n in numbers:
        system.delete_dir(f"{root}/{kind}={n}")


def fold(spark: SparkSession, path: str, keys: list[str], number: int) -> None:
    """Write the newest rows of all batches up to ``number`` as a snapshot, then remove what it replaces."""
    rows = _newest(spark, path, keys, number)
    rows.write.mode("overwrite").parquet(os.path.join(path, f"snapshot={number}"))
    # The newest batch stays for a repetition; it gives the same rows again.
    _remove(path, "batch", [n for n in _versions(path, "batch") if n < number])
    _remove(path, "snapshot", [n for n in _versions(path, "snapshot") if n < number])


def _newest(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """(keys, values, batch): the newest row of every key."""
    limit = (1 << 62) if upto is None else upto
    # The snapshot that is being written does not count.
    bases = [n for n in _versions(path, "snapshot") if n < limit or upto is None]
    base = max(bases, default=-1)
    parts = [spark.read.parquet(os.path.join(path, f"snapshot={base}"))] if bases else []
    later = [n for n in _versions(path, "batch") if base < n <= limit]
    if later:
        reader = spark.read.option("basePath", path)
        parts.append(reader.parquet(*[os.path.join(path, f"batch={n}") for n in later]).withColumn("batch", F.col("batch").cast("bigint")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"), F.max("batch").alias("batch"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values], "batch")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of a table written by :func:`update_table`."""
    return _newest(spark, path, keys).drop("batch")


def merge_table(
    stream: DataFrame, path: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]
) -> None:
    """Keep one merged state of all batches: ``merge`` of the last state and ``partial`` of the new batch.

    Both are (part, tile, value) tables, as in :mod:`tesserae.operators.accumulate`. The state of batch n is the
    folder ``state=n``, made from the newest state before n, so a batch that is repeated after
    a failure makes the same state again and counts once. Only the last two states are kept.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _versions(path, "state") if n < number]
        new = partial(batch)
        if before:
            old = spark.read.parquet(os.path.join(path, f"state={before[-1]}"))
            new = new.withColumn("part", F.col("part") + 1).unionByName(old.withColumn("part", F.lit(0).cast("bigint")))
        merge(materialise(new)).write.mode("overwrite").parquet(os.path.join(path, f"state={number}"))
        _remove(path, "state", before[:-1])

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged_state(spark: SparkSession, path: str) -> DataFrame:
    """(tile, value) of the newest state of :func:`merge_table`."""
    return spark.read.parquet(os.path.join(path, f"state={_versions(path, 'state')[-1]}"))
