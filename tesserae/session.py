"""Session set-up, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to hold at most this many rows.
BROADCAST_ROWS = 1_000_000


def get_spark(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the library is tuned for.

    On a cluster ``master`` stays unset and the submitter's settings win; locally it
    defaults to eight threads.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "20g")
        builder = builder.config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    A private temporary folder is used only in local mode with the setting unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tesserae-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result no longer depends on the plan that made it, its columns are pruned on
    every read, and lost executors only re-read files.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a bounded count finds at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when a bounded count shows it is small.

    Larger sides are returned unmarked: the join is then a shuffle join whose hot keys
    adaptive execution splits.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df
