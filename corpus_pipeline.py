"""A corpus made ready for training: quality, near-duplicates, leaks, mix and shards.

``STAGES`` are applied in order; each takes the session, the rows its predecessor kept and the
folder of the tables, and returns the rows it keeps, with the columns it got. The last stage
adds the shard and the place in it. ``run`` writes every stage as Parquet below the shared
folder and reads it again, so a lost executor costs no more than the stage it was in.

Defined cases are those of the operators: rows with null texts fail the quality rules; of
rows that repeat id and text one stays; a document may come back up to three times from
mixing, as rows of the same id.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from tesserae.llm.names import fresh
from tesserae.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHARDS = 40


def _columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[f"`{n}`" for n in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    name = fresh(docs, "matches")
    found = decontamination.with_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return _columns(found.filter(F.size(name) == 0), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and sampled to the target weights of their sources."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot`` along a Hilbert curve over source, language and length."""
    size = fresh(docs, "size")
    rows = docs.withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)))
    return sharding.assign(rows, ["source", "lang", size], ["doc_id", size], SHARDS).drop(size)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", leaks),
    ("source_mix", mix),
    ("hilbert_shards", shards),
]

#: Estimation, signatures and curves are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
