"""Stateful streams: code statistics, class sums, throughput, latest status.

Each aggregates before its shuffle, and its state has one row per code, class, window or
shard, not per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import accumulate
from tesserae.operators.codebook import _entropy_of_counts
from tesserae.operators.quality import INCEPTION_EPS
from tesserae.streaming import run


def code_counts(codes: DataFrame, code: str = "code") -> DataFrame:
    """(code, n), updating."""
    return codes.groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def code_metrics(counts: DataFrame, size: int) -> DataFrame:
    """(used, usage, entropy, min_freq, max_freq) from the current counts."""
    row = counts.agg(
        F.collect_list("n").alias("ns"), F.sum("n").alias("total"), F.min("n").alias("low"), F.max("n").alias("max_freq")
    )
    used = F.size("ns")
    return row.select(
        used.cast("bigint").alias("used"),
        (used / F.lit(float(size))).alias("usage"),
        _entropy_of_counts(F.col("ns"), F.col("total")).alias("entropy"),
        F.when(used < size, F.lit(0)).otherwise(F.col("low")).cast("bigint").alias("min_freq"),
        "max_freq",
    )


def class_sums(probs: DataFrame) -> DataFrame:
    """(class, n, s, k), updating: the sums the one-pass inception score is made of."""
    log_p = F.log(F.col("p") + F.lit(INCEPTION_EPS))
    return probs.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * log_p).alias("k")
    )


def inception_from_sums(sums: DataFrame) -> DataFrame:
    mean = F.log(F.col("s") / F.col("n") + F.lit(INCEPTION_EPS))
    return sums.agg(F.exp(F.sum((F.col("k") - F.col("s") * mean) / F.col("n"))).alias("score"))


def throughput(
    events: DataFrame, time: str, value: str, width: str, slide: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """(start, n, total) of ``value`` per tumbling or sliding window.

    Rows later than ``lateness`` behind the newest time are dropped and their windows closed.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    # Event time must carry a zone; stamps without one are read in the session's.
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = timed.withWatermark(time, lateness).groupBy(window.alias("w"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), "n", "total")


def latest_status(results: DataFrame, key: str, modified: str, first: str, columns: list[str]) -> DataFrame:
    """Newest row per key, updating; among equally new rows the lowest ``first`` wins."""
    rank = F.struct(F.col(modified), -F.col(first))
    out = results.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("_r"))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def online_moments(vectors: DataFrame, column: str, path: str, checkpoint: str) -> None:
    """Process what is there now into the merged count, sums and outer products of all vectors so far."""

    def partial(batch: DataFrame) -> DataFrame:
        return accumulate.partial(batch, column, accumulate.MOMENTS)

    run.merge_table(vectors, path, checkpoint, partial, lambda parts: accumulate.merged(parts, accumulate.MOMENTS))


def current_moments(spark: SparkSession, path: str) -> DataFrame:
    """(i, n, s, g) so far, for ``quality.covariance``."""
    return accumulate.moments(run.merged_state(spark, path))
