"""Code book statistics over token tables: usage, entropy, prefixes.

Every function first counts rows per code (or per position and code), which Spark
combines before the shuffle, so a single very frequent code costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.core import share_entropy

#: Added to shares before the logarithm.
ENTROPY_EPS = 1e-8


def _entropy_of_counts(counts: Column, total: Column) -> Column:
    """Base-2 entropy of an array of counts (one element per used code)."""
    return F.aggregate(
        counts, F.lit(0.0), lambda acc, n: acc + share_entropy(n / total, ENTROPY_EPS)
    )


def usage(codes: DataFrame, size: int, code: str = "code") -> DataFrame:
    """(used, usage): distinct codes, and their share of a code book of ``size`` entries."""
    used = codes.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    out = used.agg(F.count(F.lit(1)).alias("used"))
    return out.withColumn("usage", F.col("used") / F.lit(float(size)))


def usage_estimate(codes: DataFrame, size: int, code: str = "code", rsd: float = 0.02) -> DataFrame:
    """``usage`` with a mergeable sketch, for code books too large to count exactly."""
    out = codes.agg(F.approx_count_distinct(code, rsd).alias("used"))
    return out.withColumn("usage", F.col("used") / F.lit(float(size)))


def entropy(codes: DataFrame, size: int, code: str = "code") -> DataFrame:
    """(entropy, min_freq, max_freq) over all ``size`` entries; unused entries count 0."""
    counts = codes.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    # One element per used code, at most ``size``.
    row = counts.agg(
        F.collect_list("n").alias("ns"),
        F.sum("n").alias("total"),
        F.min("n").alias("low"),
        F.max("n").alias("max_freq"),
    )
    unused = F.size("ns") < F.lit(size)
    return row.select(
        _entropy_of_counts(F.col("ns"), F.col("total")).alias("entropy"),
        F.when(unused, F.lit(0)).otherwise(F.col("low")).cast("bigint").alias("min_freq"),
        F.col("max_freq"),
    )


def position_entropy(tokens: DataFrame, pos: str = "pos", code: str = "code") -> DataFrame:
    """(pos, n, used, entropy): code statistics at every occupied position."""
    counts = tokens.groupBy(pos, code).agg(F.count(F.lit(1)).alias("c"))
    row = counts.groupBy(pos).agg(
        F.collect_list("c").alias("cs"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("used")
    )
    return row.select(
        F.col(pos), "n", "used", _entropy_of_counts(F.col("cs"), F.col("n")).alias("entropy")
    )


def tokens_per_sample(codes: DataFrame, sample: str = "sample_key") -> DataFrame:
    """(samples, tokens, avg_tokens)."""
    sizes = codes.groupBy(sample).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("tokens"))
    return out.withColumn("avg_tokens", F.col("tokens") / F.col("samples"))


def prefix_counts(
    tokens: DataFrame, length: int, at_least: int, sample: str = "sample_key"
) -> DataFrame:
    """(prefix, n): how many samples start with each ``length``-token prefix.

    Only the first ``length`` tokens of a sample enter the shuffle.
    """
    parts = [
        F.max(F.when(F.col("pos") == i, F.col("code"))).alias(f"c{i}") for i in range(length)
    ]
    heads = tokens.filter(F.col("pos") < length).groupBy(sample).agg(*parts)
    names = [f"c{i}" for i in range(length)]
    heads = heads.dropna(subset=names)
    prefix = F.concat_ws(",", *[F.col(c).cast("string") for c in names])
    counts = heads.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= at_least)


def with_prefix(tokens: DataFrame, prefix: Sequence[int], sample: str = "sample_key") -> DataFrame:
    """Samples whose tokens start with ``prefix``."""
    wanted = F.lit(False)
    for i, code in enumerate(prefix):
        wanted = wanted | ((F.col("pos") == i) & (F.col("code") == code))
    hits = tokens.filter(wanted).groupBy(sample).agg(F.count(F.lit(1)).alias("hits"))
    return hits.filter(F.col("hits") == len(prefix)).select(sample)


def union_of_codes(*parts: DataFrame) -> DataFrame:
    """Distinct codes of several batches; each batch is reduced before the union."""
    out = parts[0].select("code").distinct()
    for part in parts[1:]:
        out = out.unionByName(part.select("code").distinct())
    return out.distinct()
