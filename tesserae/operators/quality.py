"""Dataset-scale quality measures over feature vectors and class probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import vectors as vec
from tesserae.operators import accumulate
from tesserae.operators.ordering import number_rows
from tesserae.session import materialise

INCEPTION_EPS = 1e-16


def moment_sums(df: DataFrame, column: str) -> DataFrame:
    """(i, n, s, g): per dimension the count, the sum, and the row of summed outer products.

    Tasks add up their own batches; their states are merged tile by tile as a tree.
    """
    return accumulate.moments(materialise(accumulate.accumulate(df, column, accumulate.MOMENTS)))


def covariance(sums: DataFrame) -> DataFrame:
    """(i, j, mean, cov) from :func:`moment_sums`; the divisor is n - 1, one row gives NaN."""
    # One row per dimension: bounded by the vector width.
    means = F.broadcast(sums.select(F.col("i").alias("j"), (F.col("s") / F.col("n")).alias("mean_j")))
    rows = sums.select("i", "n", "s", F.posexplode("g").alias("j", "gij"))
    rows = rows.withColumn("j", F.col("j").cast("bigint")).join(means, "j")
    cov = F.when(F.col("n") > 1, (F.col("gij") - F.col("s") * F.col("mean_j")) / (F.col("n") - 1))
    return rows.select("i", "j", (F.col("s") / F.col("n")).alias("mean"), F.coalesce(cov, F.lit(float("nan"))).alias("cov"))


def _statistics(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance as arrays: one row per dimension comes to the driver."""
    rows = sorted(moment_sums(df, column).collect(), key=lambda x: x["i"])
    if not rows:
        raise ValueError("no vectors")
    n = rows[0]["n"]
    s = np.array([x["s"] for x in rows])
    g = np.array([x["g"] for x in rows])
    return s / n, (g - np.outer(s, s) / n) / (n - 1)


def frechet_distance(real: DataFrame, fake: DataFrame, column: str = "v", eps: float = 1e-6) -> float:
    """Fréchet distance between the normal fits of two vector sets.

    The pass over the data is distributed; the driver sees two width-by-width matrices. A
    product that is not finite is taken again with ``eps`` on both diagonals.
    """
    mu1, c1 = _statistics(real, column)
    mu2, c2 = _statistics(fake, column)

    def root_trace(a: np.ndarray, b: np.ndarray) -> float:
        # The eigenvalues of a product of covariances are real and not negative.
        return float(np.sqrt(np.maximum(np.linalg.eigvals(a @ b).real, 0.0)).sum())

    if np.isfinite(c1 @ c2).all():
        trace = root_trace(c1, c2)
    else:
        off = np.eye(len(c1)) * eps
        trace = root_trace(np.nan_to_num(c1) + off, np.nan_to_num(c2) + off)
    d = mu1 - mu2
    return float(d @ d + np.trace(c1) + np.trace(c2) - 2.0 * trace)


def inception_score(probs: DataFrame) -> DataFrame:
    """(score) in one pass over (image_id, class, p) rows."""
    log_p = F.log(F.col("p") + F.lit(INCEPTION_EPS))
    per = probs.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * log_p).alias("k")
    )
    mean = F.log(F.col("s") / F.col("n") + F.lit(INCEPTION_EPS))
    return per.agg(F.exp(F.sum((F.col("k") - F.col("s") * mean) / F.col("n"))).alias("score"))


def split_inception_score(samples: DataFrame, order: str, probs: str, size: int = 5000) -> DataFrame:
    """(score): mean over consecutive blocks of ``size`` samples. ``probs`` is an array."""
    rows = number_rows(samples, [], [order], "_n")
    rows = rows.withColumn("block", F.floor((F.col("_n") - 1) / F.lit(size)))
    rows = rows.select("block", F.posexplode(probs).alias("class", "p"))
    per = rows.groupBy("block", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.log("p")).alias("k")
    )
    kl = F.sum((F.col("k") - F.col("s") * F.log(F.col("s") / F.col("n"))) / F.col("n"))
    return per.groupBy("block").agg(F.exp(kl).alias("b")).agg(F.avg("b").alias("score"))


def top_accuracy(rows: DataFrame, probs: str, label: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share of rows whose label is among the k most probable classes (lower class on ties)."""
    own = F.element_at(probs, (F.col(label) + 1).cast("int"))
    above = F.size(F.filter(probs, lambda p: p > own))
    level = F.size(F.filter(F.slice(probs, 1, F.col(label).cast("int")), lambda p: p == own))
    ranked = rows.withColumn("_rank", above + level)
    return ranked.agg(*[F.avg((F.col("_rank") < k).cast("int")).alias(f"top{k}") for k in ks])


def agreement(pairs: DataFrame, real: str = "real", fake: str = "fake") -> DataFrame:
    """(cosine_mean, cosine_std, l1, l2): population deviation, means of per-pair errors."""
    n = F.size(real)
    rows = pairs.select(
        vec.cosine(real, fake).alias("c"),
        (vec.absolute_distance(real, fake) / n).alias("a"),
        (vec.squared_distance(real, fake) / n).alias("s"),
    )
    return rows.agg(
        F.avg("c").alias("cosine_mean"),
        F.stddev_pop("c").alias("cosine_std"),
        F.avg("a").alias("l1"),
        F.avg("s").alias("l2"),
    )


def top_k_top_p(probs: DataFrame, k: int, mass: float, key: str = "image_id") -> DataFrame:
    """Rows that survive a top-k cut (ties kept) and then a cumulative-mass cut.

    The mass is taken over what the first cut left; the row that crosses it is kept. A
    group has one row per class.
    """
    group = Window.partitionBy(key)
    order = group.orderBy(F.desc("p"), "class")
    rows = probs.withColumn("_rank", F.rank().over(group.orderBy(F.desc("p")))).filter(F.col("_rank") <= k)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_total", F.sum("p").over(group)).withColumn(
        "_before", F.coalesce(F.sum("p").over(before), F.lit(0.0))
    )
    return rows.filter(F.col("_before") / F.col("_total") <= mass).drop("_rank", "_total", "_before")


def mean_entropy(rows: DataFrame, probs: str, eps: float = 1e-9) -> DataFrame:
    """(entropy): mean natural-log entropy of probability arrays."""
    h = vec.total(F.transform(probs, lambda p: -p * F.log(p + F.lit(eps))))
    return rows.agg(F.avg(h).alias("entropy"))
