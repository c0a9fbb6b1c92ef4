"""Pixel tables ``(image_id, y, x, …)``: entropy maps, cell choice, PSNR, contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.core import share_entropy
from tesserae.functions.vectors import mean_squared_error
from tesserae.operators.quantiles import exact_percentiles
from tesserae.session import materialise

#: Entropy given to cells that reach over the image edge.
EDGE_ENTROPY = 1e6
ENTROPY_EPS = 1e-10


def patch_entropy(
    pixels: DataFrame, sizes: Sequence[int], height: int, width: int, bins: int = 512
) -> DataFrame:
    """(image_id, size, cy, cx, entropy) of grey values, for all cell sizes in one pass.

    Cells of the last row and column that reach over the edge get ``EDGE_ENTROPY``.
    """
    level = F.least(F.greatest(F.floor(F.col("gray") * F.lit(bins / 256.0)), F.lit(0)), F.lit(bins - 1))
    rows = pixels.select(
        "image_id", "y", "x", level.alias("bin"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    )
    rows = rows.withColumn("cy", F.floor(F.col("y") / F.col("size"))).withColumn(
        "cx", F.floor(F.col("x") / F.col("size"))
    )
    cell = ["image_id", "size", "cy", "cx"]
    counts = rows.groupBy(*cell, "bin").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / (F.col("size") * F.col("size"))
    out = counts.groupBy(*cell).agg(F.sum(share_entropy(p, ENTROPY_EPS)).alias("entropy"))
    over = ((F.col("cy") + 1) * F.col("size") > height) | ((F.col("cx") + 1) * F.col("size") > width)
    return out.withColumn("entropy", F.when(over, F.lit(EDGE_ENTROPY)).otherwise(F.col("entropy")))


def choose_cells(entropies: DataFrame, thresholds: dict[int, float]) -> DataFrame:
    """Add ``chosen``: a cell is kept when it is calm enough and no coarser kept cell covers it.

    ``thresholds`` maps every size but the smallest to its limit; the smallest size takes
    what is left. One shuffle by image; every size is a window inside that partitioning.
    """
    smallest = F.col("size") != F.lit(-1)
    calm = F.lit(False)
    for size, limit in thresholds.items():
        calm = calm | ((F.col("size") == size) & (F.col("entropy") < limit))
        smallest = smallest & (F.col("size") != size)
    rows = entropies.repartition("image_id").withColumn("_calm", calm)
    covered = F.lit(False)
    names = []
    for size in sorted(thresholds, reverse=True):
        inside = F.col("size") <= size
        window = Window.partitionBy(
            "image_id",
            F.when(inside, F.floor(F.col("cy") * F.col("size") / size)),
            F.when(inside, F.floor(F.col("cx") * F.col("size") / size)),
        )
        name = f"_by{size}"
        names.append(name)
        rows = rows.withColumn(name, F.max((F.col("_calm") & (F.col("size") == size)).cast("int")).over(window))
        covered = covered | ((F.col("size") < size) & (F.col(name) == 1))
    return rows.withColumn("chosen", (F.col("_calm") | smallest) & ~covered).drop("_calm", *names)


def psnr(pairs: DataFrame, real: str = "real", fake: str = "fake") -> DataFrame:
    """Add the three PSNR readings of a pair of [0, 1] arrays.

    ``psnr`` has a small term in the logarithm; ``psnr_exact`` is infinite for equal images;
    ``psnr_8bit`` compares the 8-bit versions.
    """

    def eight(c: str) -> Column:
        return F.transform(c, lambda x: F.floor(x * 255.0).cast("double"))

    mse = mean_squared_error(real, fake)
    mse8 = mean_squared_error(eight(real), eight(fake))
    infinite = F.lit(float("inf"))
    return (
        pairs.withColumn("psnr", F.log10(mse + F.lit(1e-10)) * -10.0)
        .withColumn("psnr_exact", F.when(mse == 0, infinite).otherwise(F.log10(F.lit(1.0) / mse) * 10.0))
        .withColumn("psnr_8bit", F.when(mse8 == 0, infinite).otherwise(F.log10(F.lit(255.0) / F.sqrt(mse8)) * 20.0))
    )


def patch_gains(pixels: DataFrame, side: int, size: int) -> DataFrame:
    """(image_id, patch, gain): PSNR of ``test`` minus PSNR of ``base`` inside each cell.

    ``pixels`` has ``real``, ``base`` and ``test`` values. Cells are ``size`` wide on a grid
    of ``side`` cells; pixels outside the grid belong to no cell.
    """
    cy, cx = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    rows = pixels.withColumn("cy", cy).withColumn("cx", cx)
    rows = rows.filter((F.col("cy") < side) & (F.col("cx") < side))
    rows = rows.withColumn("patch", F.col("cy") * side + F.col("cx"))

    def mse(c: str) -> Column:
        return F.avg((F.col("real") - F.col(c)) * (F.col("real") - F.col(c)))

    out = rows.groupBy("image_id", "patch").agg(mse("base").alias("_b"), mse("test").alias("_t"))
    eps = F.lit(1e-10)
    gain = (F.log10(F.lit(1.0) / (F.col("_t") + eps)) - F.log10(F.lit(1.0) / (F.col("_b") + eps))) * 10.0
    return out.select("image_id", "patch", gain.alias("gain"))


def contribution(rows: DataFrame) -> DataFrame:
    """(pos, y, x, mean_abs, mean_sq): effect of replacing the token at ``pos`` on each pixel."""
    d = F.col("base") - F.col("changed")
    return rows.groupBy("pos", "y", "x").agg(F.avg(F.abs(d)).alias("mean_abs"), F.avg(d * d).alias("mean_sq"))


def contribution_by_position(per_pixel: DataFrame) -> DataFrame:
    """(pos, mean_abs, log_abs, mean_sq, log_sq): pixel means per position and their logarithms."""
    out = per_pixel.groupBy("pos").agg(F.avg("mean_abs").alias("mean_abs"), F.avg("mean_sq").alias("mean_sq"))
    return out.withColumn("log_abs", F.log("mean_abs")).withColumn("log_sq", F.log("mean_sq"))


def distribution(
    df: DataFrame, value: str, shares: Sequence[float], threshold: float
) -> DataFrame:
    """(name, value): mean, population deviation, extremes, percentiles, share below a limit.

    The column is stored once, as the percentiles read it four times.
    """
    df = materialise(df.select(F.col(value).cast("double").alias(value)))
    v = F.col(value)
    row = df.agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).cast("double").alias("min"),
        F.max(v).cast("double").alias("max"),
        F.avg((v < threshold).cast("int")).alias("below"),
    )
    names = ["mean", "std", "min", "max", "below"]
    simple = row.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("i")
    ).select("i.name", "i.value")
    cuts = exact_percentiles(df, value, shares).select(
        F.concat(F.lit("p"), F.format_string("%02d", (F.col("share") * 100 + 0.5).cast("int"))).alias("name"), "value"
    )
    return simple.unionByName(cuts)
