"""Label map scores: IoU per class, by object size, on boundaries; F-measure; image accuracy.

All of them start from counts of (image, truth, prediction), at most classes squared per
image, so the windows and groups after that never see pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import broadcast_if_small

# Fixed value: truth class of pixels that are not scored.
IGNORED = 1000
IOU_EPS = 1e-10


def scored_pixels(seg: DataFrame) -> DataFrame:
    """Drop ignored pixels from all aligned maps at once."""
    return seg.filter(F.col("gt") != IGNORED)


def remap(seg: DataFrame, match: DataFrame) -> DataFrame:
    """Replace the predicted class through a match map ``(source, target)``."""
    pairs = match.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    rows = seg.join(broadcast_if_small(pairs), F.col("pred") == F.col("_s"), "left")
    return rows.withColumn("pred", F.col("_t")).drop("_s", "_t")


def counts(seg: DataFrame, *keys: str) -> DataFrame:
    """(keys, gt, pred, n)."""
    return seg.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def _areas(pairs: DataFrame, classes: int, *keys: str) -> DataFrame:
    """(keys, cls, t, p, tp): predicted area, true area and their overlap per class.

    Classes outside 0..classes-1 are left out.
    """
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    same = F.col("gt") == F.col("pred")
    sides = F.array(
        F.struct(F.col("pred").alias("cls"), n.alias("t"), zero.alias("p"), F.when(same, n).otherwise(zero).alias("tp")),
        F.struct(F.col("gt").alias("cls"), zero.alias("t"), n.alias("p"), zero.alias("tp")),
    )
    rows = pairs.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    rows = rows.filter((F.col("cls") >= 0) & (F.col("cls") < classes))
    return rows.groupBy(*keys, "cls").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])


def _iou() -> Column:
    return F.col("tp") / (F.col("t") + F.col("p") - F.col("tp") + F.lit(IOU_EPS))


def class_iou(pairs: DataFrame, classes: int) -> DataFrame:
    """(cls, t, p, tp, iou) in percent for all classes; absent classes score 0."""
    spark = pairs.sparkSession
    every = spark.range(classes).select(
        F.col("id").alias("cls"), *[F.lit(0).cast("bigint").alias(c) for c in ("t", "p", "tp")]
    )
    rows = _areas(pairs, classes).select("cls", "t", "p", "tp").unionByName(every)
    rows = rows.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])
    return rows.withColumn("iou", _iou() * 100)


def mean_iou(per_class: DataFrame) -> DataFrame:
    """Mean over all classes, the absent ones included as 0."""
    return per_class.agg(F.avg("iou").alias("miou"))


#: Fixed value: number of size classes.
SIZE_BUCKETS = 4


def _size_bucket(share: Column) -> Column:
    return F.when(share <= 5, 0).when(share <= 25, 1).when(share <= 50, 2).otherwise(3).cast("bigint")


def size_parts(pairs: DataFrame) -> DataFrame:
    """Add ``bucket`` to per-image counts: the size class of the true object.

    ``pairs`` has (image_id, gt, …, n). Background rows are repeated for every bucket the
    image has an object in.
    """
    image = Window.partitionBy("image_id")
    cls = Window.partitionBy("image_id", "gt")
    share = F.ceil(F.lit(100.0) * F.sum("n").over(cls) / F.sum("n").over(image))
    own = F.when(F.col("gt") != 0, _size_bucket(share))
    rows = pairs.repartition("image_id").withColumn("_own", own)
    rows = rows.withColumn("_all", F.collect_set("_own").over(image))
    buckets = F.when(F.col("gt") == 0, F.col("_all")).otherwise(F.array("_own"))
    return rows.withColumn("bucket", F.explode(buckets)).drop("_own", "_all")


def iou_by_size(parts: DataFrame, classes: int) -> DataFrame:
    """(bucket, miou): mean IoU in percent over classes that occur in the truth, 0 for a bucket without any."""
    areas = _areas(parts, classes, "bucket").filter(F.col("p") > 0)
    found = areas.groupBy("bucket").agg((F.avg(_iou()) * 100).alias("miou"))
    every = parts.sparkSession.range(SIZE_BUCKETS).select(F.col("id").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("miou", F.lit(0.0)).alias("miou"))


def f_measures(pairs: DataFrame, beta: float = 0.3, eps: float = 1e-20) -> DataFrame:
    """(image_id, f) of the foreground."""

    def area(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("double")

    true, found = F.col("gt") > 0, F.col("pred") > 0
    rows = pairs.groupBy("image_id").agg(
        area(true).alias("t"), area(found).alias("p"), area(true & found).alias("tp")
    )
    recall, precision = F.col("tp") / (F.col("t") + eps), F.col("tp") / (F.col("p") + eps)
    f = (1 + beta) * precision * recall / (beta * precision + recall + eps)
    return rows.select("image_id", f.alias("f"))


def image_hits(pairs: DataFrame, classes: int) -> DataFrame:
    """(image_id, hit): the largest predicted foreground class also occurs in the truth.

    Equal areas are decided for the lower class.
    """
    areas = _areas(pairs, classes, "image_id").filter(F.col("cls") > 0)
    best = F.struct(F.col("t"), -F.col("cls"))
    rows = areas.groupBy("image_id").agg(
        F.max_by(F.struct("t", "p"), best).alias("b")
    )
    hit = (F.col("b.t") > 0) & (F.col("b.p") > 0)
    images = pairs.select("image_id").distinct()
    return images.join(rows.select("image_id", hit.cast("int").alias("hit")), "image_id", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(0))
    )


def boundary_radius(height: int, width: int, ratio: float = 0.03) -> int:
    return max(1, round(ratio * (height**2 + width**2) ** 0.5))


def boundary_maps(seg: DataFrame, columns: list[str], height: int, width: int, radius: int) -> DataFrame:
    """Add ``b_<column>``: class + 1 on boundary pixels, else 0.

    A pixel is inside when its whole (2 radius + 1) square lies in the image and has one
    class; that is a minimum and maximum along rows, then along columns. Both windows stay
    within the partitioning by image.
    """
    rows = seg.repartition("image_id")
    across = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    for c in columns:
        rows = rows.withColumn(f"_lo_{c}", F.min(c).over(across)).withColumn(f"_hi_{c}", F.max(c).over(across))
    for c in columns:
        rows = rows.withColumn(f"_lo2_{c}", F.min(f"_lo_{c}").over(down)).withColumn(
            f"_hi2_{c}", F.max(f"_hi_{c}").over(down)
        )
    within = (
        (F.col("y") >= radius) & (F.col("y") < height - radius) & (F.col("x") >= radius) & (F.col("x") < width - radius)
    )
    drop = []
    for c in columns:
        calm = within & (F.col(f"_lo2_{c}") == F.col(f"_hi2_{c}"))
        rows = rows.withColumn(f"b_{c}", F.when(calm, F.lit(0).cast("bigint")).otherwise(F.col(c) + 1))
        drop += [f"_lo_{c}", f"_hi_{c}", f"_lo2_{c}", f"_hi2_{c}"]
    return rows.drop(*drop)


def boundary_counts(maps: DataFrame, *keys: str) -> DataFrame:
    """(keys, gt, pred, n) of boundary classes; -1 stands for pixels off the boundary."""
    rows = maps.select(*keys, (F.col("b_gt") - 1).alias("gt"), (F.col("b_pred") - 1).alias("pred"))
    return counts(rows, *keys)


def boundary_size_parts(maps: DataFrame) -> DataFrame:
    """Boundary counts with the size bucket of the true object at each pixel."""
    rows = maps.groupBy("image_id", "gt", "b_gt", "b_pred").agg(F.count(F.lit(1)).alias("n"))
    parts = size_parts(rows)
    return parts.select("bucket", (F.col("b_gt") - 1).alias("gt"), (F.col("b_pred") - 1).alias("pred"), "n")
