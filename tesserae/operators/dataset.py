"""Sharded sample datasets: repair, relabel, expand, order, batch, split and resample."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.core import uniform
from tesserae.operators.ordering import number_rows, running_totals
from tesserae.session import broadcast_if_small

# Image member extensions in order of preference.
IMAGE_EXTENSIONS = ("jpg", "png", "jpeg", "webp")
# Crop range of each view set and the shard offset it is written to.
VIEW_SETS = ((1.1, 0), (1.05, 71))


def first_present(df: DataFrame, columns: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rename the first present alternative to ``name``; rows with none are returned apart."""
    value = F.coalesce(*[F.col(c) for c in columns])
    out = df.withColumn(name, value)
    return out.filter(F.col(name).isNotNull()), out.filter(F.col(name).isNull())


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of ``df`` that are in ``names``; missing names are not an error."""
    return df.select([c for c in df.columns if c in set(names)])


def convert(df: DataFrame, column: str, to: str = "int") -> tuple[DataFrame, DataFrame]:
    """Cast ``column``; rows that do not convert go to the second frame unchanged."""
    value = F.col(column).try_cast(to)
    good = df.filter(value.isNotNull()).withColumn(column, value)
    return good, df.filter(value.isNull())


def look_up(df: DataFrame, dictionary: DataFrame, text: str, name: str, value: str) -> DataFrame:
    """Left join with a label dictionary; unknown labels get NULL.

    The dictionary is broadcast when it is small; otherwise the join shuffles and adaptive
    execution splits a label that holds most rows.
    """
    pairs = dictionary.select(F.col(name).alias("_name"), F.col(value))
    return df.join(broadcast_if_small(pairs), F.col(text) == F.col("_name"), "left").drop("_name")


def known_only(looked_up: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Split a looked-up frame into rows with a known label and rejected rows."""
    known = F.col(value).isNotNull()
    return looked_up.filter(known), looked_up.filter(~known)


def view_plan(image_size: int, crop_range: float) -> list[tuple[int, int, int, bool]]:
    """(view, x0, y0, mirrored) of the ten crops of a square image.

    Corners, then centre, then the same five of the mirrored image.
    """
    full = int(image_size * crop_range)
    far = full - image_size
    mid = round(far / 2)
    spots = [(0, 0), (far, 0), (0, far), (far, far), (mid, mid)]
    return [(i, *spots[i % 5], i >= 5) for i in range(10)]


def expand_views(
    samples: DataFrame, image_size: int = 256, view_sets: Sequence[tuple[float, int]] = VIEW_SETS
) -> DataFrame:
    """Ten view rows per sample and view set: geometry and target shard, not pixels.

    The plan is a literal array that is exploded in place, so nothing is shuffled.
    """
    plan = [
        F.struct(
            F.lit(int(image_size * crop)).cast("bigint").alias("resized"),
            F.lit(offset).cast("bigint").alias("shard_offset"),
            F.lit(view).cast("bigint").alias("view"),
            F.lit(x0).cast("bigint").alias("x0"),
            F.lit(y0).cast("bigint").alias("y0"),
            F.lit(mirrored).alias("mirrored"),
        )
        for crop, offset in view_sets
        for view, x0, y0, mirrored in view_plan(image_size, crop)
    ]
    rows = samples.select("*", F.explode(F.array(*plan)).alias("_v"))
    return rows.select(
        (F.col("shard") + F.col("_v.shard_offset")).alias("shard"),
        F.concat_ws("_", "key", F.col("_v.view").cast("string")).alias("key"),
        *[c for c in samples.columns if c not in ("shard", "key")],
        "_v.resized",
        "_v.x0",
        "_v.y0",
        "_v.mirrored",
    )


def move_plan(listing: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst): where each listed file goes, from its label's class folder."""
    known, _ = known_only(look_up(listing, classes, "label", "name", "folder"), "folder")
    return known.select(
        F.col("file").alias("src"), F.concat_ws("/", F.col("folder"), F.col("file")).alias("dst")
    )


def pair_by_key(
    real: DataFrame, fake: DataFrame, key: str, real_col: str = "real", fake_col: str = "fake"
) -> DataFrame:
    """Full outer pairing of two array columns, with a verdict per key.

    ``state`` is ``paired``, ``no_fake``, ``no_real`` or ``shape`` (sizes differ).
    """
    state = (
        F.when(F.col(fake_col).isNull(), "no_fake")
        .when(F.col(real_col).isNull(), "no_real")
        .when(F.size(real_col) != F.size(fake_col), "shape")
        .otherwise("paired")
    )
    return real.join(fake, key, "full_outer").withColumn("state", state)


def pair_by_position(left: DataFrame, right: DataFrame, order_left, order_right) -> DataFrame:
    """Pair the n-th rows of two sorted listings; empty when their counts differ."""
    a = number_rows(left, [], order_left, "position")
    b = number_rows(right, [], order_right, "position")
    out = a.join(b, "position")
    return out if left.count() == right.count() else out.limit(0)


def number_samples(samples: DataFrame, order: Sequence[str | Column], digits: int = 8) -> DataFrame:
    """Running sample number over the sorted listing, and the zero-padded key made of it."""
    out = number_rows(samples, [], order, "number")
    return out.withColumn("number", F.col("number") - 1).withColumn(
        "sample", F.lpad(F.col("number").cast("string"), digits, "0")
    )


def assign_shards(numbered: DataFrame, max_count: int) -> DataFrame:
    """New shard every ``max_count`` samples of a numbered listing."""
    return numbered.withColumn("shard", F.floor(F.col("number") / F.lit(max_count)))


def batches(samples: DataFrame, order, size: int, keep_partial: bool = True) -> DataFrame:
    """Batch number of every sample inside its shard; a short last batch is kept or dropped."""
    rows = number_rows(samples, ["shard"], order, "_n")
    rows = rows.withColumn("batch", F.floor((F.col("_n") - 1) / F.lit(size)))
    if keep_partial:
        return rows.drop("_n")
    totals = samples.groupBy("shard").agg(F.count(F.lit(1)).alias("_total"))
    whole = (F.col("batch") + 1) * size <= F.col("_total")
    return rows.join(broadcast_if_small(totals), "shard").filter(whole).drop("_n", "_total")


def shuffled(samples: DataFrame, seed: str, key: str = "key") -> DataFrame:
    """A seeded global random order, as ``place``. Stronger than a shuffle buffer."""
    drawn = samples.withColumn("_draw", uniform(F.lit(seed), key))
    return number_rows(drawn, [], ["_draw", key], "place").drop("_draw")


def split_among_ranks(numbered: DataFrame, ranks: int, number: str = "number") -> DataFrame:
    """Contiguous split: the first ``total % ranks`` ranks get one sample more."""
    total = numbered.agg(F.max(number)).first()[0]
    base, extra = divmod((total if total is not None else -1) + 1, ranks)
    n, big = F.col(number), extra * (base + 1)
    later = F.lit(extra) + F.floor((n - big) / F.lit(max(base, 1)))
    rank = F.when(n < big, F.floor(n / F.lit(base + 1))).otherwise(later)
    return numbered.withColumn("rank", rank.cast("bigint"))


def split_shards(shards: DataFrame, nodes: int, workers: int) -> DataFrame:
    """Node by shard modulo, then worker by the node's own shard sequence."""
    return shards.withColumn("node", F.pmod("shard", F.lit(nodes))).withColumn(
        "worker", F.pmod(F.floor(F.col("shard") / F.lit(nodes)), F.lit(workers))
    )


def epoch_size(samples: int, global_batch: int, workers: int) -> int:
    """Samples in one epoch, rounded up to whole batches of every worker."""
    return math.ceil(samples / (global_batch * workers)) * workers * global_batch


def resampled_epoch(
    samples: DataFrame, order: Sequence[str], global_batch: int, workers: int, seed: str = "epoch"
) -> DataFrame:
    """One epoch of shards drawn with replacement: (draw, place, batch, shard, key).

    Shards are drawn until their samples fill the epoch; the last one is cut at the end.
    """
    spark = samples.sparkSession
    sizes = samples.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    sizes = number_rows(sizes, [], ["shard"], "choice")
    facts = sizes.agg(F.count(F.lit(1)), F.sum("size"), F.min("size")).first()
    shards, total, smallest = (int(x) for x in facts)
    wanted = epoch_size(total, global_batch, workers)
    sizes = broadcast_if_small(sizes)

    def draw(count: int) -> DataFrame:
        draws = spark.range(count).withColumnRenamed("id", "draw")
        choice = F.floor(uniform(F.lit(seed), "draw") * shards) + 1
        return draws.withColumn("choice", choice).join(sizes, "choice")

    # As many draws as shards of mean size would need, doubled until they fill the epoch.
    count, most = math.ceil(wanted * shards / total), math.ceil(wanted / smallest)
    while count < most and draw(count).agg(F.sum("size")).first()[0] < wanted:
        count = min(2 * count, most)
    drawn = draw(count)
    drawn = running_totals(drawn, [], ["draw"], {"end": "size"})
    drawn = drawn.withColumn("start", F.col("end") - F.col("size")).filter(F.col("start") < wanted)
    inside = number_rows(samples, ["shard"], order, "_n")
    rows = inside.join(drawn.select("draw", "shard", "start"), "shard")
    rows = rows.withColumn("place", F.col("start") + F.col("_n") - 1)
    rows = rows.filter(F.col("place") < wanted)
    return rows.withColumn("batch", F.floor(F.col("place") / F.lit(global_batch))).drop("_n", "start")


def evaluation_batch(samples: DataFrame, name: str, num: int) -> DataFrame:
    """The first ``num`` samples in name order; an empty input is an error."""
    if samples.isEmpty():
        raise ValueError("no samples found")
    return samples.orderBy(name).limit(num)
