"""Token sequences in long form: one row per token, keyed by (sample, position).

The long form needs no per-sample arrays, so a sample of any length stays spread over
the cluster. ``tesserae.functions.vectors`` has the array forms for samples that already
are one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.core import uniform
from tesserae.operators.ordering import number_rows

#: Positions of a sample that are sorted together.
BLOCK = 4096


def lengths(tokens: DataFrame, sample: str = "sample_key") -> DataFrame:
    return tokens.groupBy(sample).agg(F.count(F.lit(1)).alias("len"))


def truncate(tokens: DataFrame, length: int) -> DataFrame:
    """Keep the first ``length`` tokens of every sample. A filter: no shuffle."""
    return tokens.filter(F.col("pos") < length)


def truncate_random(tokens: DataFrame, seed: str = "cut", sample: str = "sample_key") -> DataFrame:
    """Cut each sample after a seeded random length between one and its own length."""
    ends = lengths(tokens, sample).withColumn(
        "keep", F.floor(uniform(F.lit(seed), sample) * F.col("len")) + 1
    )
    return tokens.join(ends.select(sample, "keep"), sample).filter(F.col("pos") < F.col("keep"))


def pad(tokens: DataFrame, batch: Column, fill: int = -1, sample: str = "sample_key") -> DataFrame:
    """Extend every sample to the longest of its batch with ``fill`` rows; keeps ``len``.

    ``batch`` is an expression of the sample key.
    """
    sizes = lengths(tokens, sample).withColumn("batch", batch)
    widest = sizes.groupBy("batch").agg(F.max("len").alias("width"))
    sizes = sizes.join(widest, "batch")
    filler = (
        sizes.filter(F.col("len") < F.col("width"))
        .select(
            "batch",
            sample,
            "len",
            F.explode(F.sequence(F.col("len"), F.col("width") - 1)).alias("pos"),
        )
        .select(
            "batch",
            sample,
            "len",
            "pos",
            *[F.lit(fill).cast("bigint").alias(c) for c in ("code", "lod", "patch")],
        )
    )
    real = tokens.join(sizes.select("batch", sample, "len"), sample)
    return real.select(filler.columns).unionByName(filler)


def next_token_pairs(padded: DataFrame, sample: str = "sample_key", fill: int = -1) -> DataFrame:
    """(sample, pos, input, target, valid) for next-token training.

    The target at a position is its own code, the input is the code before it (NULL at the
    first position, where the class takes its place); filled inputs become 0. Rows are sorted
    in blocks of a sample, and the last position of a block is sent to the next block too: one
    shuffle, no self-join and no table of all rows in memory. Of rows with equal positions the largest code counts.
    """
    code, pos = F.col("code"), F.col("pos")
    block = F.floor(pos / F.lit(BLOCK))
    own = F.struct(block.alias("_block"), F.lit(True).alias("_own"))
    following = F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))
    both = F.when(F.pmod(pos, F.lit(BLOCK)) == BLOCK - 1, F.array(own, following)).otherwise(F.array(own))
    sent = padded.select(sample, "pos", "code", F.explode(both).alias("_to")).select(sample, "pos", "code", "_to.*")
    order = Window.partitionBy(sample, "_block").orderBy("pos")
    pairs = sent.select(
        sample,
        "pos",
        "_own",
        F.max(code).over(order.rangeBetween(0, 0)).alias("target"),
        F.max(code).over(order.rangeBetween(-1, -1)).alias("prev"),
        (F.row_number().over(order) == F.rank().over(order)).alias("_first"),
    )
    return pairs.filter(F.col("_own") & F.col("_first") & F.col("target").isNotNull()).select(
        sample,
        "pos",
        F.when(F.col("prev") == fill, F.lit(0).cast("bigint")).otherwise(F.col("prev")).alias("input"),
        "target",
        (F.col("target") != fill).alias("valid"),
    )


def drop_labels(samples: DataFrame, num_classes: int, p: float, seed: str = "drop") -> DataFrame:
    """Replace the class by the null class ``num_classes`` with probability ``p``."""
    dropped = uniform(F.lit(seed), "sample_key") < p
    null_class = F.lit(num_classes).cast("bigint")
    return samples.withColumn(
        "class_id", F.when(dropped, null_class).otherwise(F.col("class_id"))
    )


def mask_tokens(tokens: DataFrame, mask_id: int, sample: str = "sample_key") -> DataFrame:
    """Mask a random share of every sample: arccos schedule, random permutation, at least one.

    Adds ``masked`` and the visible ``token``.
    """
    ratio = F.acos(uniform(F.lit("ratio"), sample)) / F.lit(1.5707963267948966)
    wanted = lengths(tokens, sample).select(
        sample, F.greatest(F.lit(1.0), F.rint(F.col("len") * ratio)).cast("bigint").alias("n_masked")
    )
    shuffled = tokens.withColumn("_draw", uniform(F.lit("perm"), sample, "pos"))
    ranked = number_rows(shuffled, [sample], ["_draw", "pos"], "_rank")
    out = ranked.join(wanted, sample).withColumn("masked", F.col("_rank") <= F.col("n_masked"))
    token = F.when(F.col("masked"), F.lit(mask_id).cast("bigint")).otherwise(F.col("code"))
    return out.withColumn("token", token).drop("_draw", "_rank")


def masked_accuracy(rows: DataFrame, sample: str = "sample_key") -> DataFrame:
    """Mean over samples of the share of masked positions predicted right."""
    hit = (F.col("pred") == F.col("code")).cast("int")
    per = rows.filter("masked").groupBy(sample).agg(F.avg(hit).alias("acc"))
    return per.agg(F.avg("acc").alias("masked_accuracy"))


def token_accuracy(rows: DataFrame) -> DataFrame:
    """Share of all valid positions predicted right."""
    return rows.agg(F.avg((F.col("pred") == F.col("code")).cast("int")).alias("token_accuracy"))


def weighted_loss(rows: DataFrame, loss: Column, unmasked_weight: float) -> DataFrame:
    """Weighted mean loss: masked rows weigh one, the others ``unmasked_weight``."""
    w = F.when(F.col("masked"), F.lit(1.0)).otherwise(F.lit(unmasked_weight))
    return rows.agg((F.sum(loss * w) / (F.sum(w) + F.lit(1e-8))).alias("weighted_loss"))


def flatten_nodes(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """(tree, lods[], patches[]) in position order.

    One array per tree, at most as long as the full tree (1365 nodes on six levels).
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lod", "patch")))
    return nodes.groupBy(tree).agg(ordered.alias("n")).select(
        tree,
        F.transform("n", lambda s: s["lod"]).alias("lods"),
        F.transform("n", lambda s: s["patch"]).alias("patches"),
    )
