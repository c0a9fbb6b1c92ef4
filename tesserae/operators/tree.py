"""Quadtrees as flat node tables ``(tree_id, lod, patch)``.

All trees are processed together. A tree has at most as many nodes as the full tree
(1365 on six levels), so a window or a group per ``tree_id`` is bounded whatever the
number of trees; the only key that grows with the data is the tree itself.

Tree ids are spread by hash *before* nodes are made of them: that moves one small row per
tree, splits the thousandfold growth evenly over all tasks, and leaves every node table
partitioned by tree, so the windows, groups and unions below need no further shuffle. Node
tables that come from elsewhere should pass :func:`together` once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry as geo
from tesserae.functions.core import uniform
from tesserae.operators import level_arrays

SIDES = geo.SIDES
#: Most trees a task holds when nodes are made of tree ids: sorts and groups of full trees then stay in memory.
TASK_TREES = 2048


def _with_children(nodes: DataFrame, grow: Column, sides: Sequence[int]) -> DataFrame:
    """Every node, followed by its four children where ``grow`` holds. One explode, no shuffle.

    Without lambda functions: with one, Spark compiles nothing of the explode, draws included. The
    first child is worked out before the explode, so that its arithmetic is compiled once.
    """
    lod, first, below = F.col("lod"), F.col("_first"), geo.by_level(F.col("lod") + 1, sides)
    own = F.struct(lod.alias("lod"), F.col("patch").alias("patch"))
    four = [F.struct((lod + 1).alias("lod"), c.alias("patch")) for c in (first, first + 1, first + below, first + below + 1)]
    both = F.when(F.col("_grow"), F.array(own, *four)).otherwise(F.array(own))
    keep = [c for c in nodes.columns if c not in ("lod", "patch")]
    rows = nodes.select(*keep, "lod", "patch", grow.alias("_grow"), geo.child_patches("lod", "patch", sides)[0].alias("_first"))
    return rows.select(*keep, F.explode(both).alias("n")).select(*keep, "n.lod", "n.patch")


def together(rows: DataFrame, trees: int = 0) -> DataFrame:
    """Partition by tree. The number is given so that small ids are not merged into few tasks, and
    grows with the number of ``trees``, where that is known."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, -(-trees // TASK_TREES)), "tree_id")


def _roots(tree_ids: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return together(tree_ids, tree_ids.count()).withColumn("lod", zero).withColumn("patch", zero)


def complete_trees(
    tree_ids: DataFrame, depth: int | None = None, sides: Sequence[int] = SIDES
) -> DataFrame:
    """All nodes of the full tree down to ``depth`` for every tree id. They are one constant list, exploded once."""
    last = len(sides) - 1 if depth is None else min(depth, len(sides) - 1)
    level, nodes = [0], [(0, 0)]
    for lod in range(last):
        side, below = sides[lod], sides[lod + 1]
        first = [p // side * 2 * below + p % side * 2 for p in level]
        level = [c for p in first for c in (p, p + 1, p + below, p + below + 1)]
        nodes += [(lod + 1, p) for p in level]
    lods, patches = (F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>") for v in zip(*nodes))
    roots = _roots(tree_ids)
    keep = [c for c in roots.columns if c not in ("lod", "patch")]
    every = F.arrays_zip(lods.alias("lod"), patches.alias("patch"))
    return roots.select(*keep, F.explode(every).alias("n")).select(*keep, "n.lod", "n.patch")


def probabilistic_trees(
    tree_ids: DataFrame,
    guaranteed_depth: int,
    probabilities: Sequence[float],
    sides: Sequence[int] = SIDES,
    draw: Column | None = None,
) -> DataFrame:
    """Random trees: full down to ``guaranteed_depth``, then grown with a probability per level.

    A level without a probability is not grown. The draw depends only on the node, so the
    whole growth is one pass over the tree ids without any shuffle.
    """
    draw = uniform("tree_id", "lod", "patch") if draw is None else draw
    depth = min(guaranteed_depth, len(sides) - 1)
    nodes = complete_trees(tree_ids, depth, sides)
    for i, p in enumerate(probabilities):
        lod = depth + i
        if lod >= len(sides) - 1:
            break
        nodes = _with_children(nodes, (F.col("lod") == lod) & (draw < p), sides)
    return nodes


def random_size_trees(
    tree_ids: DataFrame,
    min_internal: int,
    max_internal: int,
    guaranteed_depth: int = 0,
    sides: Sequence[int] = SIDES,
    seed: int = 0,
) -> DataFrame:
    """Random trees with a uniformly drawn number of internal nodes.

    Growth splits a uniformly chosen splittable leaf until the number is reached, which is
    sequential inside one tree and independent between trees: one task grows the trees of
    its own rows.
    """
    low = max(min_internal, (4**guaranteed_depth - 1) // 3)
    high = max(low, max_internal)
    last = len(sides) - 1
    forced = min(guaranteed_depth, last)

    def grow(tree_id: int) -> tuple[list[int], list[int]]:
        rng = np.random.default_rng([seed, int(tree_id)])
        wanted = int(rng.integers(low, high + 1))
        lods, patches, leaves = [0], [0], [(0, 0)]
        internal = 0
        while leaves and (internal < wanted or leaves[0][0] < forced):
            # Leaves of the guaranteed levels come first and are split in order.
            pick = 0 if leaves[0][0] < forced else int(rng.integers(len(leaves)))
            lod, patch = leaves[pick]
            if pick:
                leaves[pick] = leaves[-1]
                leaves.pop()
            elif lod < forced:
                leaves.pop(0)
            else:
                leaves[0] = leaves[-1]
                leaves.pop()
            internal += 1
            row, col = divmod(patch, sides[lod])
            side = sides[lod + 1]
            for down in (0, 1):
                for right in (0, 1):
                    child = (2 * row + down) * side + 2 * col + right
                    lods.append(lod + 1)
                    patches.append(child)
                    if lod + 1 < last:
                        leaves.append((lod + 1, child))
        return lods, patches

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                ids = batch["tree_id"].iloc[start : start + 500]
                grown = [grow(i) for i in ids]
                sizes = [len(lods) for lods, _ in grown]
                yield pd.DataFrame(
                    {
                        "tree_id": np.repeat(ids.to_numpy(), sizes),
                        "lod": np.concatenate([lods for lods, _ in grown]),
                        "patch": np.concatenate([patches for _, patches in grown]),
                    }
                )

    ids = together(tree_ids.select("tree_id"), tree_ids.count())
    return ids.mapInPandas(task, "tree_id bigint, lod bigint, patch bigint")


def copy_to_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.filter(F.col("lod") <= depth)


def nodes_at_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.filter(F.col("lod") == level)


def ordered(nodes: DataFrame, sides: Sequence[int] = SIDES) -> DataFrame:
    """Add ``idx`` (index in the full tree), ``pos`` (0-based place in breadth-first order of
    the tree) and ``level_pos`` (place inside the level)."""
    rows = nodes.withColumn("idx", geo.node_index("lod", "patch", sides))
    in_tree = Window.partitionBy("tree_id").orderBy("idx")
    in_level = Window.partitionBy("tree_id", "lod").orderBy("idx")
    rows = rows.withColumn("pos", F.row_number().over(in_tree).cast("bigint") - 1)
    return rows.withColumn("level_pos", F.row_number().over(in_level).cast("bigint") - 1)


def _over_ancestor(value: Column, level: int) -> Column:
    """Aggregate over the subtree below each node's ancestor on ``level``; needs ``_rank``.

    A window over (tree, ancestor) accepts a partitioning by tree, so going through all
    levels sorts a few times but does not shuffle.
    """
    ancestor = geo.ancestor_rank("lod", "_rank", level)
    return value.over(Window.partitionBy("tree_id", ancestor))


def _at(level: int, value: Column) -> Column:
    return F.when(F.col("lod") == level, value)


def reachable(nodes: DataFrame, sides: Sequence[int] = SIDES) -> DataFrame:
    """Drop orphans: nodes with any missing ancestor."""
    return level_arrays.linked(nodes, sides).select(*nodes.columns)


def with_parents(nodes: DataFrame, sides: Sequence[int] = SIDES) -> DataFrame:
    """Reachable nodes with ``idx``, ``pos`` and ``parent_pos``, the place of the parent (-1 for roots)."""
    return level_arrays.linked(nodes, sides)


def marked_candidates(nodes: DataFrame, sides: Sequence[int] = SIDES) -> DataFrame:
    """(tree_id, lod, patch, idx, status) of present nodes (1) and of absent nodes whose parent
    is present (0). Every other node of the full tree has status -1 and is not stored."""
    return level_arrays.marked(nodes, sides).drop("place")


def _present(nodes: DataFrame) -> DataFrame:
    """The present nodes of a node table or of marked rows."""
    return nodes.filter(F.col("status") == 1) if "status" in nodes.columns else nodes


def status_vectors(nodes: DataFrame, candidates: bool = True, sides: Sequence[int] = SIDES) -> DataFrame:
    """(tree_id, status[]): one entry per node of the full tree, -1 where a node is neither present
    nor a candidate. With ``candidates=False`` only present (1) and absent (-1) are told apart.
    ``nodes`` may be marked rows too."""
    return level_arrays.packed(_present(nodes), sides, candidates).select("tree_id", "status")


def split_labels(nodes: DataFrame, guaranteed_depth: int, sides: Sequence[int] = SIDES) -> DataFrame:
    """(tree_id, pos, label) of nodes that may split, ``pos`` counting nodes with status >= 0.

    ``nodes`` may be marked rows too."""
    free = (F.col("lod") >= guaranteed_depth) & (F.col("lod") < len(sides) - 1)
    rows = level_arrays.marked(_present(nodes), sides).filter(free)
    return rows.select("tree_id", F.col("place").alias("pos"), F.col("status").alias("label"))


def size_statistics(nodes: DataFrame, levels: int = len(SIDES)) -> DataFrame:
    """(lod, trees, min, max, mean, median, share) of nodes per level; lod -1 is the whole tree.

    The median is the upper one. It is read off the histogram of sizes, which has at most
    one bin per possible node count.
    """
    parts = [F.sum((F.col("lod") == i).cast("bigint")).alias(f"_{i}") for i in range(levels)]
    per_tree = nodes.groupBy("tree_id").agg(*parts, F.count(F.lit(1)).alias("_all"))
    sizes = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("lod"), F.col(f"_{i}").alias("n"), F.col("_all").alias("whole"))
            for i in range(levels)
        ],
        F.struct(F.lit(-1).cast("bigint").alias("lod"), F.col("_all").alias("n"), F.col("_all").alias("whole")),
    )
    rows = per_tree.select(F.explode(sizes).alias("s")).select("s.*")
    bins = rows.groupBy("lod", "n").agg(F.count(F.lit(1)).alias("c"), F.sum("whole").alias("w"))
    by_lod = Window.partitionBy("lod")
    upto = by_lod.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_cum", F.sum("c").over(upto)).withColumn("_trees", F.sum("c").over(by_lod))
    beyond = F.col("_cum") > F.floor(F.col("_trees") / 2)
    return bins.groupBy("lod").agg(
        F.sum("c").alias("trees"),
        F.min("n").alias("min"),
        F.max("n").alias("max"),
        (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min(F.when(beyond, F.col("n"))).alias("median"),
        (F.lit(100.0) * F.sum(F.col("n") * F.col("c")) / F.sum("w")).alias("share"),
    )


def heat_map(nodes: DataFrame, sides: Sequence[int] = SIDES) -> DataFrame:
    """(tree_id, y, x, heat): how many nodes cover each cell of the finest level."""
    finest = sides[-1]
    side = geo.by_level("lod", sides)
    scale = F.lit(finest) / side
    y0, x0 = geo.cell_row("patch", side) * scale, geo.cell_col("patch", side) * scale

    def span(start: Column) -> Column:
        return F.sequence(start.cast("bigint"), (start + scale - 1).cast("bigint"))

    rows = nodes.select("tree_id", F.explode(span(y0)).alias("y"), span(x0).alias("xs"))
    rows = rows.select("tree_id", "y", F.explode("xs").alias("x"))
    return rows.groupBy("tree_id", "y", "x").agg(F.count(F.lit(1)).alias("heat"))


def choose_splits(
    candidates: DataFrame, gain: str = "gain", scale: dict[int, float] | None = None
) -> DataFrame:
    """Add ``chosen``: per tree and level the best candidates, as many as lie above the mean.

    The count is scaled per level by ``scale``. A single candidate is never chosen.
    """
    group = Window.partitionBy("tree_id", "lod")
    rows = candidates.withColumn("_mean", F.avg(gain).over(group))
    above = (F.col(gain) > F.col("_mean")).cast("bigint")
    n = F.sum(above).over(group).cast("double")
    for level, factor in (scale or {}).items():
        n = F.when(F.col("lod") == level, F.floor(F.sum(above).over(group) * F.lit(factor)).cast("double")).otherwise(n)
    n = F.when(F.count(F.lit(1)).over(group) > 1, n).otherwise(F.lit(0.0))
    place = F.row_number().over(group.orderBy(F.desc(gain), "patch"))
    rows = rows.withColumn("_n", n).withColumn("_place", place)
    return rows.withColumn("chosen", F.col("_place") <= F.col("_n")).drop("_mean", "_n", "_place")


def keep_top_half(candidates: DataFrame, score: str, share: float = 0.5) -> DataFrame:
    """The best ``int(n * share)`` candidates of every tree and level."""
    group = Window.partitionBy("tree_id", "lod")
    place = F.row_number().over(group.orderBy(F.desc(score), "patch"))
    rows = candidates.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_place", place)
    return rows.filter(F.col("_place") <= F.floor(F.col("_n") * F.lit(share))).drop("_n", "_place")


def greedy_search(
    tree_ids: DataFrame,
    scored: Callable[[DataFrame], DataFrame],
    guaranteed_depth: int,
    scale: dict[int, float] | None = None,
    sides: Sequence[int] = SIDES,
) -> DataFrame:
    """Grow all trees level by level, splitting the chosen candidates of each level.

    ``scored`` adds a ``gain`` column to a node table.
    """
    nodes = complete_trees(tree_ids, guaranteed_depth, sides)
    for lod in range(guaranteed_depth, len(sides) - 1):
        rows = choose_splits(scored(nodes), "gain", scale)
        keep = [c for c in rows.columns if c not in ("gain", "chosen")]
        grow = (F.col("lod") == lod) & F.col("chosen")
        nodes = _with_children(rows.select(*keep, "chosen"), grow, sides).select(*keep)
    return nodes


# Largest score drop at which the children of a level are given up.
PRUNE_TOLERANCE = {3: 0.3, 4: 0.2}


def prune(
    nodes: DataFrame,
    drops: DataFrame,
    tolerance: dict[int, float] | None = None,
    sides: Sequence[int] = SIDES,
) -> DataFrame:
    """Remove everything below nodes whose score drop is within the level's tolerance.

    ``drops`` is ``(tree_id, lod, patch, drop)``. Levels are handled finest first. The marks
    travel with the nodes, and a window over (tree, ancestor on that level) tells each node
    whether it lies below a mark, which also removes deeper descendants.
    """
    columns = nodes.columns
    limits = tolerance or PRUNE_TOLERANCE
    small = F.lit(False)
    for lod, limit in limits.items():
        small = small | ((F.col("lod") == lod) & (F.col("drop") <= limit))
    marks = drops.filter(small).select("tree_id", "lod", "patch", F.lit(True).alias("_gone"))
    rows = nodes.withColumn("_gone", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("_rank", geo.interleaved("lod", "patch", sides))
    for lod in sorted(limits, reverse=True):
        given_up = _over_ancestor(F.max(_at(lod, F.col("_gone"))), lod)
        rows = rows.withColumn("_up", F.when(F.col("lod") > lod, given_up))
        rows = rows.filter(F.col("_gone") | ~F.coalesce("_up", F.lit(False))).drop("_up")
    return rows.filter(~F.col("_gone")).select(*columns)


def removed_children(level: DataFrame, parents: DataFrame, sides: Sequence[int] = SIDES) -> DataFrame:
    """Nodes of a level that are no child of ``parents`` (a set difference)."""
    below = parents.select(
        "tree_id", (F.col("lod") + 1).alias("lod"), F.explode(geo.child_patches("lod", "patch", sides)).alias("patch")
    )
    return level.select("tree_id", "lod", "patch").exceptAll(below.distinct())


def roll_up(nodes: DataFrame, value: str, sides: Sequence[int] = SIDES) -> DataFrame:
    """Give every coarser node the mean ``value`` of its present children, 0 if it has none.

    Values of the finest level are taken from the input; levels are filled finest first.
    """
    rows = nodes.withColumn("_rank", geo.interleaved("lod", "patch", sides))
    for level in range(len(sides) - 2, -1, -1):
        rows = rows.withColumn("_mean", _over_ancestor(F.avg(_at(level + 1, F.col(value))), level))
        own = F.when(F.col("lod") == level, F.coalesce("_mean", F.lit(0.0))).otherwise(F.col(value))
        rows = rows.withColumn(value, own).drop("_mean")
    return rows.drop("_rank")
