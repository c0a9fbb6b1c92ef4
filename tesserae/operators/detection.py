"""Detection scores: truth tables, box overlap, greedy matching, average precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ordering import number_rows
from tesserae.session import broadcast_if_small, materialise

# Overlap thresholds .50 to .95, recall levels 0 to 1, detections scored per
# image and category.
THRESHOLDS = tuple(k / 20 for k in range(10, 20))
RECALL_LEVELS = 100
MAX_DETECTIONS = 100
#: Thresholds are bits of one integer.
MAX_THRESHOLDS = 62
#: Most blocks of detections whose counts are sent to all tasks; a block is a batch of rows.
MAX_BLOCKS = 50_000
# Box areas that count as small, medium and large.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def annotations(boxes: DataFrame, order: list[str]) -> DataFrame:
    """Truth table from detections: running ``annotation_id`` by image, and box area."""
    rows = number_rows(boxes, [], ["image_id", *order], "annotation_id")
    return rows.withColumn("area", F.col("w") * F.col("h"))


def categories(boxes: DataFrame) -> DataFrame:
    """(category_id, name) of the categories that occur."""
    return boxes.select("category_id", F.col("category_id").cast("string").alias("name")).distinct()


def in_truth(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections on images the truth knows."""
    return detections.join(truth.select("image_id").distinct(), "image_id", "left_semi")


def best_detections(detections: DataFrame, limit: int = MAX_DETECTIONS) -> DataFrame:
    """The ``limit`` highest scores per image and category, with their ``det_rank`` from 0.

    Scoring only looks at these. The limit is applied before the shuffle as well, so an
    image with very many detections sends at most ``limit`` rows per task.
    """
    best = Window.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "det_id")
    rows = detections.withColumn("det_rank", F.row_number().over(best).cast("bigint") - 1)
    return rows.filter(F.col("det_rank") < limit)


def _corners(box_format: str, p: str) -> tuple[Column, Column, Column, Column]:
    x, y, w, h = (F.col(p + c) for c in "xywh")
    if box_format == "centre":
        x, y = x - w / 2, y - h / 2
    elif box_format != "corner":
        raise ValueError("box_format is 'corner' or 'centre'")
    return x, y, x + w, y + h


def overlaps(
    best: DataFrame, truth: DataFrame, min_iou: float = 0.5, box_format: str = "corner"
) -> DataFrame:
    """(image_id, category_id, det_id, det_rank, gt_id, gt_area, iou) of overlapping boxes.

    One side has at most ``MAX_DETECTIONS`` rows per key, so the output grows with the
    truth, and a key that holds most truth rows is split by adaptive execution.
    """
    d = best.select("image_id", "category_id", "det_id", "det_rank", *[F.col(c).alias(f"d_{c}") for c in "xywh"])
    g = truth.select(
        "image_id", "category_id", F.col("det_id").alias("gt_id"), *[F.col(c).alias(f"g_{c}") for c in "xywh"]
    )
    dx0, dy0, dx1, dy1 = _corners(box_format, "d_")
    gx0, gy0, gx1, gy1 = _corners(box_format, "g_")
    zero = F.lit(0)
    wide = F.greatest(F.least(dx1, gx1) - F.greatest(dx0, gx0), zero)
    high = F.greatest(F.least(dy1, gy1) - F.greatest(dy0, gy0), zero)
    inter = wide * high
    iou = inter / (F.col("d_w") * F.col("d_h") + F.col("g_w") * F.col("g_h") - inter)
    rows = d.join(g, ["image_id", "category_id"]).withColumn("iou", iou)
    return rows.filter(F.col("iou") >= min_iou).select(
        "image_id", "category_id", "det_id", "det_rank", "gt_id", (F.col("g_w") * F.col("g_h")).alias("gt_area"), "iou"
    )


def _outside(size: Column, area: str) -> Column:
    low, high = AREAS[area]
    return (size < low) | (size > high)


def matches(
    pairs: DataFrame,
    thresholds: tuple[float, ...] = THRESHOLDS,
    limit: int = MAX_DETECTIONS,
    area: str = "all",
) -> DataFrame:
    """(det_id, hit[]): for each threshold 1 when the detection gets a truth box, else 0.

    Detections choose in score order, each takes its best free box, the later one of equal
    overlaps. Boxes outside ``area`` are only taken when no other is left, and give -1. At
    most ``limit`` detections choose, so a detection never needs more than its ``limit`` best
    boxes inside and as many outside, whatever the threshold: a group is at most twice
    ``limit`` squared pairs.
    """
    n = len(thresholds)
    if n > MAX_THRESHOLDS:
        raise ValueError(f"at most {MAX_THRESHOLDS} thresholds")
    masks = _settled(pairs, tuple(thresholds), limit, area)
    hit = [F.when(_bit("soft", i) == 1, -1).otherwise(_bit("taken", i)) for i in range(n)]
    return masks.select("det_id", F.array(*hit).alias("hit"))


def _tasks(df: DataFrame) -> int:
    """Few bytes but much work per row: a given number of partitions keeps it on all tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bit(mask: str, i: int) -> Column:
    return F.shiftright(mask, i).bitwiseAND(F.lit(1)).cast("int")


def _settled(pairs: DataFrame, thresholds: tuple[float, ...], limit: int, area: str) -> DataFrame:
    """(det_id, taken, soft): bit ``i`` says that the detection got a box at threshold ``i``, or one outside.

    One sort by (image, category, order of choice) and one Arrow pass. The pass holds a
    batch and the group that reaches over its end.
    """
    pairs = pairs.withColumn("soft", _outside(F.col("gt_area"), area))
    own = Window.partitionBy("det_id", "soft").orderBy(F.desc("iou"), F.desc("gt_id"))
    rows = pairs.withColumn("_c", F.row_number().over(own)).filter(F.col("_c") <= limit)
    rows = rows.select("image_id", "category_id", "det_rank", "soft", "iou", "gt_id", "det_id")
    rows = rows.repartition(_tasks(pairs), "image_id", "category_id").sortWithinPartitions(
        "image_id", "category_id", "det_rank", "soft", F.desc("iou"), F.desc("gt_id")
    )
    ids = rows.schema["det_id"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _last_group(batch)
            # The group at the end of the rows before may go on in this batch.
            if cut or (open_rows and not _same_group(open_rows[-1], batch)):
                if not cut:
                    yield _choose(pa.Table.from_batches(open_rows), thresholds)
                    open_rows = []
                else:
                    yield _choose(pa.Table.from_batches([*open_rows, batch.slice(0, cut)]), thresholds)
                    open_rows, batch = [], batch.slice(cut)
            open_rows.append(batch)
        if open_rows:
            yield _choose(pa.Table.from_batches(open_rows), thresholds)

    return rows.mapInArrow(settle, f"det_id {ids}, taken bigint, soft bigint")


def _values(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_pandas().to_numpy()


def _changes(rows: pa.RecordBatch | pa.Table, *names: str) -> np.ndarray:
    """Whether a row differs in ``names`` from the row before; the first one does."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in names:
        value = _values(rows, name)
        new[1:] |= value[1:] != value[:-1]
    return new


def _last_group(batch: pa.RecordBatch) -> int:
    """First row of the last group."""
    return int(np.flatnonzero(_changes(batch, "image_id", "category_id"))[-1])


def _same_group(before: pa.RecordBatch, after: pa.RecordBatch) -> bool:
    return all(before.column(c)[-1].equals(after.column(c)[0]) for c in ("image_id", "category_id"))


def _choose(rows: pa.Table, thresholds: tuple[float, ...]) -> pa.RecordBatch:
    """Settle whole groups, all thresholds at once and one pair of every group per step.

    A set bit of a detection or a box says that it is free at that threshold. A pair takes
    the bits that both have and that its overlap allows.
    """
    new_group = _changes(rows, "image_id", "category_id")
    start = np.flatnonzero(new_group)
    size = np.diff(np.append(start, rows.num_rows))
    group = np.cumsum(new_group) - 1
    rank = _values(rows, "det_rank")
    new_det = new_group.copy()
    new_det[1:] |= rank[1:] != rank[:-1]
    det = np.cumsum(new_det) - 1
    # Boxes are told apart inside their group.
    _, box = np.unique(_values(rows, "gt_id"), return_inverse=True)
    _, box = np.unique(group * (int(box.max()) + 1) + box, return_inverse=True)
    soft = _values(rows, "soft")
    iou = _values(rows, "iou")
    allowed = np.zeros(len(iou), np.int64)
    for i, t in enumerate(thresholds):
        allowed |= (iou >= t).astype(np.int64) << i
    every = (1 << len(thresholds)) - 1
    free_det = np.full(int(det[-1]) + 1, every, np.int64)
    free_box = np.full(int(box.max()) + 1, every, np.int64)
    outside = np.zeros(len(free_det), np.int64)
    by_size = np.argsort(-size, kind="stable")
    start, size = start[by_size], size[by_size]
    # Groups with more than k pairs, for every k.
    left = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
    for k, m in enumerate(left):
        at = start[:m] + k
        d, b = det[at], box[at]
        take = allowed[at] & free_det[d] & free_box[b]
        free_det[d] ^= take
        free_box[b] ^= take
        outside[d] |= np.where(soft[at], take, 0)
    ids = rows.column("det_id").take(pa.array(np.flatnonzero(new_det))).combine_chunks()
    columns = [ids, pa.array(every & ~free_det), pa.array(outside)]
    return pa.RecordBatch.from_arrays(columns, names=["det_id", "taken", "soft"])


def in_area(boxes: DataFrame, area: str) -> DataFrame:
    """Boxes whose area counts as ``area``."""
    return boxes.filter(~_outside(F.col("w") * F.col("h"), area))


def precision_points(
    best: DataFrame,
    matched: DataFrame,
    truth: DataFrame,
    thresholds: tuple[float, ...] = THRESHOLDS,
    area: str = "all",
) -> DataFrame:
    """(category_id, threshold, rank, tp, recall, precision) at every true positive.

    Detections matched to boxes outside ``area``, and unmatched ones that lie outside
    themselves, are not counted.

    Ranks run over a whole category in score order, which is where one group may hold most
    rows: they are counted inside slices of one range sort, and the counts of a category's
    slices before are added after. Precision between true positives is never the best for any
    recall, so those rows are not needed.
    """
    n = len(thresholds)
    inside = ~_outside(F.col("w") * F.col("h"), area)
    rows = best.select("category_id", "image_id", "det_id", (-F.col("score")).alias("_order"), inside.alias("inside"))
    rows = rows.join(matched, "det_id", "left")
    taken, soft = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i in range(n):
        state = F.coalesce(F.get("hit", F.lit(i)), F.lit(0))
        taken = taken + F.when(state == 1, F.lit(1 << i).cast("bigint")).otherwise(0)
        soft = soft + F.when(state == -1, F.lit(1 << i).cast("bigint")).otherwise(0)
    rows = rows.select("category_id", "_order", "image_id", "det_id", "inside", taken.alias("taken"), soft.alias("soft"))
    every = F.lit((1 << n) - 1).cast("bigint")
    counted = F.when(F.col("inside"), every.bitwiseAND(F.bitwise_not("soft"))).otherwise(F.col("taken"))
    order = ["category_id", "_order", "image_id", "det_id"]
    sliced = rows.repartitionByRange(_tasks(best), *order).sortWithinPartitions(*order)
    sliced = sliced.select("category_id", "taken", counted.alias("counted"), F.spark_partition_id().alias("slice"))
    # Range bounds come from a sample: points and counts of slices are stored together so that they agree.
    kind = rows.schema["category_id"].dataType.simpleString()
    shape = f"category_id {kind}, slice int, level int, tp bigint, rank bigint, point boolean"
    counts = materialise(sliced.mapInArrow(_counter(n), shape))
    slices = Window.partitionBy("category_id", "level").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.filter(~F.col("point")).select(
        "category_id",
        "slice",
        "level",
        F.coalesce(F.sum("tp").over(slices), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("rank").over(slices), F.lit(0)).alias("rank0"),
    )
    points = counts.filter("point").join(broadcast_if_small(before), ["category_id", "slice", "level"])
    wanted = in_area(truth, area).groupBy("category_id").agg(F.count(F.lit(1)).alias("boxes"))
    tp, rank = F.col("tp") + F.col("tp0"), F.col("rank") + F.col("rank0")
    # Sent to the points: moved by their few categories, they would meet in a few tasks.
    points = points.join(broadcast_if_small(wanted), "category_id")
    return points.select(
        "category_id",
        F.get(F.array(*[F.lit(t) for t in thresholds]), F.col("level")).alias("threshold"),
        rank.alias("rank"),
        tp.alias("tp"),
        (tp / F.col("boxes")).alias("recall"),
        (tp / rank).alias("precision"),
    )


def _counter(n: int):
    """Arrow pass over one slice: running counts per category at true positives, and the counts at its end."""
    names = ["category_id", "slice", "level", "tp", "rank", "point"]

    def made(category: pa.Array, slice_no: int, level, tp, rank, point: bool) -> pa.RecordBatch:
        size = len(level)
        columns = [
            category,
            pa.array(np.full(size, slice_no, np.int32)),
            pa.array(level.astype(np.int32)),
            pa.array(tp),
            pa.array(rank),
            pa.array(np.full(size, point)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, slice_no = None, 0
        sums = np.zeros((2, n), np.int64)
        every = np.arange(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            slice_no = batch.column("slice")[0].as_py()
            starts = np.flatnonzero(_changes(batch, "category_id"))
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if last is not None and not last[0].equals(part.column("category_id")[0]):
                    yield made(last.take(pa.array(np.zeros(n, int))), slice_no, every, *sums, False)
                    sums = np.zeros((2, n), np.int64)
                last = part.column("category_id").slice(0, 1)
                bits = [(_values(part, c)[:, None] >> every) & 1 for c in ("taken", "counted")]
                upto = [s + b.cumsum(axis=0) for s, b in zip(sums, bits, strict=True)]
                sums = np.stack([u[-1] for u in upto])
                at, level = np.nonzero(bits[0])
                yield made(
                    part.column("category_id").take(pa.array(at)), slice_no, level, upto[0][at, level], upto[1][at, level], True
                )
        if last is not None:
            yield made(last.take(pa.array(np.zeros(n, int))), slice_no, every, *sums, False)

    return count


def average_precision(
    points: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS
) -> DataFrame:
    """(category_id, threshold, ap, max_recall) over the 101 recall levels.

    At each level counts the best precision at that recall or beyond. Points are first
    reduced to the best precision per level.
    """
    levels = RECALL_LEVELS
    up = F.floor(F.col("recall") * levels) + 1
    level = F.when(up * F.lit(0.01) <= F.col("recall"), up).when(
        (up - 1) * F.lit(0.01) <= F.col("recall"), up - 1
    ).otherwise(up - 2)
    best = points.groupBy("category_id", "threshold", F.least(level, F.lit(levels)).alias("level")).agg(
        F.max("precision").alias("p"), F.max("recall").alias("r")
    )
    return _curves(best, truth, thresholds)


def _curves(best: DataFrame, truth: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Average precision from the best precision ``p`` and recall ``r`` of every recall level."""
    levels = RECALL_LEVELS
    curve = best.groupBy("category_id", "threshold").agg(
        F.array_sort(F.collect_list(F.struct("level", "p"))).alias("c"), F.max("r").alias("max_recall")
    )
    at = F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda i: F.coalesce(
            F.array_max(F.transform(F.filter("c", lambda s: s["level"] >= i), lambda s: s["p"])), F.lit(0.0)
        ),
    )
    total = F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(levels + 1))
    curve = curve.select("category_id", "threshold", total.alias("ap"), "max_recall")
    every = categories(truth).select(
        "category_id", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    )
    out = every.join(curve, ["category_id", "threshold"], "left")
    return out.select(
        "category_id",
        "threshold",
        F.coalesce("ap", F.lit(0.0)).alias("ap"),
        F.coalesce("max_recall", F.lit(0.0)).alias("max_recall"),
    )


def evaluate(
    detections: DataFrame,
    truth: DataFrame,
    thresholds: tuple[float, ...] = THRESHOLDS,
    limit: int = MAX_DETECTIONS,
    box_format: str = "corner",
    area: str = "all",
) -> DataFrame:
    """Per category and threshold: average precision and reached recall.

    Categories without a truth box in ``area`` are left out.
    """
    best = best_detections(in_truth(detections, truth), limit)
    pairs = overlaps(best, truth, min(thresholds), box_format)
    return _evaluate(best, pairs, truth, thresholds, limit, area)


def _evaluate(best: DataFrame, pairs: DataFrame, truth: DataFrame, thresholds, limit: int, area: str) -> DataFrame:
    return _scored(best, matches(pairs, thresholds, limit, area), truth, thresholds, area)


def _scored(best: DataFrame, matched: DataFrame, truth: DataFrame, thresholds, area: str) -> DataFrame:
    points = precision_points(best, matched, truth, thresholds, area)
    return average_precision(points, in_area(truth, area), thresholds)


def summary(per_category: DataFrame) -> DataFrame:
    """(ap, ap50, ap75, ar): means over categories and thresholds."""
    t = F.col("threshold")
    return per_category.agg(
        F.avg("ap").alias("ap"),
        F.avg(F.when(t == 0.5, F.col("ap"))).alias("ap50"),
        F.avg(F.when(t == 0.75, F.col("ap"))).alias("ap75"),
        F.avg("max_recall").alias("ar"),
    )


#: What the summary measures: most detections of an image and category, and the area that counts.
_PARTS = ((100, "all"), (10, "all"), (1, "all"), (100, "small"), (100, "medium"), (100, "large"))


def _settled_areas(pairs: DataFrame, thresholds: tuple[float, ...], limit: int, areas: tuple[str, ...]) -> DataFrame:
    """:func:`_settled` for several areas after one sort: (det_id, taken_0, soft_0, taken_1, …) in the order of ``areas``.

    Boxes outside the same areas are ranked together, so for each area the best ``limit`` are among those kept.
    """
    outside = [_outside(F.col("gt_area"), a).cast("long") for a in areas]
    kind = sum((F.shiftleft(o, i) for i, o in enumerate(outside)), F.lit(0).cast("bigint"))
    rows = pairs.select("image_id", "category_id", "det_rank", kind.alias("kind"), "iou", "gt_id", "det_id")
    rows = rows.repartition(_tasks(pairs), "image_id", "category_id")
    own = Window.partitionBy("image_id", "category_id", "det_rank", "kind").orderBy(F.desc("iou"), F.desc("gt_id"))
    rows = rows.withColumn("_c", F.row_number().over(own)).filter(F.col("_c") <= limit).drop("_c")
    rows = rows.sortWithinPartitions("image_id", "category_id", "det_rank", "kind", F.desc("iou"), F.desc("gt_id"))
    ids = rows.schema["det_id"].dataType.simpleString()
    names = ["det_id", *[f"{n}_{i}" for i in range(len(areas)) for n in ("taken", "soft")]]

    def choose(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(groups).combine_chunks()
        det = np.cumsum(_changes(table, "image_id", "category_id", "det_rank"))
        kinds, columns, done = _values(table, "kind"), [], {}
        _, box = np.unique(_values(table, "gt_id"), return_inverse=True)
        for i in range(len(areas)):
            soft = (kinds >> i) & 1 == 1
            key = soft.tobytes()
            if key not in done:
                # In the order of choice: boxes of the area first, then by overlap, later ones first.
                order = pa.array(np.lexsort((-box, -_values(table, "iou"), soft, det)))
                done[key] = _choose(table.append_column("soft", pa.array(soft)).take(order), thresholds)
            columns += done[key].columns[1:]
        return pa.RecordBatch.from_arrays([done[key].column(0), *columns], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _last_group(batch)
            if held and not cut and not _same_group(held[-1], batch):
                yield choose(held)
                held = []
            elif cut:
                yield choose([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield choose(held)

    return rows.mapInArrow(settle, f"det_id {ids}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def _blocks(n: int):
    """Arrow pass over one slice: the counted rows of a category in a batch as one row, with their counts at each level."""
    every = np.arange(n)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_changes(batch, "category_id"))
            rows = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                bits = [_values(batch, c)[lo:hi] for c in ("taken", "counted")]
                sums = [((b[:, None] >> every) & 1).sum(0).tolist() for b in bits]
                rows.append((batch.column("category_id")[int(lo)].as_py(), batch.column("slice")[0].as_py(), nr, *[b.tobytes() for b in bits], *sums))
                nr += 1
            lists = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            kinds = [batch.schema.field("category_id").type, pa.int32(), pa.int64(), *lists]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["category_id", "slice", "nr", "taken", "counted", "tp", "rank"])

    return made


def _best_of_blocks(n: int):
    """Arrow pass over blocks with the counts before them: the best precision and recall at each level and recall level."""
    every = np.arange(n)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("taken", "counted", "tp0", "rank0", "boxes")}
                taken, counted = (((np.frombuffer(row[c], np.int64) >> every[:, None]) & 1) for c in ("taken", "counted"))
                # One row of these per level, so that the points of a level follow each other.
                level, at = np.nonzero(taken)
                if not len(level):
                    continue
                tp = taken.cumsum(axis=1)[level, at] + np.array(row["tp0"])[level]
                rank = counted.cumsum(axis=1)[level, at] + np.array(row["rank0"])[level]
                # A level whose area has no box has no point either.
                recall, precision = tp / np.array(row["boxes"])[level], tp / rank
                up = np.floor(recall * RECALL_LEVELS).astype(np.int64) + 1
                step = np.where(up * 0.01 <= recall, up, np.where((up - 1) * 0.01 <= recall, up - 1, up - 2))
                step = np.minimum(step, RECALL_LEVELS)
                first = np.flatnonzero(np.append(True, (level[1:] != level[:-1]) | (step[1:] != step[:-1])))
                category = batch.column("category_id").take(pa.array(np.full(len(first), i)))
                columns = [level[first], step[first], np.maximum.reduceat(precision, first), np.maximum.reduceat(recall, first)]
                yield pa.RecordBatch.from_arrays([category, *map(pa.array, columns)], names=["category_id", "part", "level", "p", "r"])

    return best


def _best_points(rows: DataFrame, n: int, boxes: DataFrame) -> DataFrame:
    """(category_id, part, level, p, r): best precision and recall of each of ``n`` bits and recall level.

    ``rows`` is (category_id, _order, image_id, det_id, taken, counted) with ``n`` bits each; ``boxes`` has an
    array of ``n`` counts of boxes per category. Ranks are counted as in :func:`precision_points`, but
    no point is a row: what is stored are the bits of the sorted detections, in blocks with their counts.
    """
    order = ["category_id", "_order", "image_id", "det_id"]
    rows = rows.filter("counted != 0 AND category_id IS NOT NULL")
    sliced = rows.repartitionByRange(_tasks(rows), *order).sortWithinPartitions(*order)
    sliced = sliced.select("category_id", "taken", "counted", F.spark_partition_id().alias("slice"))
    kind = rows.schema["category_id"].dataType.simpleString()
    shape = f"category_id {kind}, slice int, nr bigint, taken binary, counted binary, tp array<bigint>, rank array<bigint>"
    blocks = materialise(sliced.mapInArrow(_blocks(n), shape))
    one = blocks.select("category_id", "slice", "nr", F.posexplode(F.arrays_zip("tp", "rank")).alias("part", "c"))
    upto = Window.partitionBy("category_id", "part").orderBy("slice", "nr").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f"c.{c}").over(upto), F.lit(0)).alias(f"{c}0") for c in ("tp", "rank")]
    one = one.select("category_id", "slice", "nr", "part", *sums)
    by_part = F.array_sort(F.collect_list(F.struct("part", "tp0", "rank0")))
    before = one.groupBy("category_id", "slice", "nr").agg(by_part.alias("b")).select("category_id", "slice", "nr", "b.tp0", "b.rank0")
    known = blocks.drop("tp", "rank").join(broadcast_if_small(before, MAX_BLOCKS), ["category_id", "slice", "nr"])
    known = known.join(broadcast_if_small(boxes), "category_id")
    found = known.mapInArrow(_best_of_blocks(n), f"category_id {kind}, part bigint, level bigint, p double, r double")
    return found.groupBy("category_id", "part", "level").agg(F.max("p").alias("p"), F.max("r").alias("r"))


def full_summary(detections: DataFrame, truth: DataFrame, box_format: str = "corner") -> DataFrame:
    """(name, value) of the twelve usual numbers: precision overall, at .50 and .75 and by
    area; recall at 1, 10 and 100 detections and by area. -1 where no truth box counts.

    Overlaps are matched once for all areas, and detections are sorted once for all numbers:
    a bit of an integer says what a detection counts for at each threshold of each part. Detections choose in
    order of rank, so what the first ranks get does not depend on the later ones.
    """
    best = materialise(best_detections(in_truth(detections, truth)))
    pairs = overlaps(best, truth, min(THRESHOLDS), box_format)
    areas, n = tuple(AREAS), len(THRESHOLDS)
    matched = _settled_areas(pairs, THRESHOLDS, MAX_DETECTIONS, areas)
    size = F.col("w") * F.col("h")
    light = best.select("category_id", "image_id", "det_id", "det_rank", (-F.col("score")).alias("_order"), size.alias("size"))
    rows = light.join(matched, "det_id", "left")
    every, none = F.lit((1 << n) - 1).cast("bigint"), F.lit(0).cast("bigint")
    taken, counted = none, none
    for i, (limit, area) in enumerate(_PARTS):
        k = areas.index(area)
        soft = F.coalesce(f"soft_{k}", none)
        own = F.coalesce(F.col(f"taken_{k}").bitwiseAND(F.bitwise_not(f"soft_{k}")), none)
        all_of = F.when(~_outside(F.col("size"), area), every.bitwiseAND(F.bitwise_not(soft))).otherwise(own)
        first = F.col("det_rank") < limit
        taken = taken + F.when(first, F.shiftleft(own, i * n)).otherwise(none)
        counted = counted + F.when(first, F.shiftleft(all_of, i * n)).otherwise(none)
    rows = rows.select("category_id", "_order", "image_id", "det_id", taken.alias("taken"), counted.alias("counted"))
    counts = [F.sum((~_outside(size, a)).cast("bigint")).alias(a) for a in areas]
    boxes = materialise(truth.groupBy("category_id").agg(*counts))
    per_part = boxes.select("category_id", F.flatten(F.array(*[F.array_repeat(F.col(a), n) for _, a in _PARTS])).alias("boxes"))
    found = materialise(_best_points(rows, n * len(_PARTS), per_part))

    def part(i: int, names: dict[str, str]) -> DataFrame:
        own = found.filter(F.floor(F.col("part") / n) == i)
        threshold = F.get(F.array(*[F.lit(t) for t in THRESHOLDS]), (F.col("part") % n).cast("int"))
        own = own.select("category_id", threshold.alias("threshold"), "level", "p", "r")
        row = summary(_curves(own, boxes.filter(F.col(_PARTS[i][1]) > 0), THRESHOLDS))
        items = [F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(-1.0)).alias("value")) for n, c in names.items()]
        return row.select(F.explode(F.array(*items)).alias("i")).select("i.name", "i.value")

    out = part(0, {"ap": "ap", "ap50": "ap50", "ap75": "ap75", "ar100": "ar"})
    for i, (limit, area) in enumerate(_PARTS[1:], 1):
        out = out.unionByName(part(i, {f"ar{limit}": "ar"} if area == "all" else {f"ap_{area}": "ap", f"ar_{area}": "ar"}))
    return out
