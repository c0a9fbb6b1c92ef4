"""Images as one row each, ``(image_id, height, width, <flat row-major arrays>)`` of their own size.

Boundaries, class counts and cell entropies are made inside the reading task from
summed-area tables, so no pixel becomes a row and none is shuffled. A row must hold its
image; an Arrow batch holds ``spark.sql.execution.arrow.maxRecordsPerBatch`` of them, which
large images need lowered. Images without a pixel give no rows; null arrays count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.grid import EDGE_ENTROPY, ENTROPY_EPS
from tesserae.operators.segmentation import boundary_radius
from tesserae.session import broadcast_if_small

#: A task sends its rows on when it holds this many.
OUT_ROWS = 50_000


def window_sums(mask: np.ndarray, up: int, down: int, left: int, right: int) -> np.ndarray:
    """Sum of ``mask`` over rows y-up..y+down-1 and columns x-left..x+right-1, cut at the edges."""
    table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(mask, axis=0), axis=1, out=table[1:, 1:])
    y, x = np.arange(mask.shape[0]), np.arange(mask.shape[1])
    y0, y1 = np.maximum(y - up, 0), np.clip(y + down, 0, mask.shape[0])
    x0, x1 = np.maximum(x - left, 0), np.clip(x + right, 0, mask.shape[1])
    return table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]


def boundary(labels: np.ndarray, radius: int) -> np.ndarray:
    """Class + 1 on boundary pixels, else 0.

    A pixel is inside when its (2 radius + 1) square lies in the image and no two
    neighbours in it differ.
    """
    height, width = labels.shape
    across, down = np.zeros((2, height, width), bool)
    across[:, :-1] = labels[:, :-1] != labels[:, 1:]
    down[:-1] = labels[:-1] != labels[1:]
    edges = window_sums(across, radius, radius + 1, radius, radius)
    edges += window_sums(down, radius, radius, radius, radius + 1)
    inside = np.zeros((height, width), bool)
    inside[radius : height - radius, radius : width - radius] = True
    return np.where(inside & (edges == 0), 0, labels + 1)


def _each(
    images: DataFrame, columns: Sequence[str], shape: str, make: Callable[..., list[np.ndarray]]
) -> DataFrame:
    """Rows ``(image_id, shape)`` that ``make(*arrays of one image)`` gives as columns."""
    names = [part.split()[0] for part in shape.split(", ")]
    kind = images.schema["image_id"].dataType.simpleString()

    def table(ids: pa.Array, images_of: list[np.ndarray], made: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.concatenate(images_of))), *columns], names=["image_id", *names]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides = batch.column("image_id"), [batch.column(c).to_pylist() for c in ("height", "width")]
            flat = [batch.column(c) for c in columns]
            images_of, made, held = [], [], 0
            for i, (height, width) in enumerate(zip(*sides, strict=True)):
                cells = [c[i].values for c in flat]
                if not height or not width or any(c is None for c in cells):
                    continue
                made.append(make(*[c.to_numpy(zero_copy_only=False).reshape(height, width) for c in cells]))
                images_of.append(np.full(len(made[-1][0]), i))
                held += len(images_of[-1])
                if held >= OUT_ROWS:
                    yield table(ids, images_of, made)
                    images_of, made, held = [], [], 0
            if made:
                yield table(ids, images_of, made)

    rows = images.select("image_id", "height", "width", *columns)
    return rows.mapInArrow(run, f"image_id {kind}, {shape}")


def label_counts(images: DataFrame, ratio: float = 0.03) -> DataFrame:
    """(image_id, gt, pred, b_gt, b_pred, n) of images with label maps ``gt`` and ``pred``.

    ``b_`` is the class + 1 on the boundary of that map and 0 off it; the radius follows from
    the diagonal of each image.
    """

    def make(gt: np.ndarray, pred: np.ndarray) -> list[np.ndarray]:
        radius = boundary_radius(*gt.shape, ratio)
        maps = [gt, pred, boundary(gt, radius), boundary(pred, radius)]
        keys, n = np.unique(np.stack([m.ravel() for m in maps]), axis=1, return_counts=True)
        return [*keys.astype(np.int64), n.astype(np.int64)]

    return _each(images, ["gt", "pred"], "gt bigint, pred bigint, b_gt bigint, b_pred bigint, n bigint", make)


def remap_counts(counts: DataFrame, match: DataFrame) -> DataFrame:
    """Replace predicted classes of :func:`label_counts` by ``match (source, target)``.

    Boundaries stay those of the raw prediction, so classes that become one keep the line
    between them. Classes without a target give null, on the boundary as well.
    """
    pairs = match.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    rows = counts.join(broadcast_if_small(pairs), F.col("pred") == F.col("_s"), "left")
    edge = F.when(F.col("b_pred") == 0, F.col("b_pred")).otherwise(F.col("_t") + 1)
    rows = rows.withColumn("b_pred", edge).withColumn("pred", F.col("_t")).drop("_s", "_t")
    return rows.groupBy("image_id", "gt", "pred", "b_gt", "b_pred").agg(F.sum("n").alias("n"))


def _entropies(gray: np.ndarray, size: int, bins: int) -> np.ndarray:
    """Entropy per cell; cells that reach over the edge get ``EDGE_ENTROPY``."""
    height, width = gray.shape
    rows, cols = -(-height // size), -(-width // size)
    level = np.clip(np.floor(gray * (bins / 256.0)), 0, bins - 1).astype(np.int64)
    cell = (np.arange(height) // size)[:, None] * cols + (np.arange(width) // size)[None, :]
    keys, n = np.unique(cell * bins + level, return_counts=True)
    p = n / (size * size)
    out = np.bincount(keys // bins, -p * np.log2(p + ENTROPY_EPS), rows * cols).reshape(rows, cols)
    out[height // size :, :] = EDGE_ENTROPY
    out[:, width // size :] = EDGE_ENTROPY
    return out


def cell_entropy(images: DataFrame, sizes: Sequence[int], bins: int = 512) -> DataFrame:
    """(image_id, size, cy, cx, entropy) of grey values ``gray`` for all cell sizes."""

    def make(gray: np.ndarray) -> list[np.ndarray]:
        return _stacked({s: [_entropies(gray, s, bins)] for s in sizes})

    return _each(images, ["gray"], "size int, cy bigint, cx bigint, entropy double", make)


def choose_cells(images: DataFrame, thresholds: dict[int, float], smallest: int, bins: int = 512) -> DataFrame:
    """(image_id, size, cy, cx, chosen): calm cells that no coarser calm cell covers.

    ``thresholds`` maps every size but ``smallest`` to its limit; the smallest size takes what
    is left. A cell belongs to the coarser cell that its first pixel lies in.
    """

    def make(gray: np.ndarray) -> list[np.ndarray]:
        calm = {s: _entropies(gray, s, bins) < limit for s, limit in sorted(thresholds.items(), reverse=True)}
        made = {}
        for size in [*calm, smallest]:
            shape = -(-gray.shape[0] // size), -(-gray.shape[1] // size)
            chosen = calm[size].copy() if size in calm else np.ones(shape, bool)
            for coarse in calm:
                if coarse > size:
                    over = calm[coarse][np.arange(shape[0]) * size // coarse]
                    chosen &= ~over[:, np.arange(shape[1]) * size // coarse]
            made[size] = [chosen]
        return _stacked(made)

    return _each(images, ["gray"], "size int, cy bigint, cx bigint, chosen boolean", make)


def _stacked(by_size: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Columns (size, cy, cx, values) of the cells of all sizes."""
    parts = []
    for size, values in by_size.items():
        cy, cx = np.indices(values[0].shape)
        parts.append([np.full(cy.size, size, np.int32), cy.ravel(), cx.ravel(), *[v.ravel() for v in values]])
    return [np.concatenate(column) for column in zip(*parts, strict=True)]
