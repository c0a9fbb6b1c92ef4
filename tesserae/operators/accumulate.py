"""Mergeable accumulators: state that tasks update batch by batch and that is merged as a tree.

An accumulator says how a state begins, how a batch changes it, into which tiles it is cut, and how
two states of one tile become one. Tasks update a state each and give out its tiles; tiles
are merged in groups of at most ``FAN``, level by level, so no group grows with the number of tasks and no
task holds more than a few tiles. The levels follow from the task numbers, and a merge must be
associative and commutative.

Defined cases: an empty table has no tiles; tasks without rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialise

#: States of a tile that one group merges.
FAN = 64

TILES = "tile bigint, value array<double>"


@dataclass(frozen=True)
class Accumulator:
    """``init() -> state``, ``update(state, column) -> state``, ``tiles(state) -> {tile: numbers}``,
    ``merge(numbers, numbers) -> numbers``. Numbers are float arrays of one length per tile."""

    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray], Any]
    tiles: Callable[[Any], dict[int, np.ndarray]]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, null vectors left out; numbers stay unboxed."""
    column = column.drop_null()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def partial(df: DataFrame, column: str, acc: Accumulator) -> DataFrame:
    """(part, tile, value): the tiles of every task's state over a column of vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = acc.init(), 0
        for batch in batches:
            m = matrix(batch.column(0))
            if len(m):
                state, rows = acc.update(state, m), rows + len(m)
        if rows:
            part = TaskContext.get().partitionId()
            for tile, value in acc.tiles(state).items():
                arrays = [pa.array([part]), pa.array([tile]), pa.array([value], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "tile", "value"])

    return df.select(column).mapInArrow(task, f"part bigint, {TILES}")


def merged(parts: DataFrame, acc: Accumulator) -> DataFrame:
    """(tile, value) of (part, tile, value), in as many levels as groups of ``FAN`` parts need."""

    def together(group: pd.DataFrame) -> pd.DataFrame:
        value = group["value"].iloc[0]
        for other in group["value"].iloc[1:]:
            value = acc.merge(value, other)
        return pd.DataFrame({"part": [group["up"].iloc[0]], "tile": [group["tile"].iloc[0]], "value": [value]})

    last = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.withColumn("up", F.floor(F.col("part") / FAN).cast("bigint"))
        parts = parts.groupBy("tile", "up").applyInPandas(together, f"part bigint, {TILES}")
        last //= FAN
        if not last:
            return parts.select("tile", "value")


def accumulate(df: DataFrame, column: str, acc: Accumulator) -> DataFrame:
    """(tile, value) of the accumulator over all vectors of ``column``."""
    return merged(materialise(partial(df, column, acc)), acc)


# Moments ---------------------------------------------------------------------------------------

#: Numbers of the Gram matrix in a tile, at most one row more.
TILE_NUMBERS = 1 << 17


def _update(state, m: np.ndarray):
    n, s, g = state
    if s is None:
        return len(m), m.sum(0), m.T @ m
    return n + len(m), s + m.sum(0), g + m.T @ m


def _tiles(state) -> dict[int, np.ndarray]:
    """Tile i holds rows of the Gram matrix from the i-th on, each led by the count and its dimension's sum."""
    n, s, g = state
    whole = np.column_stack([np.full(len(s), float(n)), s, g])
    rows = max(1, TILE_NUMBERS // whole.shape[1])
    return {at: whole[at : at + rows].reshape(-1) for at in range(0, len(whole), rows)}


#: Count, sums and summed outer products of vectors.
MOMENTS = Accumulator(lambda: (0, None, None), _update, _tiles)


def moments(tiles: DataFrame) -> DataFrame:
    """(i, n, s, g[]) per dimension of the tiles of ``MOMENTS``."""
    # A tile of r rows has r * (2 + d) numbers, and the tiles together have d rows.
    total = tiles.agg(F.sum(F.size("value")).alias("t"), F.min("tile").alias("low")).first()["t"]
    if not total:
        return tiles.sparkSession.createDataFrame([], "i bigint, n bigint, s double, g array<double>")
    width = round((1 + total) ** 0.5) + 1  # d * (2 + d) = total
    start = F.explode(F.sequence(F.lit(0), F.size("value") - 1, F.lit(width))).alias("at")
    rows = tiles.select("tile", "value", start)
    return rows.select(
        (F.col("tile") + F.col("at") / width).cast("bigint").alias("i"),
        F.element_at("value", F.col("at") + 1).cast("bigint").alias("n"),
        F.element_at("value", F.col("at") + 2).alias("s"),
        F.slice("value", F.col("at") + 3, F.lit(width - 2)).alias("g"),
    )
