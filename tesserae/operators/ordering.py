"""Positions and running totals that stay parallel when one group is huge.

A window over ``partitionBy(group)`` sorts each group in a single task. That is the
cheapest plan for ordinary groups and useless for a group with a third of all rows, so
groups above ``HOT_ROWS`` take another route: their rows are range-partitioned on
(group, order), which splits a group over many tasks, each slice is numbered locally,
and a table with one row per (group, slice) supplies the start of every slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from tesserae.session import materialise

#: Groups with more rows than this are sliced. Below it one task sorts the group.
HOT_ROWS = 5_000_000

_LOCAL_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row in 33 bits


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Distinct keys of groups above ``hot_rows``, or ``None``. At most total/hot_rows rows."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_rows).select(*group)
    if hot_rows >= HOT_ROWS and hot.isEmpty():
        return None
    hot = materialise(hot)
    return None if hot.isEmpty() else hot


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def split_hot(
    df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Split into (ordinary rows, rows of hot groups or ``None``)."""
    hot = hot_groups(df, group, hot_rows)
    if hot is None:
        return df, None
    key = _null_safe(df, hot, group)
    return (
        df.join(F.broadcast(hot), key, "left_anti"),
        df.join(F.broadcast(hot), key, "left_semi"),
    )


def _slices(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    # A hash of the plain columns comes last so that rows equal under ``order`` can still be
    # divided; payloads, maps and other nested columns are left out.
    nested = (BinaryType, ArrayType, MapType, StructType)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]
    keys = [F.col(g) for g in group] + _cols(order) + ([F.xxhash64(*plain)] if plain else [])
    # No partition number: adaptive execution merges neighbouring slices of small tables.
    sliced = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_ROW_MASK)))
    )
    # Range bounds come from a sample: freeze them so both uses below agree.
    return materialise(sliced)


def _number_sliced(df: DataFrame, group: Sequence[str], order, name: str) -> DataFrame:
    rows = _slices(df, group, order)
    marks = rows.groupBy("_slice", *group).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(
        F.col("_slice").alias("_s"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    cond = F.col("_slice") == F.col("_s")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    # One row per hot group and slice: bounded by slices + hot groups.
    out = rows.join(F.broadcast(marks), cond)
    return out.withColumn(name, F.col("_row") + F.col("_shift") + 1).drop(
        "_slice", "_row", "_s", "_shift", *[f"_g_{g}" for g in group]
    )


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row inside its group as ``name`` (bigint).

    With an empty ``group`` the whole table is numbered, always by slices. ``order``
    should be a total order; rows equal under it are numbered arbitrarily.
    """
    if not group:
        return _number_sliced(df, [], order, name)
    cold, hot = split_hot(df, group, hot_rows)
    window = Window.partitionBy(*group).orderBy(*_cols(order))
    out = cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    if hot is None:
        return out
    return out.unionByName(_number_sliced(hot, group, order, name))


def _totals_sliced(df: DataFrame, group, order, sums: dict[str, str]) -> DataFrame:
    rows = _slices(df, group, order)
    part = rows.groupBy("_slice", *group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        F.col("_slice").alias("_s"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    cond = F.col("_slice") == F.col("_s")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    local = Window.partitionBy("_slice", *group).orderBy("_row")
    local = local.rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        rows = rows.withColumn(n, F.sum(c).over(local))
    out = rows.join(F.broadcast(offsets), cond)
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"_o_{n}"))
    return out.drop(
        "_slice", "_row", "_s", *[f"_o_{n}" for n in sums], *[f"_g_{g}" for g in group]
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add inclusive running sums ``{new column: summed column}`` in order within each group.

    With an empty ``group`` the sums run over the whole table, always by slices.
    """
    if not group:
        return _totals_sliced(df, [], order, sums)
    cold, hot = split_hot(df, group, hot_rows)
    window = Window.partitionBy(*group).orderBy(*_cols(order))
    window = window.rowsBetween(Window.unboundedPreceding, 0)
    out = cold
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(window))
    if hot is None:
        return out
    return out.unionByName(_totals_sliced(hot, group, order, sums))
