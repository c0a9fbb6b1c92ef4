"""Index arithmetic of a quadtree whose levels are square grids of doubling side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells per side at each level of the full tree.
SIDES = (1, 2, 4, 8, 16, 32)


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_level(lod: str | Column, values: Sequence[int]) -> Column:
    """Value of a short per-level list at the row's level; NULL beyond the list."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), _as_col(lod).cast("int") + 1)


def cell_row(patch: str | Column, side: Column) -> Column:
    return F.floor(_as_col(patch) / side).cast("bigint")


def cell_col(patch: str | Column, side: Column) -> Column:
    return F.pmod(_as_col(patch), side).cast("bigint")


def parent_patch(lod: str | Column, patch: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Patch index of the parent, NULL for the root."""
    lod = _as_col(lod)
    side = by_level(lod, sides)
    up = F.floor(cell_row(patch, side) / 2) * by_level(F.greatest(lod - 1, F.lit(0)), sides)
    return F.when(lod > 0, (up + F.floor(cell_col(patch, side) / 2)).cast("bigint"))


def child_patches(lod: str | Column, patch: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Array of the four child patch indices: top left, top right, bottom left, bottom right."""
    lod = _as_col(lod)
    side, below = by_level(lod, sides), by_level(lod + 1, sides)
    first = cell_row(patch, side) * 2 * below + cell_col(patch, side) * 2
    return F.array(first, first + 1, first + below, first + below + 1)


def interleaved(lod: str | Column, patch: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Rank of a node among all cells of its level in breadth-first expansion order.

    Expanding parents in order and children as (top left, top right, bottom left, bottom
    right) visits a level in the order of interleaved row and column bits.
    """
    side = by_level(lod, sides)
    row, col = cell_row(patch, side), cell_col(patch, side)
    out = F.lit(0).cast("bigint")
    for bit in range(max(sides).bit_length() - 1):
        col_bit = F.shiftright(col, bit).bitwiseAND(F.lit(1))
        row_bit = F.shiftright(row, bit).bitwiseAND(F.lit(1))
        out = out + F.shiftleft(col_bit, 2 * bit) + F.shiftleft(row_bit, 2 * bit + 1)
    return out


def node_box(
    lod: str | Column,
    patch: str | Column,
    patch_sizes: Sequence[int],
    resolution: int,
    sides: Sequence[int] = SIDES,
) -> dict[str, Column]:
    """Normalised box of a node. Sizes are a parameter: they need not tile coarse levels."""
    side, size = by_level(lod, sides), by_level(lod, patch_sizes)
    x0, y0 = cell_col(patch, side) * size, cell_row(patch, side) * size
    full = F.lit(float(resolution))
    return {"x0": x0 / full, "y0": y0 / full, "x1": (x0 + size) / full, "y1": (y0 + size) / full}


def level_start(lod: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Number of cells on all coarser levels: the index of the first node of a level."""
    starts = [sum(s * s for s in sides[:i]) for i in range(len(sides))]
    return by_level(lod, starts).cast("bigint")


def node_index(lod: str | Column, patch: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Index of a node in the full tree, breadth first."""
    return level_start(lod, sides) + interleaved(lod, patch, sides)


def level_of(idx: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Level of a node by its index in the full tree, NULL outside."""
    idx, out, end = _as_col(idx), F.when(F.lit(False), F.lit(0).cast("bigint")), 0
    for lod, side in enumerate(sides):
        end += side * side
        out = out.when((idx >= 0) & (idx < end), F.lit(lod).cast("bigint"))
    return out


def patch_of(idx: str | Column, sides: Sequence[int] = SIDES) -> Column:
    """Patch of a node by its index in the full tree: the inverse of :func:`node_index`."""
    lod = level_of(idx, sides)
    rank = _as_col(idx) - level_start(lod, sides)
    row, col = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for bit in range(max(sides).bit_length() - 1):
        col = col + F.shiftleft(F.shiftright(rank, 2 * bit).bitwiseAND(F.lit(1)), bit)
        row = row + F.shiftleft(F.shiftright(rank, 2 * bit + 1).bitwiseAND(F.lit(1)), bit)
    return row * by_level(lod, sides) + col


def ancestor_rank(lod: str | Column, rank: str | Column, level: int) -> Column:
    """Rank on ``level`` of the ancestor of a node, NULL for nodes above that level.

    Ranks are breadth-first ranks inside a level, so an ancestor's rank is the node's rank
    without its last two bits per level climbed.
    """
    lod, rank = _as_col(lod), _as_col(rank)
    bits = ((lod - level) * 2).cast("int")
    return F.when(lod >= level, F.call_function("shiftright", rank, bits))
