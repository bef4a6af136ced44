"""Voxels by tiles of the image, each with a border from the tiles around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that tell a tile.
TILE = ("t", "tz", "ty", "tx")
#: Edges of a tile along z, y and x, for work on arrays of small numbers.
EDGE = (32, 128, 128)


def spread(rows: DataFrame, edge: Sequence[int], before: Sequence[int], after: Sequence[int] | None = None) -> DataFrame:
    """rows (t, z, y, x, ...) with tz, ty, tx of their own tile and of those whose border, so wide before and after the tile, they lie in."""
    for c, n, low, high in zip("zyx", edge, before, after or before, strict=True):
        first, last = F.floor((F.col(c) - high) / n), F.floor((F.col(c) + low) / n)
        # Most voxels lie in one tile, which needs no array.
        rows = rows.withColumn(f"t{c}", F.explode(F.sequence(first, last)) if low or high else last)
    return rows
