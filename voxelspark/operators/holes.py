"""Holes: background that the outside can't reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import connected, cut


def holes(mask: DataFrame, planar: bool = False, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by, z, y, x) of the background voxels that no way across faces leads out of the image from.

    Only background between foreground voxels of a row can be such.  Each of these gaps is a node; it is open where it reaches beyond the foreground of the next
    row, or there is none.  Parts of touching gaps without an open one are holes, so the work follows the foreground, not the extent of the image.
    planar: each plane (z) is an image of its own.
    """
    row = [*by, "z", "y"]
    own = mask.select(*row, "x").distinct()
    ahead = F.lead("x").over(W.partitionBy(*row).orderBy("x"))
    gaps = own.withColumn("ahead", ahead).where("ahead - x > 1").select(*row, (F.col("x") + 1).alias("x0"), (F.col("ahead") - 1).alias("x1"))
    gaps = cut(gaps.withColumn("id", F.monotonically_increasing_id()))
    half = [(0, 1)] if planar else [(0, 1), (1, 0)]
    steps = lambda pairs: F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in pairs])).alias("s")
    moved = lambda pairs: gaps.select("*", steps(pairs)).withColumns({"z": F.col("z") + F.col("s.dz"), "y": F.col("y") + F.col("s.dy")})
    ends = own.groupBy(*row).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    beyond = moved([*half, *[(-dz, -dy) for dz, dy in half]]).join(ends, row, "left").where("low IS NULL OR x0 < low OR x1 > high").select("id").distinct()
    # Gaps of a row don't overlap, so the one of the next row that a gap begins in is the last to begin before it; and the other way round.
    sides = gaps.select(*row, "x0", "x1", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(0).alias("side")) for k in range(len(half))])).alias("s"))
    other = gaps.select(*row, "x0", "x1", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(1).alias("side"), F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for k, (dz, dy) in enumerate(half)])).alias("s"))
    other = other.select(*by, (F.col("z") - F.col("s.dz")).alias("z"), (F.col("y") - F.col("s.dy")).alias("y"), "x0", "x1", "id", "s.step", "s.side")
    line = sides.select(*row, "x0", "x1", "id", "s.step", "s.side").union(other)
    order = W.partitionBy(*row, "step").orderBy("x0", "side").rowsBetween(W.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("x1", "id")), True).over(order)
    opposite = F.when(F.col("side") == 0, F.col("of1")).otherwise(F.col("of0"))
    edges = line.withColumns({"of0": last(0), "of1": last(1)}).withColumn("o", opposite).where("o.x1 >= x0").select(F.col("id").alias("a"), F.col("o.id").alias("b"))
    # Of two gaps that begin at one place the second in order sees the first.
    roots = cut(connected(gaps, edges))
    out = roots.join(beyond, "id", "left_semi").select("root").distinct()
    inner = gaps.join(roots.join(out, "root", "left_anti").select("id"), "id", "left_semi")
    return inner.select(*row, F.explode(F.sequence("x0", "x1")).alias("x"))


def fill_holes(mask: DataFrame, planar: bool = False, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by, z, y, x) of the mask and its holes."""
    return mask.select(*by, "z", "y", "x").distinct().union(holes(mask, planar, by))
