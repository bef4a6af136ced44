"""Filters, set operations and statistics on masks and label images in long form (t, z, y, x, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

VOXEL = ["t", "z", "y", "x"]


def threshold(voxels: DataFrame, least: float) -> DataFrame:
    """Voxels above a value."""
    return voxels.where(F.col("value") > least)


def select_range(voxels: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Voxels within inclusive ranges of the named axes."""
    for axis, (low, high) in ranges.items():
        voxels = voxels.where(F.col(axis).between(low, high))
    return voxels


def select_frame(voxels: DataFrame, frame: int, frames: int) -> DataFrame:
    """Foreground of one frame; the number is clamped to those that exist."""
    return voxels.where((F.col("t") == max(0, min(frame, frames - 1))) & (F.col("value") > 0))


def distinct_values(voxels: DataFrame, most: int) -> DataFrame:
    """The least distinct values, one more than most at the utmost, so that more can be told from exactly so many."""
    return voxels.select("value").distinct().orderBy("value").limit(most + 1)


def is_binary(voxels: DataFrame) -> DataFrame:
    """One row: whether there are at most two values, 0 among them."""
    return voxels.agg(F.coalesce((F.count_distinct("value") <= 2) & F.bool_or(F.col("value") == 0), F.lit(False)).alias("is_binary"))


def compact_ids(labels: DataFrame, column: str = "label") -> DataFrame:
    """Dense ids from 1 in the order of the original ids: (original, compact).

    Distinct ids are numbered in range partitions.
    """
    ids = labels.select(F.col(column).alias("original")).where("original <> 0").distinct()
    return numbered(ids, ["original"], "compact").withColumn("compact", F.col("compact").cast("int"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).union(b.select(*VOXEL)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).join(b.select(*VOXEL), VOXEL, "left_semi").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).join(b.select(*VOXEL), VOXEL, "left_anti").distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """In one shuffle: voxels that only one side has."""
    both = a.select(*VOXEL, F.lit(1).alias("side")).union(b.select(*VOXEL, F.lit(2).alias("side")))
    return both.groupBy(*VOXEL).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high").select(*VOXEL)


def rescale_to_byte(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Values mapped to 0..255 between the extremes of each block; a constant block has range 1."""
    span = voxels.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1))
    byte = F.floor((F.col("value") - F.col("low")) * 255 / width.cast("double"))
    return voxels.join(span, by).select(*VOXEL, F.least(F.greatest(byte, F.lit(0)), F.lit(255)).cast("int").alias("value"))


def lossless_type(voxels: DataFrame) -> DataFrame:
    """One row: the smallest integer type that holds all values."""
    low, high = F.min("value"), F.max("value")
    fits = lambda a, b: (low >= a) & (high <= b)
    kind = F.when(fits(0, 255), "uint8").when(fits(0, 65535), "uint16").when(fits(-32768, 32767), "int16").when(fits(0, 4294967295), "uint32").when(fits(-2147483648, 2147483647), "int32").otherwise("int64")
    return voxels.agg(kind.alias("dtype"))


def last_writer(overlays: DataFrame, order: Column, value: str) -> DataFrame:
    """One value per voxel where several were painted: that of the greatest order."""
    return overlays.groupBy(*VOXEL).agg(F.max_by(value, order).alias(value))


def strided(voxels: DataFrame, most: int) -> DataFrame:
    """At most that many voxels at even steps of the raster order, from the first one on; all where there are no more.  The places follow from counts by range partition."""
    if most < 1:
        raise ValueError("a sample needs at least one voxel")
    n = voxels.count()
    step = max(-(-n // most), 1)
    placed = numbered(voxels, VOXEL, "_place", 0)
    return placed.where((F.col("_place") % step == 0) & (F.col("_place") < step * most)).drop("_place")
