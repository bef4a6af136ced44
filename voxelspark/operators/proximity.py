"""Overlap and proximity of two channels, over the full image or regions of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dice, fraction, jaccard
from .distance import nearest
from .masks import VOXEL
from .neighbors import surface_shell


def overlap_summary(src: DataFrame, tgt: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sizes, overlap, union, Manders, Dice and Jaccard of two channels (t, z, y, x, value), each row once.

    The channels meet in one shuffle by voxel, as tagged rows, instead of a join and two counts.
    """
    side = lambda df, s: df.select(*by, *VOXEL, F.lit(s).alias("side"), "value")
    both = side(src, 1).union(side(tgt, 2)).groupBy(*by, *VOXEL).agg(F.max(F.when(F.col("side") == 1, F.col("value"))).alias("s"), F.max(F.when(F.col("side") == 2, F.col("value"))).alias("g"))
    return overlap_of(both, by)


def overlap_of(both: DataFrame, by: Sequence[str] = (), also: Sequence[Column] = ()) -> DataFrame:
    """overlap_summary of both channels side by side: a row for each voxel, s and g its values in source and target, null where it isn't one.  also: further sums, named."""
    in_s, in_g = F.col("s").isNotNull(), F.col("g").isNotNull()
    total = lambda c, cond=None: F.coalesce(F.sum(F.when(cond, F.col(c)) if cond is not None else F.col(c)), F.lit(0))
    sums = both.groupBy(*by).agg(
        F.count_if(in_s).alias("source_size"), F.count_if(in_g).alias("target_size"), F.count_if(in_s & in_g).alias("overlap_size"), F.count("*").alias("union_size"),
        total("s").alias("ss"), total("s", in_g).alias("so"), total("g").alias("gs"), total("g", in_s).alias("go"), *also,
    )
    o, a, b = (F.col(f"{c}_size") for c in ("overlap", "source", "target"))
    return sums.select(
        *by, "source_size", "target_size", "overlap_size", "union_size", fraction(F.col("so"), F.col("ss")).alias("manders_source"), fraction(F.col("go"), F.col("gs")).alias("manders_target"),
        dice(o, a, b).alias("dice"), jaccard(o, a, b).alias("jaccard"), fraction(o, a).alias("source_fraction"),
        *sums.columns[len(by) + 8 :],
    )


def proximity_voxels(src: DataFrame, tgt: DataFrame, threshold: float, surface_only: bool = True, axes: Sequence[str] = ("z", "y", "x"), spacing: Sequence[float] = (1.0, 1.0, 1.0), beyond: bool = True) -> DataFrame:
    """Source basis voxels (the surface shell by default) with d2 to the target and whether they are within the threshold.

    beyond: whether d2 is wanted of voxels beyond the threshold too; without it they have null, and only the rows around each voxel are searched.
    """
    basis = surface_shell(src, axes) if surface_only else src.select(*VOXEL).distinct()
    reach = max(0.0, float(threshold))
    return nearest(basis, tgt, spacing, None if beyond else reach).withColumn("near", F.coalesce(F.col("d2") <= reach**2, F.lit(False)))


def near_in_rows(both: DataFrame, threshold: float) -> DataFrame:
    """both (t, z, y, x, s, g), see overlap_of, and whether a target voxel of the voxel's own row lies within the threshold along x.

    For images of one row a frame the same as proximity_voxels, in windows instead of a Python call for each frame and tile; a row must fit in a task.
    """
    row, last = Window.partitionBy("t", "z", "y"), lambda w: F.last(F.when(F.col("g").isNotNull(), F.col("x")), ignorenulls=True).over(w)
    before, after = F.col("x") - last(row.orderBy("x")), last(row.orderBy(F.desc("x"))) - F.col("x")
    reach = max(0.0, float(threshold))
    return both.withColumn("near", F.coalesce(F.least(before, after) <= reach, F.lit(False)))


def inside_polygon(y: Column, x: Column, vertices: Column) -> Column:
    """Crossing parity of a ray along x, half open: an edge counts where exactly one end lies above y."""
    n = F.size(vertices)
    crossing = lambda i: (lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]).otherwise(F.lit(1.0)) + p["x"]))(F.get(vertices, i), F.get(vertices, (i + 1) % n))
    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crossing)) % 2 == 1


def valid_rois(rois: DataFrame) -> DataFrame:
    """Regions (roi_id, vertices) with three finite, distinct corners or more."""
    finite = F.forall("vertices", lambda v: ~F.isnan(v["y"]) & ~F.isnan(v["x"]) & v["y"].isNotNull() & v["x"].isNotNull())
    return rois.where((F.size("vertices") >= 3) & finite & (F.size(F.array_distinct("vertices")) >= 3))


def roi_voxels(voxels: DataFrame, rois: DataFrame) -> DataFrame:
    """Voxels joined to the regions that hold them; regions are few and drawn by hand, so each is tested within its bounding box."""
    boxes = valid_rois(rois).select("roi_id", "vertices", *[f(F.col(f"vertices.{c}")).alias(f"{c}{i}") for c in "yx" for i, f in enumerate((F.array_min, F.array_max))])
    inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")) & inside_polygon(F.col("y").cast("double"), F.col("x").cast("double"), F.col("vertices"))
    return voxels.join(boxes, inside).drop("vertices", "y0", "y1", "x0", "x1")


def near_source_objects(src_labels: DataFrame, tgt: DataFrame, threshold: float, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per source object: its size and the target voxels whose nearest source voxel is its own, within the threshold."""
    sizes = src_labels.groupBy("t", "label").agg(F.count("*").alias("source_size"))
    close = nearest(tgt, src_labels, spacing, max(0.0, float(threshold))).where("d2 IS NOT NULL").groupBy("t", "label").agg(F.count("*").alias("target_near"))
    return sizes.join(close, ["t", "label"], "left").fillna(0, ["target_near"])
