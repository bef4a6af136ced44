"""Morphology of all objects of an image in one call: sizes, borders, skeleton branches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import branches
from .graph import cut, tables
from .morphology import COLUMNS
from .neighbors import contour_length, exposed_measure, skeleton_length
from .thinning import skeletons

OBJECT = ["t", "label"]
_MEAN = ["mz", "my", "mx"]
_SPREAD = ["zz", "zy", "zx", "yy", "yx", "xx"]


@dataclass(frozen=True)
class Analysis:
    """objects: a row for each object of two voxels or more, in the order of exported columns, meant to be read by size, descending.

    branches: frame, object_label, branch_index, object_branch_index, branch_length, meant to be read by length, descending.  radii: t, radius, the length up to which
    terminal branches were pruned (volumes only).
    """

    objects: DataFrame
    branches: DataFrame
    radii: DataFrame | None


def _axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, label, mean, covariance to t, label, mean, and the direction in which an object is longest."""
    for batch in batches:
        cov = np.empty((len(batch), 3, 3))
        for name, (i, j) in zip(_SPREAD, ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
            cov[:, i, j] = cov[:, j, i] = batch.column(name).to_numpy()
        axis = np.linalg.eigh(cov)[1][:, :, 2] if len(batch) else np.empty((0, 3))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*OBJECT, *_MEAN)), *(pa.array(axis[:, i]) for i in range(3))], [*OBJECT, *_MEAN, "az", "ay", "ax"])


def principal_ends(points: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """t, label, length: the distance of the two voxels that lie furthest out along an object's principal axis.

    The axis is that of the voxels' places, not of their spacing; of equals the first voxel counts.  points: t, label, z, y, x.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    spread = [F.covar_pop(a, b).alias(f"{a}{b}") for a, b in ("zz", "zy", "zx", "yy", "yx", "xx")]
    rows = points.groupBy(*OBJECT).agg(*[F.avg(c).alias(f"m{c}") for c in "zyx"], *spread)
    axes = rows.mapInArrow(_axes, ", ".join([*(f"{c} {kinds[c]}" for c in OBJECT), *(f"{c} double" for c in (*_MEAN, "az", "ay", "ax"))]))
    along = F.round(sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"a{c}") for c in "zyx"), F.lit(0.0)), 9)
    ends = points.join(axes, OBJECT).withColumn("p", along).groupBy(*OBJECT).agg(F.min(F.struct("p", "z", "y", "x")).alias("a"), F.min(F.struct((-F.col("p")).alias("p"), "z", "y", "x")).alias("b"))
    gap = F.sqrt(sum((F.pow((F.col(f"b.{c}") - F.col(f"a.{c}")) * F.lit(float(s)), 2) for c, s in zip("zyx", spacing, strict=True)), F.lit(0.0)))
    return ends.select(*OBJECT, gap.alias("length"))


def equivalent_radii(sizes: DataFrame, thin: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """t, radius of the cylinder as long as all skeletons of a frame together and with the volume of its objects; objects without a skeleton step count with their principal axis."""
    steps = skeleton_length(thin, spacing, False, OBJECT).select(*OBJECT, "length")
    bare = thin.join(steps.select(*OBJECT), OBJECT, "left_anti")
    lengths = steps.union(principal_ends(bare, spacing))
    volume = float(np.prod(np.asarray(spacing, float)))
    sums = sizes.join(lengths, OBJECT, "left").groupBy("t").agg((F.sum("n") * volume).alias("volume"), F.sum("length").alias("length"))
    return sums.where("length > 0").select("t", F.sqrt(F.col("volume") / (pi * F.col("length"))).alias("radius"))


def analyze(labels: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), planar: bool = False) -> Analysis:
    """Measure the objects (t, label, z, y, x) of plane images or volumes; spacing is that of z, y and x.

    Objects of one voxel are left out.  Plane objects have pixels, area and perimeter, others voxels, volume and surface_area.  Skeletons are made on the image's own
    grid.  In volumes terminal branches up to the frame's equivalent radius are pruned, and loops around no background dropped.  Where a skeleton has no branch, the
    ends of the principal axis (of the skeleton, or of the object if that is one voxel) stand for one; "length source" tells which it was.
    """
    spark = labels.sparkSession
    with tables(spark) as written:
        own = labels.groupBy("t", "z", "y", "x").agg(F.min("label").alias("label")).select("t", "label", "z", "y", "x")
        sizes = own.groupBy(*OBJECT).agg(F.count("*").alias("n")).where("n > 1")
        own, sizes = written(own.join(sizes.select(*OBJECT), OBJECT, "left_semi")), written(sizes)
        thin = written(skeletons(own, planar))
        radii = None
        if planar:
            rows = written(branches.simplified(thin, spacing, True))
        else:
            radii = cut(equivalent_radii(sizes, thin, spacing))
            rows = written(branches.simplified(thin, spacing, False, radii, own))
        lost = thin.join(rows.select(*OBJECT).distinct(), OBJECT, "left_anti")
        several = lost.groupBy(*OBJECT).agg(F.count("*").alias("n")).where("n > 1").select(*OBJECT)
        single = sizes.join(rows.select(*OBJECT).distinct(), OBJECT, "left_anti").join(several, OBJECT, "left_anti").select(*OBJECT)
        axis = written(principal_ends(lost.join(several, OBJECT, "left_semi").union(own.join(single, OBJECT, "left_semi").select(*lost.columns)), spacing))
        # Stand-ins are numbered before all branches, and there is one for an object.
        stand = axis.select(*OBJECT, F.lit(-1).cast("long").alias("branch_id"), "length")
        found = cut(branches.table(rows.select(*OBJECT, "branch_id", "length").union(stand)))
        totals = branches.totals(rows).withColumn("length source", F.lit("skeleton"))
        one = axis.select(*OBJECT, F.lit(1).cast("long").alias("branch_number"), F.lit(0).cast("long").alias("junction_number"), F.lit(2).cast("long").alias("endpoint_number"), F.col("length").alias("total_branch_length"), F.col("length").alias("mean_branch_length"), F.lit("principal_axis").alias("length source"))
        measure = float(np.prod(np.asarray(spacing[1:] if planar else spacing, float)))
        count, size = ("pixels", "area") if planar else ("voxels", "volume")
        border = contour_length(own, float(spacing[1]), float(spacing[2])) if planar else exposed_measure(own, spacing, by=OBJECT).select(*OBJECT, F.col("measure").alias("surface_area"))
        out = sizes.withColumns({count: F.col("n"), size: F.col("n") * F.lit(measure)}).join(border, OBJECT).join(totals.unionByName(one), OBJECT)
        out = out.withColumn("frame", F.col("t"))
        return Analysis(cut(out.select(*[F.col(f"`{c}`") for c in COLUMNS if c in out.columns])), found, radii)
