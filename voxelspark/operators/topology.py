"""Skeletons of all objects and how they branch, in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import branches
from .graph import cut, tables
from .thinning import skeletons


def skeleton_topology(labels: DataFrame, planar: bool = True, spacing: Sequence[float] = (1.0, 1.0, 1.0), terminal: float | None = None) -> DataFrame:
    """t, label, skeleton_size, branches, junctions, endpoints, total_branch_length of all objects (t, label, z, y, x), plane or in space.

    spacing: of z, y and x.  terminal: branches from an end to a junction up to this length are pruned.  Objects whose skeleton has no branch, such as single voxels, have
    zeros.  Skeletons are made on tiles and branches traced by pointer jumping, so no object is gathered in a task.
    """
    with tables(labels.sparkSession) as written:
        thin = written(skeletons(labels, planar))
        found = branches.totals(written(branches.simplified(thin, spacing, planar, terminal)))
        sizes = thin.groupBy("t", "label").agg(F.count("*").alias("skeleton_size"))
        rows = sizes.join(found, ["t", "label"], "left").fillna(0, ["branch_number", "junction_number", "endpoint_number", "total_branch_length"])
        return cut(rows.select("t", "label", "skeleton_size", F.col("branch_number").alias("branches"), F.col("junction_number").alias("junctions"), F.col("endpoint_number").alias("endpoints"), "total_branch_length"))
