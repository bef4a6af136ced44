"""Connected-object labelling of masks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut, roots_of, rounds
from .masks import VOXEL
from .tiles import EDGE, TILE, spread


def _pieces(full: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Voxels of a tile with the first voxel (rz, ry, rx) of their piece in it, whether they are its own, and whether other tiles have them too."""
    half = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and (full or sum(map(abs, o)) == 1)]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind = {f.name: f.type for f in rows.schema}
        corner = [k.as_py() * n for k, n in zip(key[1:], EDGE)]
        at = [rows[c].to_numpy().astype(np.int64) for c in "zyx"]
        first = [int(v.min()) for v in at]
        shape = [int(v.max()) - f + 1 for v, f in zip(at, first)]
        place = np.unique(np.ravel_multi_index([v - f for v, f in zip(at, first)], shape))
        held = np.full(shape, -1, np.int64)
        held.ravel()[place] = np.arange(len(place))
        pairs = []
        for o in half:
            here, there = (held[tuple(slice(max(0, s * d), n + min(0, s * d)) for d, n in zip(o, shape))] for s in (-1, 1))
            both = (here >= 0) & (there >= 0)
            pairs.append((here[both], there[both]))
        root = np.arange(len(place))
        ids, least = roots_of(*(np.concatenate(p) for p in zip(*pairs)))
        root[ids] = least
        voxel = [v + f for v, f in zip(np.unravel_index(place, shape), first)]
        own = np.all([v >= c for v, c in zip(voxel, corner)], 0)
        last = np.any([v == c + n - 1 for v, c, n in zip(voxel, corner, EDGE)], 0)
        columns = {"t": pa.array([key[0].as_py()] * len(place), kind["t"])} | {c: pa.array(v, kind[c]) for c, v in zip("zyx", voxel)}
        columns |= {f"r{c}": pa.array(v[root], kind[c]) for c, v in zip("zyx", voxel)} | {"own": pa.array(own), "shared": pa.array(~own | last)}
        return pa.table(columns)

    return run


def label(mask: DataFrame, full: bool = False) -> DataFrame:
    """(t, z, y, x, label) of mask voxels: components per frame, numbered from 1 by raster order of their first voxel.

    Face connectivity, or with full also across edges and corners.  Voxels are first joined to pieces on tiles of the image, each with the last voxels of the
    tiles before it; rounds over the whole image are left for pieces that share such a voxel.
    """
    kind = {f.name: f.dataType.simpleString() for f in mask.schema}
    schema = ", ".join([f"{c} {kind[c]}" for c in VOXEL] + [f"r{c} {kind[c]}" for c in "zyx"] + ["own boolean", "shared boolean"])
    pieces = cut(spread(mask.select(*VOXEL), EDGE, (1, 1, 1), (0, 0, 0)).groupBy(*TILE).applyInArrow(_pieces(full), schema))
    # A number for each voxel that grows in raster order within its frame.
    extent = pieces.agg(*[f(c) for c in "zyx" for f in (F.max, F.min)]).head()
    if extent[0] is None:
        return mask.select(*VOXEL, F.lit(1).alias("label")).limit(0)
    nz, ny, nx = (extent[i] - extent[i + 1] + 1 for i in (0, 2, 4))
    number = (((F.col("t").cast("long") * nz + F.col("rz") - extent[1]) * ny + F.col("ry") - extent[3]) * nx) + F.col("rx") - extent[5]
    pieces = pieces.select(*VOXEL, number.alias("root"), "own", "shared")
    meet = pieces.where("shared").groupBy(*VOXEL).agg(F.collect_set("root").alias("roots")).where("size(roots) > 1")
    joined = rounds(meet.select(F.explode("roots").alias("a"), F.array_min("roots").alias("b")))
    # Pieces of a frame are far fewer than its voxels; ranks are taken over them alone.
    roots = pieces.where("own").select("root").distinct().join(joined.withColumnsRenamed({"root": "better", "id": "root"}), "root", "left")
    ranked = roots.withColumn("least", F.coalesce("better", "root")).withColumn("frame", F.floor(F.col("least") / (nz * ny * nx)))
    ranked = ranked.select("root", F.dense_rank().over(W.partitionBy("frame").orderBy("least")).alias("label"))
    return pieces.where("own").select(*VOXEL, "root").join(ranked, "root").select(*VOXEL, "label")


def objects(labels: DataFrame) -> DataFrame:
    """One row per object: area, sums and extremes of the coordinates, centroid."""
    sums = [F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "zyx"]
    ends = [f(c).alias(f"{c}{i}") for c in "zyx" for i, f in enumerate((F.min, F.max))]
    rows = labels.groupBy("t", "label").agg(F.count("*").alias("area"), *sums, *ends)
    return rows.select("t", "label", "area", *[(F.col(f"s{c}") / F.col("area")).alias(f"c{c}") for c in "zyx"], *[f"{c}{i}" for c in "zyx" for i in (0, 1)])


def detections(objs: DataFrame) -> DataFrame:
    """Objects with ids from 0, by frame and label: counts of earlier frames plus the rank in the own frame."""
    frames = objs.groupBy("t").agg(F.count("*").alias("n"))
    before = frames.select("t", (F.sum("n").over(W.orderBy("t")) - F.col("n")).alias("before"))
    return objs.join(before, "t").withColumn("det_id", F.col("before") + F.row_number().over(W.partitionBy("t").orderBy("label")) - 1).drop("before")


def instance_labels(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Ids kept where a label image has more than one of them; else components, numbered on through the frames."""
    if labels.select("value").where("value <> 0").distinct().limit(2).count() > 1:
        return labels.where("value <> 0").select(*VOXEL, F.col("value").alias("label"))
    own = label(mask)
    most = own.groupBy("t").agg(F.max("label").alias("n"))
    before = most.select("t", (F.sum("n").over(W.orderBy("t")) - F.col("n")).alias("before"))
    return own.join(before, "t").select(*VOXEL, (F.col("label") + F.col("before")).alias("label"))
