"""Neighbour relations on voxel grids: shells, faces, contours, adjacency, nearest points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .masks import VOXEL


def _line(axis: str, by: Sequence[str]) -> W:
    return W.partitionBy(*by, *[c for c in VOXEL if c != axis]).orderBy(axis)


def missing_faces(mask: DataFrame, axes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mask voxels with the number of absent neighbours along each axis, f_z, f_y, f_x.

    by: columns within which neighbours count, such as a label.
    """
    out = mask
    for axis in "zyx":
        if axis in axes:
            line = _line(axis, by)
            gap = lambda f, sign: F.coalesce((f(axis).over(line) - F.col(axis) != sign).cast("int"), F.lit(1))  # noqa: B023, E731
            out = out.withColumn(f"f_{axis}", gap(F.lag, -1) + gap(F.lead, 1))
        else:
            out = out.withColumn(f"f_{axis}", F.lit(0))
    return out


def surface_shell(mask: DataFrame, axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Voxels that lose a face neighbour; the border of the image is background."""
    return missing_faces(mask.select(*VOXEL), axes).where("f_z + f_y + f_x > 0").select(*VOXEL)


def exposed_measure(mask: DataFrame, spacing: Sequence[float], axes: Sequence[str] = ("z", "y", "x"), by: Sequence[str] = ()) -> DataFrame:
    """Faces towards the background and their total area, per group of by: faces_z, faces_y, faces_x, measure.

    A face across an axis has the product of the other axes' spacing.
    """
    size = dict(zip("zyx", spacing, strict=True))
    face = {a: float(_product([size[b] for b in axes if b != a])) for a in axes}
    rows = missing_faces(mask.select(*by, *VOXEL), axes, by)
    sums = rows.groupBy(*by).agg(*[F.coalesce(F.sum(f"f_{a}"), F.lit(0)).cast("long").alias(f"faces_{a}") for a in "zyx"])
    return sums.withColumn("measure", sum((F.col(f"faces_{a}") * F.lit(face[a]) for a in axes), F.lit(0.0)))


def _product(values: Sequence[float]) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out


def contour_length(labels: DataFrame, sy: float, sx: float, by: Sequence[str] = ("t", "label")) -> DataFrame:
    """Length of the half-level contour of each object of a plane image, by the filled corners of each cell of the padded mask.

    One or three corners: half a diagonal; two side by side: one edge; two opposite, taken as joined: two half diagonals.
    """
    corner = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("cy"), (F.col("x") + dx).alias("cx"), F.lit(1 << (2 * dy + dx)).alias("bit")) for dy, dx in product((0, 1), repeat=2)])).alias("c")
    cells = labels.select(*by, corner).select(*by, "c.*").groupBy(*by, "cy", "cx").agg(F.sum("bit").alias("code"))
    half = 0.5 * sqrt(sy * sy + sx * sx)
    code = F.col("code")
    length = F.when(code.isin(1, 2, 4, 8, 7, 11, 13, 14), half).when(code.isin(3, 12), sx).when(code.isin(5, 10), sy).when(code.isin(6, 9), 2 * half).otherwise(0.0)
    return cells.groupBy(*by).agg(F.sum(length).alias("perimeter"))


def skeleton_edges(skeleton: DataFrame, planar: bool, by: Sequence[str] = ("t",)) -> DataFrame:
    """Steps between neighbouring skeleton voxels, each once, as (by, z, y, x, dz, dy, dx).

    A diagonal step is dropped where a voxel lies on a shorter way between its ends.
    """
    half = [o for o in product((0,) if planar else (-1, 0, 1), (-1, 0, 1), (-1, 0, 1)) if o > (0, 0, 0)]
    keys = [*by, "z", "y", "x"]
    own = skeleton.select(*keys).distinct()
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx"), o, strict=True)]) for o in half])).alias("o")
    from_ = own.select(*keys, steps).select(*keys, "o.dz", "o.dy", "o.dx")
    moved = [(F.col(c) + F.col(f"d{c}")).alias(c) for c in "zyx"]
    found = from_.select(*by, *moved, *[F.col(c).alias(f"p{c}") for c in "zyx"], "dz", "dy", "dx").join(own, keys, "left_semi")
    found = found.select(*by, *[F.col(f"p{c}").alias(c) for c in "zyx"], "dz", "dy", "dx")
    # The voxels between the ends of a diagonal: all proper parts of the step.
    parts = [o for o in product((0, 1), repeat=3) if 0 < sum(o) < 3]
    between = F.filter(F.array(*[F.struct(*[(F.col(c) + F.col(f"d{c}") * v).alias(c) for c, v in zip("zyx", o, strict=True)]) for o in parts]), lambda q: ~((q["z"] == F.col("z")) & (q["y"] == F.col("y")) & (q["x"] == F.col("x"))) & ~((q["z"] == F.col("z") + F.col("dz")) & (q["y"] == F.col("y") + F.col("dy")) & (q["x"] == F.col("x") + F.col("dx"))))
    step = [*keys, "dz", "dy", "dx"]
    blocked = found.select(*step, F.explode(between).alias("q")).select(*by, F.col("q.z").alias("z"), F.col("q.y").alias("y"), F.col("q.x").alias("x"), F.struct(*[c for c in step]).alias("s")).join(own, keys, "left_semi").select("s.*").distinct()
    return found.join(blocked, step, "left_anti")


def skeleton_degrees(skeleton: DataFrame, planar: bool, by: Sequence[str] = ("t",)) -> DataFrame:
    """Neighbour count and kind of each skeleton voxel: isolated 0, endpoint 1, path 2, junction from 3."""
    keys = [*by, "z", "y", "x"]
    edges = skeleton_edges(skeleton, planar, by)
    ends = edges.select(*keys).union(edges.select(*by, *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "zyx"]))
    rows = skeleton.select(*keys).distinct().join(ends.groupBy(*keys).agg(F.count("*").alias("degree")), keys, "left").fillna(0, ["degree"])
    kind = F.when(F.col("degree") == 0, "isolated").when(F.col("degree") == 1, "endpoint").when(F.col("degree") == 2, "path").otherwise("junction")
    return rows.withColumn("kind", kind)


def skeleton_length(skeleton: DataFrame, spacing: Sequence[float], planar: bool, by: Sequence[str] = ("t",)) -> DataFrame:
    """Total step length of each skeleton."""
    length = F.sqrt(sum((F.pow(F.col(f"d{c}") * F.lit(float(s)), 2) for c, s in zip("zyx", spacing, strict=True)), F.lit(0.0)))
    return skeleton_edges(skeleton, planar, by).groupBy(*by).agg(F.count("*").alias("steps"), F.sum(length).alias("length"))


def nearest_points(src: DataFrame, dst: DataFrame, radius: float, k: int, by: Sequence[str]) -> DataFrame:
    """Candidate pairs within a radius: the k nearest targets of each source and the k nearest sources of each target.

    src: (by, src, z, y, x); dst: (by, dst, z, y, x).  Points are hashed to cells of the radius' size and a source meets the cells
    around its own, so the join is on equal keys and its size follows the local density.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{c}") for c, v in zip("zyx", o, strict=True)]) for o in product((-1, 0, 1), repeat=3)])).alias("o")
    left = src.select(*by, "src", *[F.col(c).alias(f"s{c}") for c in "zyx"], around).select(*by, "src", "sz", "sy", "sx", *[(cell(f"s{c}") + F.col(f"o.o{c}")).alias(f"k{c}") for c in "zyx"])
    right = dst.select(*by, "dst", *[F.col(c).alias(f"d{c}") for c in "zyx"], *[cell(c).alias(f"k{c}") for c in "zyx"])
    square = sum((F.pow(F.col(f"s{c}") - F.col(f"d{c}"), 2) for c in "zyx"), F.lit(0.0))
    near = left.join(right, [*by, "kz", "ky", "kx"]).withColumn("d2", square).where(F.col("d2") <= float(radius) ** 2).select(*by, "src", "dst", "d2")
    rank = lambda a, b: F.row_number().over(W.partitionBy(*by, a).orderBy("d2", b))
    return near.withColumns({"rs": rank("src", "dst"), "rd": rank("dst", "src")}).where((F.col("rs") <= k) | (F.col("rd") <= k)).select(*by, "src", "dst", "d2")
