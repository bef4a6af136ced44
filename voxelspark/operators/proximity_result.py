"""The proximity analysis of two channels as a whole: one summary per region, component rows, and the voxels behind them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dice, fraction, jaccard
from .components import instance_labels, label
from .distance import nearest
from .graph import cut
from .masks import VOXEL
from .neighbors import missing_faces
from .numbering import numbered
from .proximity import inside_polygon, roi_voxels, valid_rois

NAN = float("nan")
FULL_IMAGE = (1, "Full image", -1)
#: Columns of the summary in their order; fixed values.
SUMMARY = (
    "roi_id", "roi_name", "frame", "roi_size", "roi_size_physical", "source_size", "target_size", "overlap_size", "overlap_size_physical",
    "source_proximity_size", "target_proximity_size", "source_proximity_size_physical", "target_proximity_size_physical",
    "source_proximity_fraction", "target_proximity_fraction", "proximity_manders_m1", "proximity_manders_m2",
    "source_mean_distance", "source_median_distance", "target_mean_distance", "target_median_distance", "manders_m1", "manders_m2", "dice", "jaccard",
)
#: Columns of the component rows in their order; fixed values.
COMPONENTS = ("roi_id", "frame", "component_id", "global_component_id", "size", "size_physical", "source_label", "source_size", "source_size_physical")


@dataclass(frozen=True)
class ProximityResult:
    """summary: SUMMARY by region.  components: COMPONENTS.  voxels: t, z, y, x and whether a voxel is source, target, source_near, target_near
    within any region.  labels: t, z, y, x, global_component_id.  Components and labels are not worked out until one of them is asked for.
    """

    summary: DataFrame
    voxels: DataFrame
    find: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame]:
        return self.find()

    @property
    def components(self) -> DataFrame:
        return self._found[0]

    @property
    def labels(self) -> DataFrame:
        return self._found[1]


def _product(values: Sequence[float]) -> float:
    return reduce(lambda a, b: a * b, map(float, values), 1.0)


def _side(own: DataFrame, other: DataFrame, threshold: float, spacing: Sequence[float], sizes: Sequence[float], axes: Sequence[str], surface_only: bool) -> DataFrame:
    """Voxels of a channel with their basis flag, area of faces, distance to the other channel's nearest voxel (of the basis), nearness and that voxel."""
    size = dict(zip("zyx", sizes, strict=True))
    area = reduce(lambda a, b: a + b, (F.col(f"f_{a}") * F.lit(_product([size[b] for b in axes if b != a])) for a in axes))
    rows = missing_faces(own.select(*VOXEL, "value"), axes).select(*VOXEL, "value", area.alias("area"), (F.col("f_z") + F.col("f_y") + F.col("f_x") > 0 if surface_only else F.lit(True)).alias("basis"))
    found = nearest(rows.where("basis"), other, spacing)
    # Distances are single precision, as is the threshold that they are held against.
    found = found.select(*VOXEL, F.sqrt("d2").cast("float").alias("d"), "nz", "ny", "nx")
    near = F.coalesce(F.col("d") <= F.lit(max(0.0, float(threshold))).cast("float"), F.lit(False))
    return rows.join(found, VOXEL, "left").withColumn("near", near)


def _regions(rois: DataFrame, shape: Sequence[int]) -> DataFrame:
    """roi_id, roi_name, frame, roi_size: lattice points inside, row by row, over the planes and frames that the region holds for."""
    frames, planes, rows, columns = shape
    end = lambda f, c: f(F.transform("vertices", lambda v: v[c]))
    low = lambda c: F.greatest(F.ceil(end(F.array_min, c)).cast("int"), F.lit(0))
    high = lambda c, n: F.least(F.floor(end(F.array_max, c)).cast("int"), F.lit(n - 1))
    spans = valid_rois(rois).select("roi_id", "roi_name", "frame", "vertices", low("y").alias("y0"), high("y", rows).alias("y1"), low("x").alias("x0"), high("x", columns).alias("x1"))
    lines = spans.where("y0 <= y1 and x0 <= x1").withColumn("y", F.explode(F.sequence("y0", "y1")))
    inside = F.size(F.filter(F.sequence("x0", "x1"), lambda x: inside_polygon(F.col("y").cast("double"), x.cast("double"), F.col("vertices"))))
    held = F.lit(planes) * F.when(F.col("frame") < 0, F.lit(frames)).otherwise(F.lit(1))
    return lines.groupBy("roi_id", "roi_name", "frame").agg((F.sum(inside) * F.first(held)).cast("long").alias("roi_size")).where("roi_size > 0")


def _total(c: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, c)), F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    """0 where the whole isn't positive."""
    return F.when(whole > 0, fraction(part, whole)).otherwise(F.lit(0.0))


def proximity_result(
    source: DataFrame, target: DataFrame, shape: Sequence[int], rois: DataFrame | None = None, voxel_size: Sequence[float] = (1.0, 1.0, 1.0), distance_voxel_size: Sequence[float] | None = None,
    threshold: float = 0.2, surface_only: bool = True, axes: Sequence[str] = ("z", "y", "x"), temporal: bool = True,
) -> ProximityResult:
    """Overlap and proximity of the foreground voxels of two channels.

    source, target: (t, z, y, x, value) of foreground voxels, value the raw intensity; source may have a column label (any integer type), of
    which labels above 0 are instances; without it, or with a single label, instances are components numbered on through the frames.  shape: frames, planes, rows,
    columns.  axes: those of space, ("y", "x") for plane images.  rois: (roi_id, roi_name, frame, vertices); frame -1 holds for all frames.  Regions
    that are not valid, or hold no lattice point, have no row.  temporal: component rows of regions carry their own frame, else the region's.

    Voxels are measured from the surface if surface_only; sizes are then areas of exposed faces of the whole object.  Without regions there is one
    for the full image, and its component rows are the source instances with the target voxels that are near and nearest to them.  With regions
    they are the face-connected parts of the near target voxels by region and frame, numbered in the order of regions, frames and parts.
    Component rows are meant to be read by size (source_size if positive), roi_id, frame, component_id; summaries by roi_id.
    Empty masks: sizes and fractions 0, distances NaN, no component rows.  Null values count as 0.
    """
    spacing = tuple(distance_voxel_size or voxel_size)
    size = dict(zip("zyx", map(float, voxel_size), strict=True))
    unit = _product([size[a] for a in axes])
    source, target = (df.withColumn("value", F.coalesce("value", F.lit(0))) for df in (source, target))
    own = cut(_side(source, target.select(*VOXEL), threshold, spacing, voxel_size, axes, surface_only))
    far = cut(_side(target, source.select(*VOXEL), threshold, spacing, voxel_size, axes, surface_only))
    side = lambda df, s: df.select(*VOXEL, F.lit(s).alias("side"), "value", "area", "basis", "near", "d")
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    both = cut(side(own, "s").union(side(far, "g")).groupBy(*VOXEL).agg(*[of(c, s) for s in "sg" for c in ("value", "area", "basis", "near", "d")]))
    if rois is None:
        regions = source.sparkSession.createDataFrame([(*FULL_IMAGE, _count(shape))], "roi_id int, roi_name string, frame int, roi_size long")
        placed = both.withColumn("roi_id", F.lit(FULL_IMAGE[0]))
    else:
        regions = cut(_regions(rois, shape))
        drawn = rois.join(regions.select("roi_id"), "roi_id", "left_semi").select("roi_id", "frame", "vertices")
        placed = roi_voxels(both, drawn).join(F.broadcast(regions.select("roi_id", "frame")), "roi_id").where("frame < 0 or frame = t").drop("frame")
        placed = cut(placed)
    summary = _summary(placed, regions, unit, surface_only)
    extent = F.col("area") if surface_only else F.lit(unit)
    if rois is None:
        find = lambda: _by_instance(_instances(source), far.where("near"), extent, unit)
    else:
        near = placed.where("near_g").select("roi_id", *VOXEL, F.col("area_g").alias("area"))
        find = lambda: _by_part(near, regions, extent, int(shape[0]), temporal)
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in (("source", F.col("basis_s").isNotNull()), ("target", F.col("basis_g").isNotNull()), ("source_near", F.col("near_s")), ("target_near", F.col("near_g")))]
    return ProximityResult(summary, placed.groupBy(*VOXEL).agg(*flags), find)


def _count(shape: Sequence[int]) -> int:
    return reduce(lambda a, b: a * b, map(int, shape), 1)


def _instances(source: DataFrame) -> DataFrame:
    if "label" not in source.columns:
        return cut(instance_labels(source.select(*VOXEL, F.lit(1).alias("value")), source.select(*VOXEL)))
    return cut(instance_labels(source.select(*VOXEL, F.col("label").alias("value")), source.select(*VOXEL)).where("label > 0"))


def _summary(placed: DataFrame, regions: DataFrame, unit: float, surface_only: bool) -> DataFrame:
    has = {s: F.col(f"basis_{s}").isNotNull() for s in "sg"}
    sums, out = [F.count_if(has["s"] & has["g"]).alias("overlap_size"), F.count("*").alias("union_size")], []
    for s, name in (("s", "source"), ("g", "target")):
        value, d, basis, near = F.col(f"value_{s}"), F.col(f"d_{s}").cast("double"), F.coalesce(f"basis_{s}", F.lit(False)), F.coalesce(f"near_{s}", F.lit(False))
        sums += [
            F.count_if(has[s]).alias(f"{name}_size"), F.count_if(basis).alias(f"{name}_basis"), F.count_if(near).alias(f"{name}_proximity_size"),
            _total(F.col(f"area_{s}") if surface_only else F.lit(unit), near).cast("double").alias(f"{name}_proximity_size_physical"),
            _total(value, has[s]).alias(f"{name}_all"), _total(value, has["s"] & has["g"]).alias(f"{name}_both"), _total(value, basis).alias(f"{name}_shell"), _total(value, near).alias(f"{name}_close"),
            F.avg(F.when(basis, d)).alias(f"{name}_mean_distance"), F.median(F.when(basis, d)).alias(f"{name}_median_distance"),
        ]
    found = placed.groupBy("roi_id").agg(*sums)
    rows = regions.join(found, "roi_id", "left").fillna(0, [c for c in found.columns if c != "roi_id" and not c.endswith("_distance")]).fillna(NAN, [c for c in found.columns if c.endswith("_distance")])
    for i, name in enumerate(("source", "target"), 1):
        out += [
            fraction(F.col(f"{name}_proximity_size"), F.col(f"{name}_basis")).alias(f"{name}_proximity_fraction"),
            _share(F.col(f"{name}_close"), F.col(f"{name}_shell")).alias(f"proximity_manders_m{i}"), _share(F.col(f"{name}_both"), F.col(f"{name}_all")).alias(f"manders_m{i}"),
        ]
    o, a, b = (F.col(f"{n}_size") for n in ("overlap", "source", "target"))
    rows = rows.select("*", *out, dice(o, a, b).alias("dice"), jaccard(o, a, b).alias("jaccard"), (F.col("roi_size") * F.lit(unit)).alias("roi_size_physical"), (o * F.lit(unit)).alias("overlap_size_physical"))
    return rows.select(*SUMMARY, F.col("union_size"))


def _by_instance(instances: DataFrame, near: DataFrame, extent: Column, unit: float) -> tuple[DataFrame, DataFrame]:
    at = instances.select("t", *[F.col(c).alias(f"n{c}") for c in "zyx"], "label")
    near = cut(near.join(at, ["t", "nz", "ny", "nx"]).select(*VOXEL, "label", "area"))
    sizes = instances.groupBy("label").agg(F.count("*").alias("source_size"))
    found = near.groupBy("label").agg(F.count("*").alias("size"), F.sum(extent).cast("double").alias("size_physical"))
    rows = sizes.join(found, "label", "left").fillna(0, ["size", "size_physical"])
    rows = cut(numbered(rows, [F.desc("source_size"), F.asc("label")], "global_component_id"))
    named = rows.withColumns({"roi_id": F.lit(FULL_IMAGE[0]), "frame": F.lit(FULL_IMAGE[2]), "component_id": F.col("label"), "source_label": F.col("label"), "source_size_physical": F.col("source_size") * F.lit(unit)})
    return named.select(*COMPONENTS), near.join(rows.select("label", "global_component_id"), "label").select(*VOXEL, "global_component_id")


def _by_part(near: DataFrame, regions: DataFrame, extent: Column, frames: int, temporal: bool) -> tuple[DataFrame, DataFrame]:
    # A region's frame is a frame of its own to the labelling.
    coded = cut(near.withColumn("t", F.col("roi_id").cast("long") * frames + F.col("t")))
    parts = coded.join(label(coded.select(*VOXEL)), VOXEL).withColumnsRenamed({"label": "component_id"}).withColumn("t", (F.col("t") - F.col("roi_id").cast("long") * frames).cast("int"))
    parts = cut(parts)
    rows = parts.groupBy("roi_id", "t", "component_id").agg(F.count("*").alias("size"), F.sum(extent).cast("double").alias("size_physical"))
    rows = cut(numbered(rows, ["roi_id", "t", "component_id"], "global_component_id"))
    frame = F.col("t") if temporal else F.col("frame")
    none = {"source_label": F.lit(0), "source_size": F.lit(0).cast("long"), "source_size_physical": F.lit(0.0)}
    named = rows.join(F.broadcast(regions.select("roi_id", "frame")), "roi_id").withColumn("frame", frame).withColumns(none).select(*COMPONENTS)
    # Where regions overlap, the later one's label stands.
    labels = parts.join(rows.select("roi_id", "t", "component_id", "global_component_id"), ["roi_id", "t", "component_id"])
    return named, labels.groupBy(*VOXEL).agg(F.max("global_component_id").alias("global_component_id"))
