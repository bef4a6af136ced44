"""Editing of tracking links: only the frame pairs and lineages that edits touch are worked on again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .numbering import numbered
from .tracking import TrackingConfig, dominant_parents, events, relative_change

#: Points of an object held against those of another at once.
_AT_ONCE = 512
#: Frame pairs of edits up to which they are named one by one to the reader.
_FRAMES = 1000


@dataclass(frozen=True)
class Refined:
    """pairs: t of the frame pairs whose selection changed.  links: all links of these pairs, to replace theirs.  events: all events.  ancestry: det_id, t, parent, root of all objects."""

    pairs: DataFrame
    links: DataFrame
    events: DataFrame
    ancestry: DataFrame


def ancestry(dets: DataFrame, selected: DataFrame) -> DataFrame:
    """det_id, t, parent, root (the first ancestor) of all objects under the selected links."""
    rows = dets.select("det_id", "t").join(dominant_parents(selected), "det_id", "left")
    return _rooted(cut(rows.withColumn("fixed", F.lit(None).cast("long"))))


def _rooted(rows: DataFrame) -> DataFrame:
    """det_id, t, parent and fixed (the root of a parent outside) to det_id, t, parent, root; pointers jump to twice the distance in each round."""
    at = cut(rows.select("det_id", F.when(F.col("fixed").isNull(), F.coalesce("parent", "det_id")).alias("up"), F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(F.col("parent").isNull(), F.col("det_id")).alias("root")))
    while at.where("root IS NULL").head(1):
        far = at.select(F.col("det_id").alias("up"), F.col("up").alias("further"), F.col("root").alias("found"))
        open_ = at.where("root IS NULL").join(far, "up").select("det_id", F.col("further").alias("up"), F.col("found").alias("root"))
        at = cut(at.where("root IS NOT NULL").unionByName(open_))
    return rows.select("det_id", "t", "parent").join(at.select("det_id", "root"), "det_id")


def lineage_ids(rows: DataFrame) -> DataFrame:
    """(det_id, lineage_id) of ancestry rows, numbered from 1 in the order of the first objects."""
    roots = numbered(rows.select("root").distinct(), ["root"], "lineage_id")
    return rows.select("det_id", "root").join(roots.select("root", F.col("lineage_id").cast("int").alias("lineage_id")), "root").select("det_id", "lineage_id")


def _compared(spacing: np.ndarray) -> object:
    """Pairs with their points to the share of either's points that have one of the other within a voxel, after both are centred, and distances."""
    radius = max(float(spacing.min()), 1e-6)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((a[i : i + _AT_ONCE, None] - b[None]) ** 2).sum(2)).min(1) for i in range(0, len(a), _AT_ONCE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, dst, p, q in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = (np.array([[v["z"], v["y"], v["x"]] for v in points], float) * spacing for points in (p, q))
                a = a + (b.mean(0) - a.mean(0))
                forth, back = near(a, b), near(b, a)
                every = np.concatenate([forth, back])
                rows.append((src, dst, float(every.min()), float(every.mean()), 0.5 * float((forth <= radius).mean() + (back <= radius).mean()), 0.5 * float((forth <= radius).sum() + (back <= radius).sum()), min(len(a), len(b))))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["src", "dst", "nearest", "average", "overlap", "matched_points", "points"])

    return run


def manual_links(pairs: DataFrame, dets: DataFrame, points: DataFrame, config: TrackingConfig | None = None, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Candidate links (columns of link_table) for pairs (t, src, dst) that a user has chosen, from their centroids and sample points.

    dets: det_id, area, cz, cy, cx; points: det_id, z, y, x, as many as an object has sample points.  Spacing is in units of the last axis.  Distances are relative to the
    greatest distance of the configuration.  A pair is compared by its points alone, so a task holds those of a few pairs.
    """
    config = config or TrackingConfig()
    scale = np.asarray(spacing, float) / float(spacing[-1])
    info = lambda e: dets.select(F.col("det_id").alias(e), F.col("area").alias(f"{e}_area"), *[(F.col(f"c{c}") * float(s)).alias(f"{e}_{c}") for c, s in zip("zyx", scale, strict=True)])
    asked = pairs.select(F.explode(F.array("src", "dst")).alias("det_id")).distinct()
    held = points.join(asked, "det_id", "left_semi").groupBy("det_id").agg(F.collect_list(F.struct("z", "y", "x")).alias("points"))
    of = lambda e, n: held.select(F.col("det_id").alias(e), F.col("points").alias(n))
    both = pairs.select("src", "dst").join(of("src", "p"), "src").join(of("dst", "q"), "dst").select("src", "dst", "p", "q")
    close = both.mapInArrow(_compared(scale), "src long, dst long, nearest double, average double, overlap double, matched_points double, points long")
    rows = pairs.select("t", "src", "dst").join(info("src"), "src").join(info("dst"), "dst").join(close, ["src", "dst"], "left")
    gap = F.sqrt(sum((F.pow(F.col(f"dst_{c}") - F.col(f"src_{c}"), 2) for c in "zyx"), F.lit(0.0)))
    rows = rows.withColumn("distance", gap).fillna(0.0, ["overlap", "matched_points"]).fillna(0, ["points"])
    capacity = F.greatest(F.least("points", F.lit(max(1, config.point_support_saturation))), F.lit(1)).cast("double")
    cost = config.distance_weight * F.col("distance") / max(float(config.max_distance), 1e-6) + config.overlap_weight * (1 - F.col("overlap")) + config.point_support_weight * (1 - F.least(F.col("matched_points") / capacity, F.lit(1.0)))
    return rows.select("t", "src", "dst", "matched_points", "distance", F.coalesce("average", "distance").alias("average"), F.coalesce("nearest", "distance").alias("nearest"), "overlap", relative_change(F.col("src_area"), F.col("dst_area")).alias("area_ratio"), cost.alias("cost"), "src_area", "dst_area")


def refine(dets: DataFrame, links: DataFrame, edits: DataFrame, before: DataFrame, ancestors: DataFrame, change: float, min_size: int, added: DataFrame | None = None) -> Refined:
    """Links, events and ancestors after edits (seq, src, dst, selected), of which the last one of a link holds.

    dets: det_id, t, area; links: candidate links with t, src, dst, cost, matched_points and selected; before: the events, ancestors: the ancestry so far.  added:
    candidates for pairs without one (manual_links).  Selecting a pair without a candidate, unknown objects and frames that aren't adjacent raise an error.  What is
    already so stays so.

    Links are read by the frame pairs of the edits, which a table in partitions by t leaves the others alone for.  Events of a pair depend on its links alone;
    of the lineages those are renewed that an object with a new parent was in.
    """
    last = edits.groupBy("src", "dst").agg(F.max_by("selected", "seq").alias("wish"))
    of = lambda e: dets.select(F.col("det_id").alias(e), F.col("t").alias(f"{e}_t"))
    placed = last.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    fault = F.when(F.col("src_t").isNull() | F.col("dst_t").isNull(), "an edit names an unknown object").when(F.col("dst_t") != F.col("src_t") + 1, "a link must lead to the next frame")
    placed = cut(placed.select(F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("src_t")).alias("t"), "src", "dst", "wish"))
    asked = placed.select("t").distinct()
    # Frames as values prune a table's partitions; very many are joined.
    some = [r["t"] for r in asked.limit(_FRAMES + 1).collect()]
    own = links.where(F.col("t").isin(some)) if len(some) <= _FRAMES else links.join(asked, "t", "left_semi")
    if added is not None:
        fresh = added.join(own.select("t", "src", "dst"), ["t", "src", "dst"], "left_anti").join(placed, ["t", "src", "dst"], "left_semi").withColumn("selected", F.lit(False))
        own = own.unionByName(fresh, allowMissingColumns=True)
    lost = placed.where("wish").join(own.select("t", "src", "dst"), ["t", "src", "dst"], "left_anti").head()
    if lost:
        raise ValueError(f"there is no candidate link from {lost['src']} to {lost['dst']}")
    own = cut(own.join(placed, ["t", "src", "dst"], "left").withColumns({"was": F.col("selected"), "selected": F.coalesce("wish", "selected")}).drop("wish"))
    pairs = cut(own.where("was <> selected").select("t").distinct())
    own = own.drop("was").join(pairs, "t", "left_semi")
    chosen = own.where("selected")
    # Events of the touched pairs anew, the others as they were.
    around = pairs.select(F.explode(F.array("t", F.col("t") + 1)).alias("t")).distinct()
    ends = dets.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    renewed = events(dets.join(around, "t", "left_semi"), chosen, change, min_size, ends)
    at = F.when(F.col("kind") == "birth", F.col("frame_from") - 1).otherwise(F.col("frame_from"))
    of_pair = lambda df, how: df.withColumn("t", at).join(pairs, "t", how).select(*before.columns)
    all_events = cut(of_pair(before, "left_anti").unionByName(of_pair(renewed, "left_semi")))
    # New parents, then new roots for whole lineages that had one of these objects.
    touched = ancestors.join(pairs.select((F.col("t") + 1).alias("t")), "t", "left_semi").join(dominant_parents(chosen).withColumnRenamed("parent", "new"), "det_id", "left")
    moved = cut(touched.where("NOT (parent <=> new)").select("det_id", "new", "root"))
    stale = cut(ancestors.join(moved.select("root").distinct(), "root", "left_semi"))
    inside = stale.join(moved.select("det_id", "new", F.lit(True).alias("moved")), "det_id", "left").select("det_id", "t", F.when(F.col("moved"), F.col("new")).otherwise(F.col("parent")).alias("parent"))
    kept = ancestors.join(stale.select("det_id"), "det_id", "left_anti")
    inside = inside.join(kept.select(F.col("det_id").alias("parent"), F.col("root").alias("fixed")), "parent", "left").select("det_id", "t", "parent", "fixed")
    after = cut(kept.select("det_id", "t", "parent", "root").unionByName(_rooted(cut(inside))))
    return Refined(pairs, own, all_events, after)
