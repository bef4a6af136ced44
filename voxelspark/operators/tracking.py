"""Frame-to-frame linking of objects, lineages and events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import relative_change
from .components import detections, label, objects
from .graph import connected, cut
from .masks import VOXEL
from .neighbors import nearest_points
from .numbering import numbered


@dataclass(frozen=True)
class TrackingConfig:
    """Parameters of linking."""

    # Defaults.
    max_distance: float = 50.0
    max_neighbors: int = 6
    distance_weight: float = 0.2
    overlap_weight: float = 0.8
    point_support_weight: float = 1.0
    cost_cutoff: float = 1.5
    event_delta_threshold: float = 0.1
    sample_points: int = 3000
    point_support_saturation: int = 3
    coverage_capacity_points: int = 0
    coverage_cap_skip_threshold: float = 0.7
    min_link_size: int = 20


def weighted_centroids(labels: DataFrame, raw: DataFrame) -> DataFrame:
    """Intensity-weighted centroid of each object with weight value - least value of the object; null where all weights are 0."""
    rows = labels.join(raw.select(*VOXEL, "value"), VOXEL)
    low = rows.groupBy("t", "label").agg(F.min("value").alias("low"))
    rows = rows.join(low, ["t", "label"]).withColumn("w", F.col("value") - F.col("low"))
    sums = rows.groupBy("t", "label").agg(F.sum("w").alias("weight"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "zyx"])
    return sums.select("t", "label", "weight", *[F.when(F.col("weight") > 0, F.col(f"s{c}") / F.col("weight")).alias(f"ic{c}") for c in "zyx"])


def frame_centroids(labels: DataFrame) -> DataFrame:
    """Mean voxel of each frame's objects."""
    return labels.groupBy("t").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"g{c}") for c in "zyx"])


def frame_shifts(centroids: DataFrame) -> DataFrame:
    """Movement of the centroid from each frame to the next."""
    after = centroids.select((F.col("t") - 1).alias("t"), *[F.col(f"g{c}").alias(f"h{c}") for c in "zyx"])
    return centroids.join(after, "t").select("t", *[(F.col(f"h{c}") - F.col(f"g{c}")).alias(f"d{c}") for c in "zyx"])


def allocate_samples(weights: DataFrame, budget: int | Column) -> DataFrame:
    """Sample points per object: (t, label, weight, capacity) to samples.

    A frame deals out its budget, or its whole capacity if that is less: one to each object, then whole parts in proportion to weight as far as
    the capacity goes, then one by one in order of remainder, weight and label, round after round, to objects with room left.  Fails if there is less
    than one for each object, or no positive weight in a frame.

    Rounds are not run: objects whose room is filled before the rounds end are told by prefix sums in order of room.
    """
    frame = W.partitionBy("t")
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    rows = weights.withColumn("weight", weight).withColumn("n", F.count("*").over(frame))
    rows = rows.withColumns({"total": F.sum("weight").over(frame), "dealt": F.least((F.lit(budget) if isinstance(budget, int) else budget).cast("long"), F.sum("capacity").over(frame))})
    failed = F.when(F.col("dealt") < F.col("n"), "the budget or the capacity is less than one sample point for each object").when(F.col("total") <= 0, "no positive weight in a frame")
    rows = rows.withColumn("exact", F.when(failed.isNotNull(), F.raise_error(failed).cast("double")).otherwise(F.col("weight") / F.col("total") * (F.col("dealt") - F.col("n"))))
    rows = rows.withColumn("base", F.least(F.floor("exact"), F.col("capacity") - 1)).withColumn("room", F.col("capacity") - 1 - F.col("base"))
    rows = rows.withColumn("left", F.col("dealt") - F.col("n") - F.sum("base").over(frame))
    by_room = frame.orderBy("room", "label")
    rows = rows.withColumns({"before": F.sum("room").over(by_room) - F.col("room"), "others": F.col("n") - F.row_number().over(by_room) + 1})
    rows = rows.withColumn("full", F.col("before") + F.col("room") * F.col("others") <= F.col("left"))
    rows = rows.withColumns({"after": F.col("left") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(frame), "open": F.count_if(~F.col("full")).over(frame)})
    rounds = F.coalesce(F.floor(F.try_divide(F.col("after"), F.col("open"))), F.lit(0))
    rank = F.row_number().over(W.partitionBy("t", "full").orderBy(F.desc(F.col("exact") - F.floor("exact")), F.desc("weight"), "label"))
    more = rounds + (rank <= F.col("after") - rounds * F.col("open")).cast("int")
    return rows.select("t", "label", (1 + F.col("base") + F.when(F.col("full"), F.col("room")).otherwise(more)).cast("long").alias("samples"))


def match_points(edges: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """Greedy one-to-one matching of candidate edges (by, src, dst, cost, dist) by cost, distance, src and dst.

    In each round the edges that come first at both of their ends are taken and the edges at those ends dropped; under a strict total order this gives
    the matching of the sequential greedy algorithm, in as many rounds as the longest chain of displaced edges.
    """
    left = cut(edges.select(*by, "src", "dst", "cost", "dist"))
    taken: DataFrame | None = None
    order = F.struct("cost", "dist", "src", "dst")
    while left.head(1):
        first = lambda side: left.groupBy(*by, side).agg(F.min(order).alias(f"best_{side}"))  # noqa: B023, E731
        best = left.join(first("src"), [*by, "src"]).join(first("dst"), [*by, "dst"]).where((order == F.col("best_src")) & (order == F.col("best_dst")))
        best = cut(best.select(*by, "src", "dst", "cost", "dist"))
        taken = best if taken is None else taken.union(best)
        left = cut(left.join(best.select(*by, "src"), [*by, "src"], "left_anti").join(best.select(*by, "dst"), [*by, "dst"], "left_anti"))
    return edges.select(*by, "src", "dst", "cost", "dist").limit(0) if taken is None else taken


def point_edges(points: DataFrame, config: TrackingConfig) -> DataFrame:
    """Candidate point pairs of adjacent frames: (t, src, dst, cost, dist) over points (t, det_id, point_id, z, y, x, cz, cy, cx).

    The cost is the distance plus the difference of the distances to the source object's centroid.
    """
    src = points.select("t", F.col("point_id").alias("src"), *"zyx")
    dst = points.select((F.col("t") - 1).alias("t"), F.col("point_id").alias("dst"), *"zyx")
    near = nearest_points(src, dst, config.max_distance, config.max_neighbors, ["t"])
    a = points.select("t", F.col("point_id").alias("src"), *[F.col(c).alias(f"s{c}") for c in "zyx"], "cz", "cy", "cx")
    b = points.select((F.col("t") - 1).alias("t"), F.col("point_id").alias("dst"), *[F.col(c).alias(f"d{c}") for c in "zyx"])
    rows = near.join(a, ["t", "src"]).join(b, ["t", "dst"])
    off = lambda p: F.sqrt(sum((F.pow(F.col(f"{p}{c}") - F.col(f"c{c}"), 2) for c in "zyx"), F.lit(0.0)))
    return rows.select("t", "src", "dst", (F.sqrt("d2") + F.abs(off("s") - off("d"))).alias("cost"), F.sqrt("d2").alias("dist"))


def link_table(matches: DataFrame, owners: DataFrame, dets: DataFrame, config: TrackingConfig) -> DataFrame:
    """Candidate links between objects from point matches (t, src, dst, dist): support, coverage, distance terms and cost.

    owners: (point_id, det_id); dets: (det_id, area).  Distances are relative to the median of the frame pair.
    """
    own = lambda x: owners.select(F.col("point_id").alias(x), F.col("det_id").alias(f"{x}_id"))
    rows = matches.join(own("src"), "src").join(own("dst"), "dst")
    norm = rows.groupBy("t").agg(F.greatest(F.median("dist"), F.lit(1e-6)).alias("norm"))
    pairs = rows.groupBy("t", "src_id", "dst_id").agg(F.count("*").alias("matched"), F.avg("dist").alias("average"), F.median("dist").alias("distance"), F.min("dist").alias("nearest"))
    counts = owners.groupBy("det_id").agg(F.count("*").alias("points"))
    info = lambda x: dets.join(counts, "det_id").select(F.col("det_id").alias(f"{x}_id"), F.col("area").alias(f"{x}_area"), F.col("points").alias(f"{x}_points"))
    pairs = pairs.join(norm, "t").join(info("src"), "src_id").join(info("dst"), "dst_id")
    part = lambda n: F.least(F.col("matched") / F.greatest(n, F.lit(1)).cast("double"), F.lit(1.0))
    plain = 0.5 * (part(F.col("src_points")) + part(F.col("dst_points")))
    floor = F.when((F.lit(config.coverage_capacity_points) > 0) & (plain < config.coverage_cap_skip_threshold), F.lit(config.coverage_capacity_points)).otherwise(F.lit(0))
    cover = 0.5 * (part(F.greatest(F.col("src_points"), floor)) + part(F.greatest(F.col("dst_points"), floor)))
    support = part(F.least(F.col("src_points"), F.col("dst_points"), F.lit(max(1, config.point_support_saturation))))
    terms = [config.distance_weight * (F.col("distance") / F.col("norm")), config.overlap_weight * (1 - cover), config.point_support_weight * (1 - support)]
    return pairs.select(
        "t", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("matched").alias("matched_points"), "distance", "average", "nearest", cover.alias("overlap"),
        relative_change(F.col("src_area"), F.col("dst_area")).alias("area_ratio"), (terms[0] + terms[1] + terms[2]).alias("cost"), "src_area", "dst_area",
    )


def match_summary(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Points, matched pairs and coverage of each pair of adjacent frames, and of all together (frames null): frame_from, frame_to, src_points, dst_points, matched_pairs, src_coverage, dst_coverage.

    points: (t, ...), one row each; matches: (t, ...), t the earlier frame.  A pair needs a frame with points at either end up to the last frame; where one has none, its
    coverage is 0.  The total row counts the points of each pair, so a frame between two others counts twice.
    """
    # Counts of points as sources and targets and of matches meet as rows of one kind, for one shuffle.
    last = points.agg(F.max("t").alias("last"))
    side = lambda df, t, *n: df.groupBy(t.alias("t")).agg(F.count("*").alias("n")).select("t", *[(F.col("n") if i in n else F.lit(0)).alias(c) for i, c in enumerate(("src_points", "dst_points", "matched_pairs"))])
    rows = side(points, F.col("t"), 0).union(side(points, F.col("t") - 1, 1)).union(side(matches, F.col("t"), 2))
    rows = rows.join(F.broadcast(last), (F.col("t") < F.col("last")) & (F.col("t") >= 0)).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("src_points", "dst_points", "matched_pairs")])
    rows = rows.rollup("t").agg(*[F.sum(c).alias(c) for c in ("src_points", "dst_points", "matched_pairs")], F.grouping("t").alias("g"))
    # An empty table has no total either.
    share = lambda c: F.coalesce(F.try_divide(F.col("matched_pairs").cast("double"), F.col(c).cast("double")), F.lit(0.0))
    rows = rows.where("g = 0 OR src_points IS NOT NULL")
    return rows.select(F.col("t").alias("frame_from"), (F.col("t") + 1).alias("frame_to"), "src_points", "dst_points", "matched_pairs", share("src_points").alias("src_coverage"), share("dst_points").alias("dst_coverage"))


def select_links(links: DataFrame, cutoff: float, min_size: int) -> DataFrame:
    """Links between two large objects within the cutoff."""
    return links.where((F.col("cost") <= cutoff) & (F.col("src_area") > min_size) & (F.col("dst_area") > min_size))


def _rescued(candidates: DataFrame, small: str, large: str, cutoff: float) -> DataFrame:
    """(src, dst) of the links that large objects without one take up with small objects, each of which goes to one large object.

    Within the cutoff each small object goes to its best large one, so that a large object may get several.  Large ones that are left over then get
    the best link there is, beyond the cutoff too, to a small object that is still free.
    """
    best = F.min(F.struct("cost", (-F.col("matched_points")).alias("m"), "src", "dst")).alias("best")
    near = cut(candidates.where(F.col("cost") <= cutoff).groupBy(small).agg(best).select("best.src", "best.dst"))
    rest = candidates.join(near.select(large).distinct(), large, "left_anti").join(near.select(small), small, "left_anti")
    return near.union(match_points(rest.withColumn("dist", -F.col("matched_points"))).select("src", "dst"))


def rescue_links(links: DataFrame, selected: DataFrame, cutoff: float, min_size: int) -> DataFrame:
    """selected with further links for large objects that have none on one side.

    First links between large and small objects in both directions; then, for each large object still without a link forwards or backwards, its best
    one to another large object, whatever it costs.  Equal costs go by matched points, then source and target.
    """
    small, large = (lambda side: F.col(f"{side}_area") <= min_size), (lambda side: F.col(f"{side}_area") > min_size)
    lone = lambda rows, side, taken: rows.join(taken.select(side).distinct(), side, "left_anti")
    pairs = selected.select("src", "dst")
    into = lone(lone(links.where(small("src") & large("dst")), "dst", pairs), "src", pairs)
    out = lone(lone(links.where(large("src") & small("dst")), "src", pairs), "dst", pairs)
    pairs = cut(pairs.union(_rescued(into, "src", "dst", cutoff)).union(_rescued(out, "dst", "src", cutoff)))
    # In order of cost, the first link of an object without any is always taken, and no later one for its sake.
    best = F.min(F.struct("cost", (-F.col("matched_points")).alias("m"), "src", "dst")).alias("best")
    both = links.where(large("src") & large("dst"))
    first = lambda side: lone(both, side, pairs).groupBy(side).agg(best).select("best.src", "best.dst")
    pairs = pairs.union(first("src")).union(first("dst")).distinct()
    return links.join(pairs, ["src", "dst"], "left_semi")


def dominant_parents(links: DataFrame) -> DataFrame:
    """(det_id, parent): of the links into an object the one with most matched points, then least cost, then least source."""
    return links.groupBy(F.col("dst").alias("det_id")).agg(F.min(F.struct((-F.col("matched_points")).alias("m"), "cost", "src"))["src"].alias("parent"))


def lineages(dets: DataFrame, parents: DataFrame) -> DataFrame:
    """(det_id, lineage_id): objects inherit the lineage of their dominant parent; new ones are numbered from 1 by frame and id.

    Pointers to ancestors are doubled until all are roots, so the rounds grow with the logarithm of the number of frames.
    """
    at = cut(dets.select("det_id").join(parents, "det_id", "left").select("det_id", F.coalesce("parent", "det_id").alias("root")))
    while True:
        up = at.select(F.col("det_id").alias("root"), F.col("root").alias("next"))
        jumped = cut(at.join(up, "root").select("det_id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        at = jumped.select("det_id", "root")
        if not jumped.where("moved").head(1):
            break
    # Ids grow with the frame, so the order of roots is that of (frame, id).
    roots = numbered(at.select("root").distinct(), ["root"], "lineage_id").withColumn("lineage_id", F.col("lineage_id").cast("int"))
    return at.join(roots, "root").select("det_id", "lineage_id")


def _ids(column: Column) -> Column:
    return F.array_sort(F.collect_set(column))


def events(dets: DataFrame, links: DataFrame, change: float, min_size: int, ends: DataFrame | None = None) -> DataFrame:
    """kind, frame_from, frame_to, sources, targets from selected links (t, src, dst) and objects (det_id, t, area).

    Links of a frame pair form components: one to one is a continuation, or an elongation or shortening where the area changes by the given part
    or more; one to many a fission, many to one a fusion, else a split-merge.  Unlinked objects up to min_size are births and deaths.
    ends: the first and last frame, if dets are not those of all frames.
    """
    # Sources and targets of a frame pair are different nodes even though an object is target in one pair and source in the next.
    node = lambda side: F.col(side) * 2 + (0 if side == "src" else 1)
    edges = links.select(node("src").alias("a"), node("dst").alias("b"))
    roots = connected(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges)
    groups = links.select("t", "src", "dst", node("src").alias("id")).join(roots, "id").groupBy("t", "root").agg(_ids(F.col("src")).alias("sources"), _ids(F.col("dst")).alias("targets"))
    area = lambda c, name: dets.select(F.col("det_id").alias(c), F.col("area").alias(name))
    groups = groups.withColumns({"s0": F.col("sources")[0], "d0": F.col("targets")[0]}).join(area("s0", "a0"), "s0").join(area("d0", "b0"), "d0")
    single = F.when(relative_change(F.col("a0"), F.col("b0")) < change, "continuation").when(F.col("b0") > F.col("a0"), "elongation").otherwise("shortening")
    one, many = F.size("sources") == 1, F.size("targets") == 1
    kind = F.when(one & many, single).when(one, "fission").when(many, "fusion").otherwise("split-merge")
    linked = groups.select(kind.alias("kind"), F.col("t").alias("frame_from"), (F.col("t") + 1).alias("frame_to"), "sources", "targets")
    last = dets.agg(F.min("t").alias("first"), F.max("t").alias("last")) if ends is None else ends
    small = dets.where(F.col("area") <= min_size).join(F.broadcast(last))
    none = F.array().cast("array<bigint>")
    born = small.where("t > first").join(links.select(F.col("dst").alias("det_id")).distinct(), "det_id", "left_anti").select(F.lit("birth").alias("kind"), F.col("t").alias("frame_from"), F.col("t").alias("frame_to"), none.alias("sources"), F.array("det_id").alias("targets"))
    died = small.where("t < last").join(links.select(F.col("src").alias("det_id")).distinct(), "det_id", "left_anti").select(F.lit("death").alias("kind"), F.col("t").alias("frame_from"), F.col("t").alias("frame_to"), F.array("det_id").alias("sources"), none.alias("targets"))
    return linked.union(born).union(died)


def unlinked_large(dets: DataFrame, links: DataFrame, min_size: int) -> DataFrame:
    """Large objects without a link backwards or forwards, where a frame lies there: (det_id, t, area, missing)."""
    ends = dets.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    large = dets.where(F.col("area") > min_size).join(F.broadcast(ends))
    into = large.where("t > first").join(links.select(F.col("dst").alias("det_id")).distinct(), "det_id", "left_anti").select("det_id", "t", "area", F.lit("source").alias("missing"))
    out = large.where("t < last").join(links.select(F.col("src").alias("det_id")).distinct(), "det_id", "left_anti").select("det_id", "t", "area", F.lit("target").alias("missing"))
    return into.union(out)


def overlap_links(labels: DataFrame, dets: DataFrame) -> DataFrame:
    """Links between objects of adjacent frames that share voxel positions: matched_points counts them, cost is 1 - Jaccard."""
    own = labels.join(dets.select("t", "label", "det_id", "area"), ["t", "label"])
    after = own.select((F.col("t") - 1).alias("t"), "z", "y", "x", F.col("det_id").alias("dst"), F.col("area").alias("dst_area"))
    shared = own.select(*VOXEL, F.col("det_id").alias("src"), F.col("area").alias("src_area")).join(after, VOXEL).groupBy("t", "src", "dst", "src_area", "dst_area").agg(F.count("*").alias("matched_points"))
    cost = 1 - F.col("matched_points") / (F.col("src_area") + F.col("dst_area") - F.col("matched_points")).cast("double")
    return shared.withColumn("cost", cost)


def paint_lineages(labels: DataFrame, dets: DataFrame, found: DataFrame) -> DataFrame:
    """Voxels with the lineage of their object."""
    return labels.join(dets.select("t", "label", "det_id"), ["t", "label"]).join(found, "det_id").select(*VOXEL, "lineage_id")


def track(mask: DataFrame, config: TrackingConfig | None = None) -> dict[str, DataFrame]:
    """Labels, objects, candidate and selected links, lineages and events of a mask time series; every mask voxel is a sample point."""
    config = config or TrackingConfig()
    labels = cut(label(mask))
    dets = cut(detections(objects(labels)))
    points = labels.join(dets.select("t", "label", "det_id", "cz", "cy", "cx"), ["t", "label"])
    points = cut(points.withColumn("point_id", F.xxhash64("t", "z", "y", "x")))
    matched = match_points(point_edges(points, config))
    links = cut(link_table(matched, points.select("point_id", "det_id"), dets.select("det_id", "area"), config))
    chosen = cut(rescue_links(links, select_links(links, config.cost_cutoff, config.min_link_size), config.cost_cutoff, config.min_link_size))
    return {"labels": labels, "objects": dets, "links": links, "selected": chosen, "lineages": lineages(dets, dominant_parents(chosen)), "events": events(dets, chosen, config.event_delta_threshold, config.min_link_size)}
