"""Branches of skeletons: tracing, numbering, totals, pruning and contraction, as rows of a distributed multigraph."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import connected, cut, tables
from .holes import holes
from .numbering import numbered
from .tiles import EDGE, TILE, spread

OBJECT = ["t", "label"]
#: Edge of the tiles in which boxes meet voxels.
_TILE = 32
#: What is told of a pair of touching voxels.
_PAIR = [("u", pa.int64()), ("v", pa.int64()), ("code", pa.int64()), ("length", pa.float64()), ("step", pa.bool_()), ("lead", pa.bool_()), ("degree", pa.int64()), ("other", pa.int64())]


@dataclass(frozen=True)
class Branches:
    """rows: t, label, branch_id, start_node, start_kind, end_node, end_kind, length, points (both ends counted); ends are null in a closed loop.

    points: t, label, branch_id, position, distance (from the start), z, y, x.  nodes: t, label, node, kind, z, y, x, one row for each voxel of an endpoint
    or junction; node is the voxel number of its first voxel.
    """

    rows: DataFrame
    points: DataFrame
    nodes: DataFrame


def _numbers(skeleton: DataFrame) -> DataFrame:
    """Voxels (t, label, z, y, x, id): ids grow in raster order over all frames."""
    extent = skeleton.agg(*[f(c) for c in ("t", "z", "y", "x") for f in (F.min, F.max)]).head()
    low, size = [extent[2 * i] or 0 for i in range(4)], [(extent[2 * i + 1] or 0) - (extent[2 * i] or 0) + 1 for i in range(4)]
    number: Column = F.lit(0).cast("long")
    for c, first, n in zip(("t", "z", "y", "x"), low, size, strict=True):
        number = number * n + F.col(c) - first
    return skeleton.groupBy("t", "z", "y", "x").agg(F.min("label").alias("label")).withColumn("id", number)


def _touching(planar: bool, spacing: Sequence[float]) -> Callable[[tuple, pa.Table], pa.Table]:
    """Pairs of neighbours (u, v) within an object whose u is the tile's own, with the degrees of both; steps are those that skeleton_edges keeps."""
    around = [o for o in product((0,) if planar else (-1, 0, 1), (-1, 0, 1), (-1, 0, 1)) if any(o)]
    every = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
    # The voxels between the ends of a diagonal: all proper parts of the step.
    between = {o: {q for m in product((0, 1), repeat=3) if any(q := tuple(i * j for i, j in zip(o, m))) and q != o} for o in around}
    length = {o: sum(((d * s) * (d * s) for d, s in zip(o, spacing)), 0.0) ** 0.5 for o in around}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind = {f.name: f.type for f in rows.schema}
        corner = [k.as_py() * n for k, n in zip(key[1:], EDGE)]
        at = [rows[c].to_numpy().astype(np.int64) for c in "zyx"]
        low = [int(v.min()) - 1 for v in at]
        shape = [int(v.max()) - f + 2 for v, f in zip(at, low)]
        place = np.ravel_multi_index([v - f for v, f in zip(at, low)], shape)
        held = np.full(int(np.prod(shape)), -1, np.int64)
        held[place] = np.arange(len(place))
        object_, number = np.unique(rows["label"].to_numpy(), return_inverse=True)[1], rows["id"].to_numpy()
        other = {o: held[place + (o[0] * shape[1] + o[1]) * shape[2] + o[2]] for o in every}
        beside = {o: (n >= 0) & (object_[n] == object_) for o, n in other.items()}
        step = {o: beside[o] & ~np.any([beside[q] for q in between[o]] or [np.zeros(len(place), bool)], 0) for o in around}
        degree = np.sum(list(step.values()), 0)
        own = np.all([(v >= c) & (v < c + n) for v, c, n in zip(at, corner, EDGE)], 0)
        u, v, code, far, kept = [], [], [], [], []
        for o in every:
            some = np.flatnonzero(beside[o] & own)
            u.append(some)
            v.append(other[o][some])
            code.append(np.full(len(some), (o[0] + 1) * 9 + (o[1] + 1) * 3 + o[2] + 1))
            far.append(np.full(len(some), length.get(o, 0.0)))
            kept.append(step[o][some] if o in step else np.zeros(len(some), bool))
        u, v, code, far, kept = (np.concatenate(c) for c in (u, v, code, far, kept))
        # One step of each voxel stands for it.
        order = np.lexsort((code, ~kept, u))
        u, v, code, far, kept = (c[order] for c in (u, v, code, far, kept))
        lead = np.concatenate([[True], u[1:] != u[:-1]])[: len(u)] & kept
        take = pa.array(u)
        columns = {c: rows[c].combine_chunks().take(take) for c in ("t", "label", "z", "y", "x")}
        return pa.table(columns | {"u": pa.array(number[u]), "v": pa.array(number[v]), "code": pa.array(code), "length": pa.array(far), "step": pa.array(kept), "lead": pa.array(lead), "degree": pa.array(degree[u]), "other": pa.array(degree[v])}).cast(pa.schema([(c, kind[c]) for c in ("t", "label", "z", "y", "x")] + _PAIR))

    return run


def _pairs(voxels: DataFrame, spacing: Sequence[float], planar: bool) -> DataFrame:
    """All touching pairs of voxels (t, label, z, y, x, id) in one shuffle, see _touching; the border of a tile holds the neighbours of neighbours."""
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in (*OBJECT, "z", "y", "x")] + [f"{c} {'boolean' if k == pa.bool_() else 'double' if k == pa.float64() else 'long'}" for c, k in _PAIR])
    return spread(voxels, EDGE, (2, 2, 2)).groupBy(*TILE).applyInArrow(_touching(planar, [float(s) for s in spacing]), schema)


def _regions(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes (t, label, z, y, x, id, kind) with the least id of the touching nodes of their kind and object."""
    edges = pairs.where("u > v AND (degree = 1 AND other = 1 OR degree >= 3 AND other >= 3)").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return nodes.join(connected(nodes, edges).withColumnRenamed("root", "node"), "id")


def _ranked(darts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Darts (dart, next, length; next null where a walk ends) to (dart, end, rest, steps) and the darts of walks without an end.

    rest and steps: length and number of darts up to the end, this one included; end: the last dart.  Pointers jump to twice the distance in each round; when a
    round ends no further walk, the remaining ones go in circles.
    """
    ended = F.col("next").isNull()
    at = cut(darts.select("dart", "next", F.when(ended, F.col("dart")).alias("end"), F.col("length").alias("rest"), F.lit(1).cast("long").alias("steps")))
    left = at.where("next IS NOT NULL").count()
    while left:
        far = at.select(F.col("dart").alias("next"), F.col("next").alias("after"), F.col("end").alias("last"), F.col("rest").alias("more"), F.col("steps").alias("further"))
        open_ = at.where("next IS NOT NULL").join(far, "next")
        jumped = open_.select("dart", F.col("after").alias("next"), F.col("last").alias("end"), (F.col("rest") + F.col("more")).alias("rest"), (F.col("steps") + F.col("further")).alias("steps"))
        at = cut(at.where("next IS NULL").unionByName(jumped))
        before, left = left, at.where("next IS NOT NULL").count()
        if left == before:
            break
    return at.where("next IS NULL").drop("next"), at.where("next IS NOT NULL").select("dart")


def _least(darts: DataFrame) -> DataFrame:
    """For darts (dart, next, u) that go in circles, the least u of the circle: (u, least)."""
    at = cut(darts.select("dart", "next", F.col("u").alias("least"), F.lit(True).alias("moved")))
    while at.where("moved").head(1):
        far = at.select(F.col("dart").alias("next"), F.col("next").alias("after"), F.col("least").alias("other"))
        less = F.least("least", "other")
        at = cut(at.join(far, "next").select("dart", F.col("after").alias("next"), less.alias("least"), (less < F.col("least")).alias("moved")))
    return darts.join(at.select("dart", "least"), "dart").groupBy("u").agg(F.min("least").alias("least"))


def trace(skeleton: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), planar: bool = False) -> Branches:
    """Branches of the skeletons (t, label, z, y, x) of all objects at once.

    Voxels are neighbours as in skeleton_edges, within an object.  Those with one neighbour are endpoints, with three or more junctions; touching ones of a kind are one
    node, and no branch runs inside a node.  A branch is a walk over voxels with two neighbours from node to node.  Direct steps between the same two
    nodes are one branch, the shortest.  A closed loop is a branch, starting at its first voxel, where its object has no node at all.

    Each step between neighbours is two darts; a dart's next one is told by its head, and walks are ranked by pointer jumping, in as many rounds as the
    longest branch has binary digits.  No object is gathered anywhere.  A voxel that several objects claim belongs to the least.
    """
    voxels = cut(_numbers(skeleton.select(*OBJECT, "z", "y", "x")))
    place = voxels.select(*OBJECT, "z", "y", "x", "id")
    pairs = cut(_pairs(voxels, spacing, planar))
    # A dart is named by its tail and direction, so the reverse of each is known.
    darts = pairs.where("step").select(*OBJECT, "u", "v", "length", (F.col("u") * 27 + F.col("code")).alias("dart"), (F.col("v") * 27 + 26 - F.col("code")).alias("back"))
    kind = F.when(F.col("degree") == 1, "endpoint").when(F.col("degree") >= 3, "junction")
    nodes = cut(pairs.where("lead AND degree <> 2").select(F.col("u").alias("id"), *OBJECT, "z", "y", "x", kind.alias("kind")))
    nodes = cut(_regions(nodes, pairs))
    of = lambda c, n: nodes.select(F.col("id").alias(c), F.col("node").alias(f"{n}_node"), F.col("kind").alias(f"{n}_kind"))
    darts = darts.join(of("u", "tail"), "u", "left").join(of("v", "head"), "v", "left").where("NOT coalesce(tail_node = head_node, false)")
    darts = cut(darts)
    after = darts.where("tail_node IS NULL").select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("dart").alias("next"))
    onward = darts.where("head_node IS NULL").join(after, "v").where("w <> u").select("dart", "next")
    linked = cut(darts.join(onward, "dart", "left"))
    ranked, circling = _ranked(linked)
    # Closed loops: cut where the first voxel stands; only in objects without nodes.
    loops = cut(linked.join(circling, "dart", "left_semi").join(nodes.select(*OBJECT).distinct(), OBJECT, "left_anti"))
    if loops.head(1):
        first = _least(loops).where("u = least").select("u")
        at = lambda c: loops.join(first.select(F.col("u").alias(c)), c, "left_semi").select("dart").withColumn(f"at_{c}", F.lit(True))
        loops = cut(loops.join(at("v"), "dart", "left").join(at("u"), "dart", "left").withColumn("next", F.when(F.col("at_v").isNull(), F.col("next"))))
        ranked = ranked.union(_ranked(loops)[0])
        linked = cut(linked.join(loops.select("dart", "at_u"), "dart", "left"))
    else:
        linked = linked.withColumn("at_u", F.lit(None).cast("boolean"))
    walks = cut(linked.join(ranked, "dart"))
    ends = walks.where("dart = end").select(F.col("dart").alias("end"), F.col("v").alias("last"), "head_node", "head_kind")
    # A branch has a first dart at either end; the one is taken whose reverse comes before the last dart of its walk.
    starts = walks.where("(tail_node IS NOT NULL OR at_u) AND back < end").drop("head_node", "head_kind").join(ends, "end")
    rows = starts.select(*OBJECT, F.col("back").alias("branch_id"), "end", F.col("u").alias("first"), "last", F.col("tail_node").alias("start_node"), F.col("tail_kind").alias("start_kind"), F.col("head_node").alias("end_node"), F.col("head_kind").alias("end_kind"), F.col("rest").alias("length"), (F.col("steps") + 1).alias("points"))
    # Direct steps between the same nodes: the shortest.
    pair = W.partitionBy(*OBJECT, F.least("start_node", "end_node"), F.greatest("start_node", "end_node"), F.col("points") > 2).orderBy("length", "branch_id")
    rows = cut(rows.withColumn("nth", F.row_number().over(pair)).where("points > 2 OR nth = 1").drop("nth"))
    inner = walks.where("tail_node IS NULL AND at_u IS NULL").select("end", F.col("u").alias("id"), "rest", "steps").join(rows.select("end", "branch_id", "length", "points"), "end")
    inner = inner.select("branch_id", "id", (F.col("points") - 1 - F.col("steps")).alias("position"), (F.col("length") - F.col("rest")).alias("distance"))
    tips = rows.select("branch_id", F.explode(F.array(F.struct(F.col("first").alias("id"), F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("distance")), F.struct(F.col("last").alias("id"), (F.col("points") - 1).alias("position"), F.col("length").alias("distance")))).alias("p")).select("branch_id", "p.*")
    points = inner.union(tips).join(place, "id").select(*OBJECT, "branch_id", "position", "distance", "z", "y", "x")
    return Branches(rows.drop("end", "first", "last"), points, nodes.select(*OBJECT, "node", "kind", "z", "y", "x"))


def table(rows: DataFrame) -> DataFrame:
    """Branch rows numbered for export: frame, object_label, branch_index, object_branch_index, branch_length, longest first within an object.

    branch_index counts on through the objects of a frame, in order of their labels.  Meant to be read by branch_length, descending.
    """
    order = ["t", "label", F.desc("length"), "branch_id"]
    number = numbered(rows, order, "n")
    first = number.groupBy("t").agg(F.min("n").alias("n0"))
    own = number.groupBy(*OBJECT).agg(F.min("n").alias("n1"))
    out = number.join(first, "t").join(own, OBJECT)
    return out.select(F.col("t").alias("frame"), F.col("label").alias("object_label"), (F.col("n") - F.col("n0") + 1).cast("long").alias("branch_index"), (F.col("n") - F.col("n1") + 1).cast("long").alias("object_branch_index"), F.col("length").alias("branch_length"))


def _ends(rows: DataFrame) -> DataFrame:
    """Both ends of each branch: t, label, branch_id, node, kind."""
    ends = F.explode(F.array(*[F.struct(F.col(f"{e}_node").alias("node"), F.col(f"{e}_kind").alias("kind")) for e in ("start", "end")])).alias("e")
    return rows.select(*OBJECT, "branch_id", ends).select(*OBJECT, "branch_id", "e.*").where("node IS NOT NULL")


def totals(rows: DataFrame) -> DataFrame:
    """Per object: branch_number, junction_number, endpoint_number, total_branch_length and mean_branch_length.

    A node with three ends of branches or more is a junction if it was one in the skeleton; one with a single end is an endpoint.
    """
    sums = rows.groupBy(*OBJECT).agg(F.count("*").alias("branch_number"), F.sum("length").alias("total_branch_length"))
    nodes = _ends(rows).groupBy(*OBJECT, "node").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    nodes = nodes.groupBy(*OBJECT).agg(F.count_if((F.col("kind") == "junction") & (F.col("n") >= 3)).alias("junction_number"), F.count_if(F.col("n") == 1).alias("endpoint_number"))
    out = sums.join(nodes, OBJECT, "left").fillna(0, ["junction_number", "endpoint_number"])
    return out.select(*OBJECT, "branch_number", "junction_number", "endpoint_number", "total_branch_length", (F.col("total_branch_length") / F.col("branch_number")).alias("mean_branch_length"))


def prune(rows: DataFrame, length: float | Column) -> DataFrame:
    """Branches but for those between an endpoint and a junction that are no longer than this."""
    terminal = F.sort_array(F.array("start_kind", "end_kind")) == F.array(F.lit("endpoint"), F.lit("junction"))
    return rows.where(~F.coalesce(terminal & (F.col("length") <= length), F.lit(False)))


def _pruned(rows: DataFrame, terminal: float | DataFrame) -> DataFrame:
    if not isinstance(terminal, DataFrame):
        return prune(rows, terminal)
    # One row for each frame.
    return prune(rows.join(terminal.select("t", "radius"), "t", "left"), F.coalesce("radius", F.lit(-1.0))).select(*rows.columns)


def contract(rows: DataFrame) -> DataFrame:
    """Branches that meet at a junction where nothing else ends, joined to one."""
    return contracted(rows)[0]


def contracted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The branches of contract, and (branch_id, root): which branch each one went into.

    Branches that meet at a junction where nothing else ends are joined to one, in all chains of such junctions at once.  A chain keeps the least branch_id and its length is the sum of its parts.  In a ring of such junctions the greatest node stays, with a loop.  The rounds
    grow with the logarithm of the longest chain.
    """
    rows = cut(rows)
    ends = _ends(rows)
    free = ends.where("kind = 'junction'").groupBy("node").agg(F.count("*").alias("n"), F.min("branch_id").alias("a"), F.max("branch_id").alias("b")).where("n = 2 AND a <> b")
    free = cut(free.select("node", "a", "b"))
    if not free.head(1):
        return rows, rows.select("branch_id", F.col("branch_id").alias("root"))
    root = connected(rows.select(F.col("branch_id").alias("id")), free.select("a", "b")).withColumnRenamed("id", "branch_id")
    joined = cut(rows.join(root, "branch_id"))
    # Points shared at a junction of one voxel count once for each part, as parts keep the voxels at which they end.
    sums = joined.groupBy(*OBJECT, "root").agg(F.sum("length").alias("length"), F.sum("points").alias("points"))
    tips = _ends(joined).join(root, "branch_id").join(free.select("node", F.lit(True).alias("free")), "node", "left")
    tips = tips.groupBy("root").agg(F.sort_array(F.collect_list(F.when(F.col("free").isNull(), F.struct("node", "kind")))).alias("ends"), F.max(F.when(F.col("free"), F.struct("node", "kind"))).alias("ring"))
    pick = lambda i: F.coalesce(F.get("ends", F.lit(i)), F.col("ring"))
    out = sums.join(tips, "root", "left").withColumns({"s": pick(0), "e": pick(1)})
    return cut(out.select(*OBJECT, F.col("root").alias("branch_id"), F.col("s.node").alias("start_node"), F.col("s.kind").alias("start_kind"), F.col("e.node").alias("end_node"), F.col("e.kind").alias("end_kind"), "length", "points")), cut(root)


def enclosing(loops: DataFrame, mask: DataFrame, planar: bool = False) -> DataFrame:
    """Those loops (t, label, loop, z, y, x) with background inside: (loop).

    The object (t, label, z, y, x) is looked at in the loop's box and one voxel around; in space, a hole in one of its three projections will do.
    Boxes meet the object in tiles, by equal keys.
    """
    box = loops.groupBy(*OBJECT, "loop").agg(*[(f(c) + (2 * i - 1)).alias(f"{c}{i}") for c in "zyx" for i, f in enumerate((F.min, F.max))])
    for c in "zyx":
        box = box.withColumn(f"k{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / _TILE), F.floor(F.col(f"{c}1") / _TILE))))
    held = mask.select(*OBJECT, "z", "y", "x", *[F.floor(F.col(c) / _TILE).alias(f"k{c}") for c in "zyx"])
    inside = box.join(held, [*OBJECT, "kz", "ky", "kx"]).where(" AND ".join(f"{c} BETWEEN {c}0 AND {c}1" for c in "zyx")).select("loop", "z", "y", "x")
    sides = [("y", "x")] if planar else [("y", "x"), ("z", "x"), ("z", "y")]
    views = F.explode(F.array(*[F.struct(F.lit(k).alias("z"), F.col(a).alias("y"), F.col(b).alias("x")) for k, (a, b) in enumerate(sides)])).alias("v")
    return holes(cut(inside.select("loop", views).select("loop", "v.*").distinct()), True, ["loop"]).select("loop").distinct()


def without_false_loops(rows: DataFrame, points: DataFrame, mask: DataFrame, planar: bool = False) -> DataFrame:
    """Branch rows but for loops around no background.

    A branch from a node to itself goes; of several between the same two nodes the shortest stays.  points: those of the branches; mask: the objects.
    """
    pair = [F.least("start_node", "end_node"), F.greatest("start_node", "end_node")]
    both = rows.withColumns({"low": pair[0], "high": pair[1]}).where("start_node IS NOT NULL AND end_node IS NOT NULL")
    one = both.where("low = high").select("branch_id", F.col("branch_id").alias("loop"))
    several = both.where("low <> high").groupBy(*OBJECT, "low", "high").agg(F.count("*").alias("n"), F.min("branch_id").alias("loop"), F.min(F.struct("length", "points", "branch_id"))["branch_id"].alias("least")).where("n > 1")
    many = both.join(several, [*OBJECT, "low", "high"]).select("branch_id", "loop", "least")
    loops = cut(one.withColumn("least", F.lit(None).cast("long")).union(many))
    if not loops.head(1):
        return rows
    real = enclosing(points.join(loops.select("branch_id", "loop"), "branch_id").select(*OBJECT, "loop", "z", "y", "x").distinct(), mask, planar)
    gone = loops.join(real, "loop", "left_anti").where("least IS NULL OR branch_id <> least").select("branch_id")
    return cut(rows.join(gone, "branch_id", "left_anti").select(*rows.columns))


def simplified(skeleton: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), planar: bool = False, terminal: float | DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Branch rows after pruning terminal branches up to a length, tracing what is left anew, pruning again, and dropping false loops and contracting until nothing changes.

    mask: the objects (t, label, z, y, x) whose background tells false loops; without it all loops stay.  terminal: a length, or one for each frame (t, radius), without a row for frames to leave alone.  None prunes nothing, as for plane images.  Objects of which no branch is left, such as single voxels, have no row.
    """
    with tables(skeleton.sparkSession) as written:
        skeleton = written(skeleton.select(*OBJECT, "z", "y", "x"))
        found = trace(skeleton, spacing, planar)
        if terminal is None:
            return found.rows
        kept = written(_pruned(found.rows, terminal))
        points = found.points.join(kept.select("branch_id"), "branch_id", "left_semi").select(*OBJECT, "z", "y", "x")
        held = found.nodes.join(_ends(kept).select("node").distinct(), "node", "left_semi").select(*OBJECT, "z", "y", "x")
        left = written(points.union(held).distinct())
        # Where nothing is left of an object its whole skeleton is traced again.
        bare = skeleton.join(left.select(*OBJECT).distinct(), OBJECT, "left_anti")
        second = trace(written(left.union(bare)), spacing, planar)
        rows = written(_pruned(second.rows, terminal))
        points, mask = written(second.points), None if mask is None else written(mask.select(*OBJECT, "z", "y", "x"))
        n, before = rows.count(), -1
        while n != before:
            if mask is not None:
                rows = without_false_loops(rows, points, mask, planar)
            rows, root = contracted(rows)
            if mask is None:
                break
            points = written(points.join(root, "branch_id").select(*OBJECT, F.col("root").alias("branch_id"), "z", "y", "x"))
            rows = written(rows)
            n, before = rows.count(), n
        return cut(rows)
