"""Minimum-cost point matching and weighted sampling, in Arrow batches of whole components of candidates or whole objects."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected, cut
from .groups import whole

#: Distances of points to centres that are held at once.
_CELLS = 1 << 20


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a minimum-cost assignment of a matrix with no more rows than columns, by shortest augmenting paths (Jonker and Volgenant 1987)."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            r = row_of[j]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j
            free = np.flatnonzero(~used[1:]) + 1
            k = free[np.argmin(least[free])]
            delta = least[k]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if row_of[j] == 0:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def assign_sparse(first: np.ndarray, column: np.ndarray, cost: np.ndarray, columns: int, unmatched: float) -> np.ndarray:
    """Edge of each row in a least-cost assignment, or -1: row i has the edges first[i] to first[i + 1], ordered by column, or stays without one for `unmatched`.

    Shortest augmenting paths as in assign, over the edges alone: memory follows the edges, and as any row may end a path by staying without an edge, a search
    goes no further than costs of `unmatched`.
    """
    starts, to, price = first.tolist(), column.tolist(), cost.tolist()
    n = len(starts) - 1
    u, v = [0.0] * n, [0.0] * columns
    edge_of, row_at = [-1] * n, [-1] * columns
    for i in range(n):
        least: dict[int, float] = {}
        by: dict[int, tuple[int, int]] = {}
        heap: list[tuple[float, int]] = []
        done: set[int] = set()
        row, base, out, out_row = i, 0.0, float("inf"), -1
        while True:
            for e in range(starts[row], starts[row + 1]):
                c = to[e]
                d = base + price[e] - u[row] - v[c]
                if d < least.get(c, float("inf")) and c not in done:
                    least[c], by[c] = d, (row, e)
                    heappush(heap, (d, c))
            alone = base + unmatched - u[row]
            if (alone, row) < (out, out_row):
                out, out_row = alone, row
            while heap and heap[0][0] > least[heap[0][1]]:
                heappop(heap)
            if not heap or heap[0][0] > out:
                end, c = out, -1
                break
            end, c = heappop(heap)
            if row_at[c] < 0:
                break
            done.add(c)
            row, base = row_at[c], end
        u[i] += end
        for k in done:
            u[row_at[k]] += end - least[k]
            v[k] -= end - least[k]
        if c < 0:
            held, edge_of[out_row] = edge_of[out_row], -1
            c = to[held] if held >= 0 else -1
        while c >= 0:
            row, e = by[c]
            held, edge_of[row], row_at[c] = edge_of[row], e, row
            c = to[held] if held >= 0 else -1
    return np.array(edge_of, np.int64)


def _matched(unmatched: float):
    """root, t, src, dst, cost, dist sorted by these to the edges taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, [0, 1]):
            t, src, dst, cost, dist = (table.column(i).to_numpy() for i in range(1, 6))
            differs = lambda *columns: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            keep = differs(t, src, dst)
            t, src, dst, cost, dist = (c[keep] for c in (t, src, dst, cost, dist))
            targets = np.unique(np.stack([t, dst]), axis=1, return_inverse=True)[1].reshape(-1)
            first = np.append(np.flatnonzero(differs(t, src)), len(t))
            edge = assign_sparse(first, targets, cost, int(targets.max()) + 1, unmatched)
            edge = edge[edge >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(c[edge]) for c in (t.astype(np.int32), src, dst, cost, dist)], ["t", "src", "dst", "cost", "dist"])

    return run


def match_optimal(edges: DataFrame, unmatched: float) -> DataFrame:
    """One-to-one matching of candidate edges (t, src, dst, cost, dist) with least total cost, where leaving a source out costs `unmatched`.

    An edge dearer than `unmatched` is in no such matching.  The rest falls into connected components, which are matched apart: a task holds some components, or
    one that is larger, by its edges.
    """
    node = lambda side, c: F.xxhash64("t", F.lit(side), c)
    # Nodes that share a hash only put two components together.
    near = edges.select(F.col("t").cast("int").alias("t"), *[F.col(c).cast("long").alias(c) for c in ("src", "dst")], *[F.col(c).cast("double").alias(c) for c in ("cost", "dist")]).where(F.col("cost") <= float(unmatched))
    near = cut(near.withColumn("a", node("src", "src")))
    roots = connected(near.select(F.col("a").alias("id")).distinct(), near.select("a", node("dst", "dst").alias("b"), "t", "src"), ["t", "src"])
    order = ["root", "t", "src", "dst", "cost", "dist"]
    rows = near.join(roots.withColumnRenamed("id", "a"), "a").select(*order)
    return rows.repartition("root").sortWithinPartitions(*order).mapInArrow(_matched(float(unmatched)), "t int, src long, dst long, cost double, dist double")


def weighted_centres(points: np.ndarray, weights: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Indices of n distinct points near the centres of a weighted centroidal Voronoi partition.

    Weights are at least a twentieth of their median.  The first centre is the heaviest point, each further one the point with the greatest
    weighted distance to those before; after the rounds each centre takes the nearest point that is still free.
    """
    if n >= len(points):
        return np.arange(len(points))
    w = np.maximum(weights, 0.05 * np.median(weights[weights > 0]) if (weights > 0).any() else 1.0)
    chosen = [int(np.argmax(w))]
    gap = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(np.argmax(gap * w)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres, step = points[chosen].astype(float), max(1, _CELLS // n)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(((points[k : k + step, None] - centres[None]) ** 2).sum(2), axis=1) for k in range(0, len(points), step)])
        mass = np.bincount(own, w, n)
        moved = np.stack([np.bincount(own, w * points[:, k], n) for k in range(points.shape[1])], 1) / np.maximum(mass, 1e-12)[:, None]
        moved[mass == 0] = centres[mass == 0]
        if np.allclose(moved, centres):
            break
        centres = moved
    free, out = np.ones(len(points), bool), []
    for c in centres:
        d = ((points - c) ** 2).sum(1)
        d[~free] = np.inf
        out.append(int(np.argmin(d)))
        free[out[-1]] = False
    return np.array(out)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, label, z, y, x, value, samples sorted by these to the sample points of each object."""
    for table in whole(batches, [0, 1]):
        t, label, *axes, value, samples = (c.to_numpy() for c in table.columns)
        points, weights = np.stack(axes, 1).astype(float), value.astype(float)
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (label[1:] != label[:-1])])).tolist()
        take = [a + np.sort(weighted_centres(points[a:b], weights[a:b], int(samples[a]))) for a, b in zip(first, [*first[1:], len(t)], strict=True)]
        yield from table.select([0, 1, 2, 3, 4]).take(pa.array(np.concatenate(take))).to_batches()


def sample_points(voxels: DataFrame, samples: DataFrame) -> DataFrame:
    """(t, label, z, y, x) of the sample points of each object: voxels (t, label, z, y, x, value), samples (t, label, samples).

    Objects with no more voxels than sample points, most of them, are taken whole without a kernel.
    """
    names = ["t", "label", "z", "y", "x"]
    rows = voxels.select(*[F.col(c).cast("int").alias(c) for c in names], F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy("t", "label").agg(F.count("*").alias("size")).join(samples.select("t", "label", F.col("samples").cast("long").alias("samples")), ["t", "label"])
    rows = cut(rows.join(sizes, ["t", "label"]))
    some = rows.where("samples < size").select(*names, "value", "samples")
    some = some.repartition("t", "label").sortWithinPartitions(*some.columns).mapInArrow(_sampled, "t int, label int, z int, y int, x int")
    return rows.where("samples >= size").select(*names).union(some)
