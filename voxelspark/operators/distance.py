"""Exact distances to the nearest target voxel, axis by axis."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .masks import VOXEL
from .tiles import EDGE, TILE, spread

#: Steps up to which a bounded search looks at each of them, on tiles.
MOST_STEPS = 400
#: Rows of the image around a voxel up to which a bounded search looks into each of them.
MOST_ROWS = 400
#: Parabolas and asked positions of lines that a task works on at once; a longer line comes alone.
_AT_ONCE = 1 << 17


def lowest(line: np.ndarray, place: np.ndarray, height: np.ndarray, ask_line: np.ndarray, ask: np.ndarray, spacing: float) -> np.ndarray:
    """For each asked position the parabola, height + (spacing * (place - ask))**2, that is lowest there among those of its line.

    Parabolas are ordered by line and place, asked positions by line and position; each line asked has a parabola.  Of equals the first one counts.  All parabolas
    have one width, so the lowest one moves on as positions do: a line's middle position splits parabolas and positions, and halves are solved alike.  Each
    round looks at each parabola about once, so the work is linear in a line but for the logarithm of its positions.
    """
    out = np.zeros(len(ask), np.int64)
    if not len(ask):
        return out
    first = np.flatnonzero(np.concatenate([[True], ask_line[1:] != ask_line[:-1]]))
    low, high = first, np.append(first[1:], len(ask)) - 1
    left, right = np.searchsorted(line, ask_line[first]), np.searchsorted(line, ask_line[first], "right") - 1
    while len(low):
        middle = (low + high) // 2
        n = right - left + 1
        start = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(left - start, n)
        cost = height[at] + ((place[at] - np.repeat(ask[middle], n)) * spacing) ** 2
        equal = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, start), n))
        best = at[equal[np.searchsorted(equal, start)]]
        out[middle] = best
        low, high, left, right = (np.concatenate(x) for x in ((low, middle + 1), (middle - 1, high), (left, best), (best, right)))
        rest = low <= high
        low, high, left, right = low[rest], high[rest], left[rest], right[rest]
    return out


def _pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows whose sizes add up to at most so much, or of one row."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _swept(keys: int, spacing: float, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """keys, line (place, d2, ...), at to keys, asked position, d2, place, ...: the lowest parabola of each line at its asked positions.

    A batch counts lines, however long; it is worked on in slices of about equal memory.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(keys + i).value_lengths().to_numpy().astype(np.int64) for i in range(2)]
                yield from _pieces(batch, sizes[0] + sizes[1], _AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lines, asked = batch.column(keys), batch.column(keys + 1)
            own = np.repeat(np.arange(len(lines)), lines.value_lengths().to_numpy())
            fields = [f.to_numpy(zero_copy_only=False) for f in lines.flatten().flatten()]
            order = np.lexsort((fields[0], own))
            own, fields = own[order], [f[order] for f in fields]
            of = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            ask = asked.flatten().to_numpy()
            order = np.lexsort((ask, of))
            of, ask = of[order], ask[order]
            best = lowest(own, fields[0].astype(float), fields[1], of, ask.astype(float), spacing)
            d2 = fields[1][best] + ((fields[0][best] - ask) * spacing) ** 2
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(keys)), pa.array(ask), pa.array(d2), pa.array(fields[0][best]), *(pa.array(f[best]) for f in fields[2:])], list(names))

    return run


def _sweep(rows: DataFrame, asked: DataFrame, keys: Sequence[str], over: Sequence[str], place: str, name: str, spacing: float, carry: Sequence[str]) -> DataFrame:
    """Candidates rows (keys, place, d2, carry) to the best one at the asked (over, name) positions: keys, name, d2, place, carry."""
    at = asked.groupBy(*over).agg(F.collect_set(name).alias("at"))
    lines = rows.groupBy(*keys).agg(F.collect_list(F.struct(place, "d2", *carry)).alias("line")).join(at, list(over)).select(*keys, "line", "at")
    kind = {f.name: f for f in rows.schema} | {f.name: f for f in asked.schema}
    schema = StructType([*(kind[k] for k in keys), StructField(name, kind[name].dataType), StructField("d2", DoubleType()), StructField(place, kind[place].dataType), *(kind[c] for c in carry)])
    return lines.mapInArrow(_swept(len(keys), spacing, schema.names), schema)


def _beside(hit: DataFrame, asked: DataFrame, spacing: float) -> DataFrame:
    """asked (t, z, y, x, ...) positions with nx (and label) of the nearest hit in their row, the lesser of two equals, and d2; none without a hit in the row."""
    extra = [c for c in asked.columns if c not in VOXEL]
    mark = F.struct(F.col("x").alias("nx"), *[c for c in hit.columns if c not in VOXEL])
    kind = hit.select(mark.alias("m")).schema["m"].dataType
    blank = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra]
    line = hit.select(*VOXEL, mark.alias("hit"), F.lit(False).alias("ask"), *blank).union(asked.select(*VOXEL, F.lit(None).cast(kind).alias("hit"), F.lit(True).alias("ask"), *extra))
    row = W.partitionBy("t", "z", "y").orderBy("x", "ask")
    back = F.last("hit", True).over(row.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("hit", True).over(row.rowsBetween(0, W.unboundedFollowing))
    line = line.withColumns({"b": back, "a": ahead}).where("ask AND coalesce(a, b) IS NOT NULL")
    best = F.when(F.col("a").isNull() | (F.col("x") - F.col("b.nx") <= F.col("a.nx") - F.col("x")), F.col("b")).otherwise(F.col("a"))
    return line.withColumn("h", best).select(*VOXEL, *extra, "h.*").withColumn("d2", F.pow((F.col("nx") - F.col("x")) * F.lit(spacing), 2))


def nearest(src: DataFrame, dst: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), within: float | None = None) -> DataFrame:
    """For each distinct source voxel of a frame: squared distance d2 to the nearest target voxel and that voxel's nz, ny, nx (and label).

    within: only targets up to this distance count.  Ties go to the least (z, y, x).  Sources without a target, in their frame or within reach, have null d2.

    Separable: first the nearest target along x in every target row at the x of the sources (a window looking both ways), then the best row
    for each source y, then the best plane, each by the lower envelope of parabolas over a line.  Lines are rows of arrays, so a line must fit in a task.  A small reach
    looks at the voxels around on tiles of the image, or into the rows that it touches, in one shuffle.
    """
    spacing = [float(s) for s in spacing]
    label = ["label"] if "label" in dst.columns else []
    hit = dst.select(*VOXEL, *label)
    if within is not None and (steps := _steps_within(float(within), spacing)) is not None:
        return _nearest_on_tiles(src.select(*VOXEL), hit, steps)
    own = src.select(*VOXEL).distinct()
    if within is not None:
        near = _rows_within(float(within), spacing)
        if len(near) <= MOST_ROWS:
            return _nearest_within(own, hit, spacing, float(within), near, label)
    asked = hit.select("t", "z", "y").distinct().join(own.select("t", "x").distinct(), "t")
    line = _beside(hit, asked, spacing[2]).select("t", F.col("z").alias("nz"), F.col("y").alias("ny"), "x", "d2", "nx", *label)
    plane = _sweep(line, own.select("t", "x", "y"), ["t", "nz", "x"], ["t", "x"], "ny", "y", spacing[1], ["nx", *label])
    found = _sweep(plane, own, ["t", "y", "x"], ["t", "y", "x"], "nz", "z", spacing[0], ["ny", "nx", *label])
    if within is not None:
        found = found.where(F.col("d2") <= float(within) ** 2)
    return own.join(found, VOXEL, "left").select(*VOXEL, "d2", "nz", "ny", "nx", *label)


def _steps_within(within: float, spacing: Sequence[float]) -> list[tuple[float, int, int, int]] | None:
    """(d2, dz, dy, dx) of the steps up to this length, in the order of choice; None if they are too many."""
    if within < 0:
        return []
    if not prod(2 * (within // s) + 1 for s in spacing) <= 8 * MOST_STEPS:
        return None
    square = lambda v: v * v
    around = product(*(range(-int(within // s) - 1, int(within // s) + 2) for s in spacing))
    steps = [(square(dx * spacing[2]) + (square(dz * spacing[0]) + square(dy * spacing[1])), dz, dy, dx) for dz, dy, dx in around]
    steps = sorted(s for s in steps if s[0] <= within * within)
    return steps if len(steps) <= MOST_STEPS else None


def _on_tile(steps: Sequence[tuple[float, int, int, int]], reach: Sequence[int], schema: Sequence[str], label: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind = {f.name: f.type for f in rows.schema}
        asked = rows["ask"].to_numpy()
        at = [rows[c].to_numpy().astype(np.int64) for c in "zyx"]
        own = [a[asked] for a in at]
        hits = rows.filter(pc.invert(rows["ask"]))
        if label:
            # Of several targets at one place the least label counts, which is written last.
            hits = hits.sort_by([("label", "descending")])
        # A border around the image, so that no step leaves it.
        first = [int(a.min()) - r if len(a) else 0 for a, r in zip(own, reach)]
        shape = [int(a.max()) + r - f + 1 if len(a) else 0 for a, r, f in zip(own, reach, first)]
        place = np.ravel_multi_index([a - f for a, f in zip(own, first)], shape) if len(own[0]) else np.empty(0, np.int64)
        place = np.unique(place)
        held = np.full(int(np.prod(shape)), -1, np.int32)
        there = [hits[c].to_numpy().astype(np.int64) - f for c, f in zip("zyx", first)]
        inside = np.flatnonzero(np.all([(a >= 0) & (a < n) for a, n in zip(there, shape)], 0))
        if len(place):
            held[np.ravel_multi_index([a[inside] for a in there], shape)] = inside
        best, step = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
        left = np.arange(len(place))
        for i, (_, dz, dy, dx) in enumerate(steps):
            found = held[place[left] + (dz * shape[1] + dy) * shape[2] + dx]
            some = found >= 0
            best[left[some]], step[left[some]] = found[some], i
            left = left[~some]
            if not len(left):
                break
        z, y, x = np.unravel_index(place, shape) if len(place) else (place,) * 3
        take = pa.array(best, mask=best < 0)
        d2 = pa.array(np.array([s[0] for s in steps] or [0.0])[step], mask=best < 0)
        columns = [pa.array([key[0].as_py()] * len(place), kind["t"]), *(pa.array(a + f, kind[c]) for a, f, c in zip((z, y, x), first, "zyx")), d2, *(hits[c].combine_chunks().take(take) for c in ("z", "y", "x", *["label"] * label))]
        return pa.table(columns, names=list(schema))

    return run


def _nearest_on_tiles(src: DataFrame, hit: DataFrame, steps: Sequence[tuple[float, int, int, int]]) -> DataFrame:
    """nearest, by the steps from each source voxel; a tile of the image, with the targets around it, is worked on at once."""
    label = ["label"] if "label" in hit.columns else []
    reach = [max((abs(s[i]) for s in steps), default=0) for i in (1, 2, 3)]
    blank = [F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in label]
    asked = spread(src, EDGE, (0, 0, 0)).select(*TILE, "z", "y", "x", F.lit(True).alias("ask"), *blank)
    held = spread(hit, EDGE, reach).select(*TILE, "z", "y", "x", F.lit(False).alias("ask"), *label)
    kind = {f.name: f.dataType for f in asked.union(held).schema}
    names = [*VOXEL, "d2", "nz", "ny", "nx", *label]
    schema = StructType([StructField(n, DoubleType() if n == "d2" else kind[n[-1] if n in ("nz", "ny", "nx") else n]) for n in names])
    return asked.union(held).groupBy(*TILE).applyInArrow(_on_tile(steps, reach, names, bool(label)), schema)


def _rows_within(within: float, spacing: Sequence[float]) -> list[tuple[int, int]]:
    """Steps (dz, dy) to the rows that a ball of this radius touches."""
    reach = [int(within // s) + 1 if within >= 0 else -1 for s in spacing[:2]]
    return [(dz, dy) for dz in range(-reach[0], reach[0] + 1) for dy in range(-reach[1], reach[1] + 1) if (dz * spacing[0]) ** 2 + (dy * spacing[1]) ** 2 <= within * within]


def _nearest_within(own: DataFrame, hit: DataFrame, spacing: Sequence[float], within: float, near: Sequence[tuple[int, int]], label: Sequence[str]) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in near])) if near else F.explode(F.array().cast("array<struct<dz:int,dy:int>>"))
    asked = own.select(*VOXEL, steps.alias("s")).select("t", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), "x", F.col("z").alias("oz"), F.col("y").alias("oy"))
    off: Column = F.pow((F.col("z") - F.col("oz")) * F.lit(spacing[0]), 2) + F.pow((F.col("y") - F.col("oy")) * F.lit(spacing[1]), 2)
    rows = _beside(hit, asked, spacing[2]).withColumn("d2", F.col("d2") + off).where(F.col("d2") <= within * within)
    best = F.min(F.struct("d2", F.col("z").alias("nz"), F.col("y").alias("ny"), "nx", *label)).alias("c")
    found = rows.groupBy("t", F.col("oz").alias("z"), F.col("oy").alias("y"), "x").agg(best).select(*VOXEL, "c.*")
    return own.join(found, VOXEL, "left").select(*VOXEL, "d2", "nz", "ny", "nx", *label)


def statistics(distances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and median of the finite distances; NaN for none."""
    d = F.sqrt("d2")
    nan = F.lit(float("nan"))
    return distances.groupBy(*by).agg(F.count("d2").alias("n"), F.coalesce(F.avg(d), nan).alias("mean_distance"), F.coalesce(F.median(d), nan).alias("median_distance"))
