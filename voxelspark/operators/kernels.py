"""Stencil kernels on dense images in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import eigenvalues_2x2, line_and_sheet, sort_by_magnitude, vesselness_2d
from .masks import VOXEL
from .tiles import TILE, spread

#: Edge of the tiles of a volume, and its second derivatives.
_EDGE = 64
_SECOND = ("zz", "zy", "zx", "yy", "yx", "xx")


def gaussian_weights(size: int, sigma: float) -> list[float]:
    """Weights at 0, 1, ..., size // 2 of a Gaussian cut off at its size and normalised."""
    half = [exp(-((k / sigma) ** 2) / 2) for k in range(size // 2 + 1)]
    total = half[0] + 2 * sum(half[1:])
    return [w / total for w in half]


def _reflect(i: Column, n: Column) -> Column:
    """Index mirrored at the borders without repeating them; images of one row or narrower than the kernel are clamped."""
    j = F.abs(i)
    j = F.when(j >= n, 2 * (n - 1) - j).otherwise(j)
    return F.greatest(F.lit(0), F.least(j, n - 1))


def along(image: DataFrame, axis: str, columns: Sequence[str], combine: Callable[[Callable[[int], Column]], Column]) -> DataFrame:
    """Replace columns by combine(neighbour) along an axis, where neighbour(k) is the value k further on.

    Each line of the image is gathered into one array, bounded by the image's extent along the axis, so an axis costs one shuffle.
    """
    rest = [c for c in VOXEL if c != axis]
    lines = image.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(axis, *columns))).alias("line")).withColumn("n", F.size("line"))

    def one(item: Column, i: Column) -> Column:
        value = lambda c: (lambda k: F.get("line", _reflect(i + k, F.col("n")))[c])
        return F.struct(item[axis].alias(axis), *[combine(value(c)).alias(c) for c in columns])

    return lines.select(*rest, F.explode(F.transform("line", one)).alias("o")).select(*rest, "o.*").select(*VOXEL, *columns)


def smooth(image: DataFrame, size: int, sigma: float, axes: Sequence[str] = ("y", "x"), column: str = "value") -> DataFrame:
    """Separable Gaussian smoothing with reflected borders."""
    w = gaussian_weights(size, sigma)
    for axis in axes:
        image = along(image, axis, [column], lambda v: sum((F.lit(w[k]) * (v(-k) + v(k)) for k in range(1, len(w))), F.lit(w[0]) * v(0)))
    return image


def derivative(image: DataFrame, size: int, sigma: float, axis: str, axes: Sequence[str] = ("y", "x"), column: str = "value") -> DataFrame:
    """First derivative of a Gaussian along one axis, smoothing along the others; pairs are subtracted first, so a constant gives exactly 0."""
    w = gaussian_weights(size, sigma)
    for other in axes:
        if other == axis:
            image = along(image, other, [column], lambda v: sum((F.lit(k / sigma**2 * w[k]) * (v(k) - v(-k)) for k in range(1, len(w))), F.lit(0.0)))
        else:
            image = along(image, other, [column], lambda v: sum((F.lit(w[k]) * (v(-k) + v(k)) for k in range(1, len(w))), F.lit(w[0]) * v(0)))
    return image


def _pass(df: DataFrame, axis: str, plan: dict[str, tuple[str, Callable]]) -> DataFrame:
    """New columns along an axis, each from one column by a combination of its neighbours; one shuffle for all of them."""
    rest = [c for c in VOXEL if c != axis]
    lines = df.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(axis, *[c for c in df.columns if c not in VOXEL]))).alias("line")).withColumn("n", F.size("line"))

    def one(item: Column, i: Column) -> Column:
        value = lambda c: (lambda k: F.get("line", _reflect(i + k, F.col("n")))[c])
        return F.struct(item[axis].alias(axis), *[f(value(c)).alias(name) for name, (c, f) in plan.items()])

    return lines.select(*rest, F.explode(F.transform("line", one)).alias("o")).select(*rest, "o.*")


def _pair(size: int, sigma: float) -> tuple[Callable, Callable]:
    """Smoothing and first derivative at sigma / sqrt 2."""
    half = sigma / 2**0.5
    w = gaussian_weights(size, half)
    soft = lambda v: sum((F.lit(w[k]) * (v(-k) + v(k)) for k in range(1, len(w))), F.lit(w[0]) * v(0))
    steep = lambda v: sum((F.lit(k / half**2 * w[k]) * (v(k) - v(-k)) for k in range(1, len(w))), F.lit(0.0))
    return soft, steep


def hessian_2d(image: DataFrame, size: int, sigma: float) -> DataFrame:
    """Second derivatives hyy, hxy, hxx by first derivatives twice at sigma / sqrt 2, scaled by sigma squared."""
    soft, steep = _pair(size, sigma)
    # Four passes give all three: (y, x) for the first derivatives, then (y, x) again.
    df = _pass(image.select(*VOXEL, F.col("value").cast("double").alias("v")), "y", {"s": ("v", soft), "d": ("v", steep)})
    df = _pass(df, "x", {"iy": ("d", soft), "ix": ("s", steep)})
    df = _pass(df, "y", {"yy": ("iy", steep), "ys": ("iy", soft), "xs": ("ix", soft)})
    df = _pass(df, "x", {"hyy": ("yy", soft), "hxy": ("ys", steep), "hxx": ("xs", steep)})
    s2 = F.lit(float(sigma) ** 2)
    return df.select(*VOXEL, *[(F.col(c) * s2).alias(c) for c in ("hyy", "hxy", "hxx")])


def _stencil(work: np.ndarray, axis: int, first: int, n: int, weights: Sequence[float], steep: bool) -> np.ndarray:
    """Weighted sums along an axis of a tile whose voxels are first, first + 1, ... of n in the image; mirrored at the image's borders, meaningless near other ends of the tile."""
    at = np.arange(work.shape[axis]) + first

    def value(k: int) -> np.ndarray:
        j = np.abs(at + k)
        j = np.clip(np.where(j >= n, 2 * (n - 1) - j, j), 0, n - 1)
        return np.take(work, np.clip(j - first, 0, len(at) - 1), axis)

    out = np.zeros(work.shape) if steep else weights[0] * work
    for k in range(1, len(weights)):
        out += weights[k] * (value(k) - value(-k) if steep else value(-k) + value(k))
    return out


def _tile_hessian(size: int, sigma: float, z_factor: float, edge: Sequence[int], fill: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    scale = [sigma * z_factor, sigma, sigma]
    weights = {}
    for axis, s in enumerate(scale):
        half = s / 2**0.5
        w = gaussian_weights(size, half)
        weights[axis, False], weights[axis, True] = w, [k / half**2 * v for k, v in enumerate(w)]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind = {f.name: f.type for f in rows.schema}
        schema = pa.schema([(c, kind[c]) for c in VOXEL] + [(f"h{c}", pa.float64()) for c in _SECOND])
        mark = rows.filter(pc.is_valid(rows["z0"]))
        if not mark.num_rows:
            # Only the border of a tile beyond the image.
            return schema.empty_table()
        rows = rows.filter(pc.is_null(rows["z0"]))
        low, high = ([mark[f"{c}{i}"][0].as_py() for c in "zyx"] for i in (0, 1))
        corner = [k.as_py() * n for k, n in zip(key[1:], edge)]
        # What lies in the image, first of the tile with its border and then of the tile itself.
        reach = 2 * (size // 2)
        first = [max(c - reach, v) for c, v in zip(corner, low)]
        last = [min(c + n - 1 + reach, v) for c, n, v in zip(corner, edge, high)]
        own = tuple(slice(max(c, v) - f, min(c + n - 1, w) - f + 1) for c, n, v, w, f in zip(corner, edge, low, high, first))
        place = tuple(rows[c].to_numpy() - f for c, f in zip("zyx", first))
        value = np.full([b - a + 1 for a, b in zip(first, last)], 0.0 if fill is None else fill)
        value[place] = rows["value"].to_numpy()
        along = lambda work, axis, steep: _stencil(work, axis, first[axis] - low[axis], high[axis] - low[axis] + 1, weights[axis, steep], steep)
        soft = [along(value, 0, False), along(value, 0, True)]
        once = [along(soft[1], 1, False), along(soft[0], 1, True), along(soft[0], 1, False)]
        once = [along(v, 2, i == 2) for i, v in enumerate(once)]
        second = []
        for a, b in _SECOND:
            work = once["zyx".index(b)]
            for axis, c in enumerate("zyx"):
                work = along(work, axis, c == a)
            second.append(work * (scale["zyx".index(a)] * scale["zyx".index(b)]))
        if fill is None:
            there = np.zeros(value.shape, bool)
            there[place] = True
        else:
            there = np.ones(value.shape, bool)
        at = np.nonzero(there[own])
        missing = rows["value"].null_count > 0
        columns = [pa.array(np.full(len(at[0]), key[0].as_py()), kind["t"]), *(pa.array(a + s.start + f, kind[c]) for a, s, f, c in zip(at, own, first, "zyx"))]
        return pa.table([*columns, *(pa.array(h[own][at], from_pandas=missing) for h in second)], schema=schema)

    return run


def hessian_3d(image: DataFrame, size: int, sigma: float, z_factor: float = 1.0, fill: float | None = None) -> DataFrame:
    """Second derivatives hzz, hzy, hzx, hyy, hyx, hxx; the scale along z is sigma * z_factor.

    All six are made in one shuffle, in tiles with a border as wide as the two derivatives reach.  fill: the value of voxels that image lacks in the box around
    a frame, which then have rows too; without it the image is taken to be dense, and a voxel that it lacks counts as 0 for its neighbours.
    """
    edge, reach = [max(_EDGE, 4 * (size // 2))] * 3, [2 * (size // 2)] * 3
    image = image.select(*VOXEL, F.col("value").cast("double").alias("value"))
    box = image.groupBy("t").agg(*[f(c).alias(f"{c}{i}") for c in "zyx" for i, f in enumerate((F.min, F.max))])
    ends = [f"{c}{i}" for c in "zyx" for i in (0, 1)]
    tiles = box
    for c, n in zip("zyx", edge, strict=True):
        tiles = tiles.withColumn(f"t{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / n), F.floor(F.col(f"{c}1") / n))))
    # A row without a voxel tells each tile the frame's box.
    kind = {f.name: f.dataType for f in image.schema}
    marks = tiles.select("t", *[F.lit(None).cast(kind[c]).alias(c) for c in (*"zyx", "value")], *TILE[1:], *ends)
    rows = spread(image, edge, reach).select(*VOXEL, "value", *TILE[1:], *[F.lit(None).cast(tiles.schema[c].dataType).alias(c) for c in ends])
    schema = StructType([*(StructField(c, kind[c]) for c in VOXEL), *(StructField(f"h{c}", DoubleType()) for c in _SECOND)])
    return rows.union(marks).groupBy(*TILE).applyInArrow(_tile_hessian(size, sigma, z_factor, edge, fill), schema)


def _curvatures(h: DataFrame) -> DataFrame:
    """Eigenvalues e0 >= e1 >= e2 of the negated Hessian, so that bright structures count as positive.

    The formula of functions.scalars.eigenvalues_3x3, with a column for each intermediate value: as one expression it would be repeated too often.
    """
    names = ("xx", "yy", "zz", "yx", "zx", "zy")
    largest = F.greatest(*[F.abs(f"h{c}") for c in names])
    df = h.withColumn("scale", F.when(largest > 0, largest).otherwise(F.lit(1.0)))
    df = df.select(*VOXEL, "scale", *[(-F.col(f"h{c}") / F.col("scale")).alias(c) for c in names])
    df = df.withColumn("q", (F.col("xx") + F.col("yy") + F.col("zz")) / 3)
    square = lambda c: F.col(c) * F.col(c)
    for c in ("xx", "yy", "zz"):
        df = df.withColumn(c, F.col(c) - F.col("q"))
    spread = F.sqrt((square("xx") + square("yy") + square("zz") + 2 * (square("yx") + square("zx") + square("zy"))) / 6)
    df = df.withColumn("p", spread)
    df = df.withColumn("det", F.col("xx") * (F.col("yy") * F.col("zz") - square("zy")) - F.col("yx") * (F.col("yx") * F.col("zz") - F.col("zy") * F.col("zx")) + F.col("zx") * (F.col("yx") * F.col("zy") - F.col("yy") * F.col("zx")))
    cosine = F.coalesce(F.try_divide(F.col("det"), 2 * F.pow("p", 3)), F.lit(0.0))
    df = df.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / 3)
    df = df.withColumns({"high": F.col("q") + 2 * F.col("p") * F.cos("phi"), "low": F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + F.lit(2.0) * F.pi() / 3)})
    middle = 3 * F.col("q") - F.col("high") - F.col("low")
    return df.select(*VOXEL, (F.col("high") * F.col("scale")).alias("e0"), (middle * F.col("scale")).alias("e1"), (F.col("low") * F.col("scale")).alias("e2"))


def response_3d(image: DataFrame, size: int, sigmas: Sequence[float], mode: str = "combined", z_factor: float = 1.0, alpha: float = 0.5, beta: float = 0.5, gamma: float = 2.0, fill: float | None = None) -> DataFrame:
    """Response of a volume to bright lines (vesselness), bright sheets (sheetness) or the greater of both, over the scales.  fill: see hessian_3d."""
    out = None
    for sigma in sigmas:
        e = _curvatures(hessian_3d(image, size, sigma, z_factor, fill))
        one = e.select(*VOXEL, sort_by_magnitude([F.col("e0"), F.col("e1"), F.col("e2")]).alias("e")).select(*VOXEL, *[F.col("e")[i].alias(f"l{i}") for i in range(3)])
        one = one.select(*VOXEL, line_and_sheet(F.col("l0"), F.col("l1"), F.col("l2"), mode, alpha, beta, gamma).alias("response"))
        out = one if out is None else out.union(one)
    if len(sigmas) == 1:
        return out.select(*VOXEL, F.greatest(F.lit(0.0), "response").alias("response"))
    return out.groupBy(*VOXEL).agg(F.greatest(F.lit(0.0), F.max("response")).alias("response"))


def vesselness(image: DataFrame, size: int, sigmas: Sequence[float], beta: float = 0.5, gamma: float = 2.0) -> DataFrame:
    """Response to bright lines of a plane image, the greatest over the scales and 0."""
    out = None
    for sigma in sigmas:
        high, low = eigenvalues_2x2(F.col("hyy"), F.col("hxy"), F.col("hxx"))
        one = hessian_2d(image, size, sigma).select(*VOXEL, high.alias("e0"), low.alias("e1"))
        swap = F.abs("e0") > F.abs("e1")
        one = one.select(*VOXEL, vesselness_2d(F.when(swap, F.col("e1")).otherwise(F.col("e0")), F.when(swap, F.col("e0")).otherwise(F.col("e1")), beta, F.lit(float(gamma))).alias("response"))
        out = one if out is None else out.union(one)
    return out.groupBy(*VOXEL).agg(F.greatest(F.lit(0.0), F.max("response")).alias("response"))


def _gathered(rows: DataFrame, axis: str, half: int, value: str) -> DataFrame:
    """value of each voxel and of those up to half a square away along an axis as an array; beyond the frame's border its last voxel counts again."""
    line = W.partitionBy(*[c for c in VOXEL if c != axis]).orderBy(axis)
    low, high = F.first(F.struct(axis, value)).over(line), F.last(F.struct(axis, value)).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumns({"_near": F.collect_list(value).over(line.rangeBetween(-half, half)), "_low": low, "_high": high})
    again = lambda end, edge, over: F.when(F.col(f"{end}.{axis}") == F.col(edge), F.array_repeat(F.col(f"{end}.{value}"), F.greatest(over, F.lit(0)).cast("int"))).otherwise(F.array().cast(rows.schema["_near"].dataType))
    before, after = again("_low", f"{axis}0", F.lit(half) - (F.col(axis) - F.col(f"{axis}0"))), again("_high", f"{axis}1", F.lit(half) - (F.col(f"{axis}1") - F.col(axis)))
    return rows.withColumn(value, F.concat("_near", before, after)).drop("_near", "_low", "_high")


def median_filter(image: DataFrame, size: int) -> DataFrame:
    """Median over a square of odd size in the plane; the border repeats.

    Values are gathered along x, then those arrays along y, so a voxel is shuffled twice and not once for each place of the square.
    """
    half = size // 2
    frame = image.groupBy("t", "z").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    rows = image.select(*VOXEL, "value").join(F.broadcast(frame), ["t", "z"])
    square = _gathered(_gathered(rows, "x", half, "value"), "y", half, "value")
    return square.select(*VOXEL, F.sort_array(F.flatten("value"))[size * size // 2].alias("value"))


def background_subtract(image: DataFrame, size: int, sigma: float, alpha: float) -> DataFrame:
    """value - alpha * smoothed value."""
    soft = smooth(image.select(*VOXEL, F.col("value").cast("double").alias("value")), size, sigma).withColumnRenamed("value", "soft")
    return image.join(soft, VOXEL).select(*VOXEL, (F.col("value") - F.lit(float(alpha)) * F.col("soft")).alias("value"))


def upsample(image: DataFrame, factor: int) -> DataFrame:
    """Bilinear enlargement of the plane with half-pixel centres and clamped edges."""
    for axis in ("y", "x"):
        rest = [c for c in VOXEL if c != axis]
        lines = image.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(axis, "value"))).alias("line")).withColumn("n", F.size("line"))

        def one(i: Column) -> Column:
            place = F.greatest(F.lit(0.0), F.least((i + 0.5) / factor - 0.5, F.col("n") - F.lit(1.0)))  # noqa: B023
            low = F.floor(place).cast("int")
            high = F.least(low + 1, F.col("n") - 1)
            a, b = (F.get("line", k)["value"].cast("double") for k in (low, high))
            return F.struct(i.cast("int").alias(axis), (a + (b - a) * (place - low)).alias("value"))  # noqa: B023

        image = lines.select(*rest, F.explode(F.transform(F.sequence(F.lit(0), F.col("n") * factor - 1), one)).alias("o")).select(*rest, "o.*")
    return image.select(*VOXEL, "value")
