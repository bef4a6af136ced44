"""Scalar functions on calibrated images as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of units in micrometres and of time units in seconds.
MICROMETRES = {"um": 1.0, "µm": 1.0, "μm": 1.0, "micron": 1.0, "microns": 1.0, "nm": 0.001, "mm": 1000.0, "cm": 10000.0, "inch": 25400.0, "in": 25400.0}
SECONDS = {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "ms": 0.001, "us": 1e-6, "µs": 1e-6, "ns": 1e-9, "min": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hour": 3600.0, "hours": 3600.0}


def r6(c: Column) -> Column:
    """Six decimals, halves up; the same in every engine, unlike round."""
    return F.floor(c * 1000000 + 0.5) / 1000000


def normalize_unit(unit: Column) -> Column:
    """Trimmed, lower-cased, with escaped micro signs resolved and both micro characters alike."""
    plain = F.regexp_replace(F.regexp_replace(unit, r"\\u00[bB]5", "µ"), r"\\u03[bB][cC]", "µ")
    return F.lower(F.trim(F.translate(plain, "μ", "µ")))


def _lookup(unit: Column, known: dict[str, float]) -> Column:
    return reduce(lambda out, kv: F.when(unit == kv[0], F.lit(kv[1])).otherwise(out), known.items(), F.lit(None).cast("double"))


def to_micrometres(size: Column, unit: Column) -> Column:
    """NULL for an unknown unit."""
    return size * _lookup(normalize_unit(unit), MICROMETRES)


def to_seconds(duration: Column, unit: Column) -> Column:
    return duration * _lookup(normalize_unit(unit), SECONDS)


def pixel_size(numerator: Column, denominator: Column, unit_code: Column) -> Column:
    """Micrometres per pixel from a rational resolution and unit code (2 inch, 3 centimetre); NULL if it isn't positive."""
    length = F.when(unit_code == 2, 25400.0).when(unit_code == 3, 10000.0)
    per_unit = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.when(per_unit > 0, F.try_divide(length, per_unit))


def frame_interval(finterval: Column, fps: Column, described: Column) -> Column:
    """Seconds between frames: the first positive of the interval, 1 / fps and the described interval."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(finterval), F.try_divide(F.lit(1.0), positive(fps)), positive(described))


def default_axes(rank: Column) -> Column:
    return F.when(rank == 2, "YX").when(rank == 3, "ZYX").when(rank == 4, "TZYX").when(rank == 5, "TCZYX")


def axis_tag(dims_out: Column, dims: Column, inferred: Column, rank: Column) -> Column:
    """The first tag that is given, upper-cased, else the default of the rank."""
    return F.upper(F.coalesce(dims_out, dims, inferred, default_axes(rank)))


def layer_dims(nt: Column, nz: Column) -> Column:
    """Axes of one channel after singleton T and Z are dropped."""
    return F.concat(F.when(nt > 1, "T").otherwise(""), F.when(nz > 1, "Z").otherwise(""), F.lit("YX"))


def measurement_unit(unit: Column, scale: Column) -> Column:
    """um unless a unit is declared; px where none is and the scale is the identity."""
    return F.when(unit.isNotNull(), normalize_unit(unit)).when(F.forall(scale, lambda s: s == 1.0), "px").otherwise("um")


def pad_scale(scale: Column, rank: int) -> Column:
    """Scale with leading ones up to the rank."""
    return F.concat(F.array_repeat(F.lit(1.0), F.greatest(F.lit(0), F.lit(rank) - F.size(scale))), scale)


def step_length(a: Sequence[Column], b: Sequence[Column], spacing: Sequence[float]) -> Column:
    """Euclidean distance of two points with spacing per axis."""
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow((q - p) * F.lit(float(s)), 2) for p, q, s in zip(a, b, spacing, strict=True)]))


def relative_change(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1)).cast("double")


def dice(overlap: Column, a: Column, b: Column) -> Column:
    """0 for two empty masks."""
    return F.coalesce(F.try_divide(2.0 * overlap, (a + b).cast("double")), F.lit(0.0))


def jaccard(overlap: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(overlap.cast("double"), (a + b - overlap).cast("double")), F.lit(0.0))


def fraction(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def gaussian_pdf(v: Column, mu: Column, sigma: Column) -> Column:
    return F.exp(-F.pow(v - mu, 2) / (2 * F.pow(sigma, 2))) / (sigma * F.sqrt(F.lit(2.0) * F.pi()))


def response_potential(response: Column, most: Column, beta: float) -> Column:
    """Potential of the foreground, beta * ln(response / most + 1e-15)."""
    return F.lit(beta) * F.log(response / most + F.lit(1e-15))


def eigenvalues_2x2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, d]], larger first."""
    mean, reach = (a + d) / 2, F.sqrt(F.pow((a - d) / 2, 2) + b * b)
    return mean + reach, mean - reach


def eigenvalues_3x3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric matrix in descending order, by the trigonometric formula on the matrix scaled to largest entry 1."""
    scale = F.greatest(*[F.abs(c) for c in (xx, yy, zz, xy, xz, yz)])
    safe = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    xx, yy, zz, xy, xz, yz = (c / safe for c in (xx, yy, zz, xy, xz, yz))
    q = (xx + yy + zz) / 3
    p = F.sqrt((F.pow(xx - q, 2) + F.pow(yy - q, 2) + F.pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    ps = F.when(p > 0, p).otherwise(F.lit(1.0))
    a, b, c, d, e, f = (xx - q) / ps, (yy - q) / ps, (zz - q) / ps, xy / ps, xz / ps, yz / ps
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + F.lit(2.0) * F.pi() / 3)
    return high * scale, (3 * q - high - low) * scale, low * scale


def sort_by_magnitude(values: Sequence[Column]) -> Column:
    """Array of the values by ascending magnitude, equal magnitudes in the given order."""
    items = F.array(*[F.struct(F.abs(v).alias("m"), F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])
    return F.transform(F.array_sort(items), lambda x: x["v"])


def vesselness_2d(l1: Column, l2: Column, beta: float, gamma: Column) -> Column:
    """Response of a bright line from eigenvalues by magnitude (|l1| <= |l2|); 0 where l2 isn't negative."""
    blob, structure = F.pow(F.try_divide(l1, l2), 2), l1 * l1 + l2 * l2
    out = F.exp(-blob / (2 * beta * beta)) * (1 - F.exp(-structure / (2 * gamma * gamma)))
    return F.when(l2 < 0, F.coalesce(out, F.lit(0.0))).otherwise(F.lit(0.0))


def line_and_sheet(l1: Column, l2: Column, l3: Column, mode: str, alpha: float, beta: float, gamma: float) -> Column:
    """Response from curvatures by ascending magnitude, positive for bright structures.

    A line has two strong curvatures and needs both positive; a sheet has one.  mode: vesselness, sheetness or combined.
    """
    if mode not in ("vesselness", "sheetness", "combined"):
        raise ValueError(f"unknown response mode {mode}")
    fall = lambda ratio, width: F.exp(-ratio * ratio / (2 * width * width))
    strength = 1 - F.exp(-(l1 * l1 + l2 * l2 + l3 * l3) / (2 * gamma * gamma))
    blob = F.try_divide(F.abs(l1), F.sqrt(F.greatest(l2 * l3, F.lit(0.0))))
    line = F.when((l2 > 0) & (l3 > 0), (1 - fall(F.try_divide(l2, l3), alpha)) * fall(blob, beta) * strength)
    sheet = F.when(l3 > 0, fall(F.try_divide(F.abs(l2), l3), alpha) * fall(F.try_divide(F.abs(l1), l3), beta) * strength)
    line, sheet = (F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in (line, sheet))
    return line if mode == "vesselness" else sheet if mode == "sheetness" else F.greatest(line, sheet)


def line_points(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distinct integer points on the line between two voxels, each coordinate rounded half to even."""
    n = F.greatest(*[F.abs(q - p) for p, q in zip(a, b, strict=True)])
    point = lambda i: F.struct(*[F.rint(p + (q - p) * i / F.greatest(n, F.lit(1))).cast("int").alias(f"c{k}") for k, (p, q) in enumerate(zip(a, b, strict=True))])
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), point))
