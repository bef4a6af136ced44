"""Histogram thresholds, mixture models and the Markov random field of the segmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import gaussian_pdf, response_potential
from .graph import cut
from .masks import VOXEL
from .quantiles import quantiles
from .training import Part, class_sizes, draw, exchange, sample_sizes, start

MODEL = "class int, k int, pi double, mu double, sigma double"


def otsu(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """threshold_bin, threshold (the bin's middle) and variance: the first bin that separates values from 0 to 255 with the greatest variance between classes.

    Bins divide the range from 0 to 255 evenly, the last one closed; values outside it don't count.
    """
    place = F.least(F.floor(F.col("value") * bins / 255.0), F.lit(bins - 1)).cast("int")
    counts = voxels.where(F.col("value").between(0, 255)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    # At most `bins` rows.
    low = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = counts.select("bin", F.sum("n").over(low).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(low).alias("s0"), F.sum("n").over(every).alias("n1"), F.sum(F.col("n") * F.col("bin")).over(every).alias("s1"))
    n0, n1 = F.col("n0").cast("double"), (F.col("n1") - F.col("n0")).cast("double")
    gap = F.col("s0") / n0 - (F.col("s1") - F.col("s0")) / n1
    rows = rows.where("n1 > n0").select("bin", (n0 * n1 * gap * gap).alias("variance"))
    return rows.orderBy(F.desc("variance"), "bin").limit(1).select(F.col("bin").alias("threshold_bin"), ((F.col("bin") + 0.5) * (255.0 / bins)).alias("threshold"), "variance")


def _densities(points: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct values of each class with their count n, the densities of the model's parts and their sum.  A column n of points counts its rows so often."""
    times = F.sum("n") if "n" in points.columns else F.count("*")
    counted = points.groupBy("class", "value").agg(times.alias("n")).join(F.broadcast(model.groupBy("class").agg(F.collect_list(F.struct("k", "pi", "mu", "sigma")).alias("parts"))), "class")
    value = F.col("value")
    dens = F.transform("parts", lambda m: m["pi"] * gaussian_pdf(value, m["mu"], m["sigma"]))
    return counted.withColumn("dens", dens).withColumn("total", F.aggregate("dens", F.lit(0.0), lambda a, b: a + b))


def log_likelihood(points: DataFrame, model: DataFrame) -> DataFrame:
    """Mean log density (log_likelihood) of all points under their class's mixture; densities below 1e-300 count as that."""
    rows = _densities(points, model)
    return rows.agg((F.sum(F.col("n") * F.log(F.greatest("total", F.lit(1e-300)))) / F.sum("n")).alias("log_likelihood"))


def _moments(points: DataFrame, model: DataFrame) -> DataFrame:
    """(class, k, w, s, q, l): sums of the responsibilities, of them times value and squared value, and in the first part's row the log density of the class."""
    # Equal values have equal parts, so each distinct value is taken once.
    counted = _densities(points, model)
    rows = counted.select("class", "value", "n", "total", F.posexplode("dens").alias("i", "d"), "parts").select("class", F.col("parts")[F.col("i")]["k"].alias("k"), "value", F.coalesce(F.try_divide(F.col("n") * F.col("d"), "total"), F.lit(0.0)).alias("r"), F.when(F.col("i") == 0, F.col("n") * F.log(F.greatest("total", F.lit(1e-300)))).otherwise(F.lit(0.0)).alias("l"))
    return rows.groupBy("class", "k").agg(F.sum("r").alias("w"), F.sum(F.col("r") * F.col("value")).alias("s"), F.sum(F.col("r") * F.col("value") * F.col("value")).alias("q"), F.sum("l").alias("l"))


def em_step(points: DataFrame, model: DataFrame) -> DataFrame:
    """One expectation and maximisation step of a mixture of normals per class.

    points: (class, value); model: (class, k, pi, mu, sigma), a few rows and broadcast.  The deviation is taken from the new mean, by the
    first two moments of the responsibilities.
    """
    sums = _moments(points, model)
    total = F.sum("w").over(W.partitionBy("class"))
    mu = F.try_divide("s", "w")
    return sums.select("class", "k", F.try_divide(F.col("w"), total).alias("pi"), mu.alias("mu"), F.sqrt(F.greatest(F.try_divide("q", "w") - mu * mu, F.lit(1e-12))).alias("sigma"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, value, n) to one row for each class of a batch, values and counts in a block of bytes each."""
    for batch in batches:
        of, value, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        own = np.unique(of)
        blocks = [[c[of == k].astype(kind).tobytes() for k in own] for c, kind in ((value, np.float64), (n, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(b, pa.binary()) for b in blocks)], ["class", "value", "n"])


def _block_moments(model: Sequence[Part]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of _moments over the blocks of a task, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for of, value, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [p for p in model if p[0] == of]
                if not parts:
                    continue
                value, n = np.frombuffer(value), np.frombuffer(n, np.int64)
                pi, mu, sigma = (np.array([[p[i]] for p in parts]) for i in (2, 3, 4))
                dens = pi * (np.exp(-((value - mu) ** 2) / (2 * sigma**2)) / (sigma * np.sqrt(2.0 * np.pi)))
                total = dens.sum(0)
                r = np.divide(n * dens, total, out=np.zeros_like(dens), where=total > 0)
                new = np.zeros((len(parts), 4))
                new[:, :3] = np.stack([r.sum(1), (r * value).sum(1), (r * value * value).sum(1)], 1)
                new[0, 3] = (n * np.log(np.maximum(total, 1e-300))).sum()
                sums[of] = sums.get(of, 0.0) + new
        rows = [(p[0], p[1], *v) for of, own in sums.items() for p, v in zip((p for p in model if p[0] == of), own.tolist(), strict=True)]
        if rows:
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["class", "k", *"wsql"])

    return run


def fit(points: DataFrame, model: Sequence[Part], steps: int = 30, tolerance: float = 1e-6) -> list[Part]:
    """Expectation and maximisation until the log-likelihood changes by less than that share of it, at the latest after `steps`.

    points: (class, value, n).  A step is one job without a shuffle over blocks of values, of which a few numbers for each task reach the driver; its sums also give the
    likelihood of the model before it.  A part or class without values keeps its place.
    """
    blocks = cut(points.where("class IS NOT NULL AND value IS NOT NULL").select("class", F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n")).mapInArrow(_packed, "class int, value binary, n binary"))
    before, model = None, list(model)
    for i in range(steps):
        found: dict[tuple[int, int], list[tuple[float, ...]]] = {}
        for r in blocks.mapInArrow(_block_moments(model), "class int, k int, w double, s double, q double, l double").collect():
            found.setdefault((r[0], r[1]), []).append(tuple(r[2:]))
        sums = {k: tuple(fsum(c) for c in zip(*v, strict=True)) for k, v in found.items()}
        likelihood = sum(r[3] for r in sums.values())
        # The start counts for no comparison.
        if i > 1 and abs(likelihood - before) < tolerance * abs(likelihood):
            return model
        before = likelihood
        weight = {c: sum(r[0] for (q, _), r in sums.items() if q == c) for c in (0, 1)}
        new = []
        for c, k, pi, mu, sigma in model:
            w, s, q, _ = sums.get((c, k), (0.0, 0.0, 0.0, 0.0))
            new.append((c, k, w / weight[c] if weight[c] else pi, *((s / w, max(q / w - (s / w) ** 2, 1e-12) ** 0.5) if w > 0 else (mu, sigma))))
        model = new
    return model


def smoothness(labels: DataFrame, beta: float, dxy: float = 1.0, dz: float = 1.0, axes: Sequence[str] = ("y", "x"), keep: Sequence[str] = ()) -> DataFrame:
    """Potential of class 0 from the neighbours on a dense grid, the sum of weight * (2 * label - 1); that of class 1 is its negative.

    keep: more columns of labels to hand on.  A neighbour outside counts as 0; along z the weight is beta * min(1, dxy / dz).
    """
    out = labels
    for axis in axes:
        weight = beta * (min(1.0, dxy / dz) if axis == "z" else 1.0)
        line = W.partitionBy(*[c for c in VOXEL if c != axis]).orderBy(axis)
        pair = sum((F.lit(weight) * (2 * F.coalesce(f("label").over(line), F.lit(0)) - 1) for f in (F.lag, F.lead)), F.lit(0.0))
        out = out.withColumn(f"p_{axis}", pair)
    return out.select(*VOXEL, *keep, "label", sum((F.col(f"p_{a}") for a in axes), F.lit(0.0)).alias("potential"))


def map_labels(voxels: DataFrame, model: DataFrame | Sequence[Part], beta2: float = 1.0, most: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """label 1 where the foreground's score is the greater: ln of the mixture minus the potential; and the score of the label taken.

    voxels: (t, z, y, x, value, response, potential of class 0); model as in em_step with class 0 and 1.  most: the greatest response, where it is known.  keep:
    more columns of voxels to hand on.
    """
    if isinstance(model, DataFrame):
        model = [tuple(r) for r in model.select("class", "k", "pi", "mu", "sigma").collect()]
    part = lambda p: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("pi", "mu", "sigma"), p[2:], strict=True)])
    # One row, so that the code which Spark makes for the voxels is the same in every round.
    parts = voxels.sparkSession.range(1).select(*[F.array(*[part(p) for p in model if p[0] == c]).cast("array<struct<pi: double, mu: double, sigma: double>>").alias(f"m{c}") for c in (0, 1)])
    rows = voxels.join(F.broadcast(parts))
    rows = rows.join(F.broadcast(voxels.agg(F.max("response").alias("most")))) if most is None else rows.withColumn("most", F.lit(float(most)))
    mix = lambda c: F.log(F.greatest(F.aggregate(F.transform(f"m{c}", lambda m: m["pi"] * gaussian_pdf(F.col("value"), m["mu"], m["sigma"])), F.lit(0.0), lambda a, b: a + b), F.lit(1e-15)))
    share = F.coalesce(F.try_divide("response", "most"), F.lit(0.0))
    # The potential of a class is that of the other one's evidence.
    score1 = mix(1) - F.lit(float(beta2)) * F.log(1 - share + F.lit(1e-15)) + F.col("potential")
    score0 = mix(0) - response_potential(share, F.lit(1.0), beta2) - F.col("potential")
    rows = rows.select(*VOXEL, *keep, score1.alias("score1"), score0.alias("score0"))
    return rows.select(*VOXEL, *keep, (F.col("score1") > F.col("score0")).cast("int").alias("label"), F.greatest("score1", "score0").alias("score"))


class Trained(NamedTuple):
    """Labels, the mixtures, the relative changes of the score from the second round on, and whether the last one was small enough."""

    labels: DataFrame
    model: list[Part]
    deltas: list[float]
    converged: bool


def train(image: DataFrame, response: DataFrame, foreground: int = 1, background: int = 1, beta1: float = 1.0, beta2: float = 1.0, outer: int = 50, inner: int = 30, axes: Sequence[str] = ("y", "x"), dxy: float = 1.0, dz: float = 1.0, tolerance: float = 1e-8, inner_tolerance: float = 1e-6, most: int | None = None, most_foreground: int | None = None, most_background: int | None = None, seed: int = 0, model: Sequence[Part] | None = None) -> Trained:
    """Two-class segmentation by a mixture per class, the response and a neighbourhood prior.

    Values are mapped to [0, 255] and split by Otsu's threshold, or above the lower median where a class would be empty.  The first round starts the mixtures from
    k-means, unless a model is given.  Each round fits them to the values of the present classes, exchanges crossed parts and takes the
    better class of every voxel.  Rounds end when the score of all voxels changes by less than that share of it, at the latest after `outer`.  Without `most...` all voxels
    are fitted, by their distinct values; with them a sample drawn with replacement, see training.draw.  Raises ValueError for an empty or constant image.
    """
    low, high, n = image.agg(F.min("value"), F.max("value"), F.count("*")).head()
    if not n:
        raise ValueError("the image must be nonempty")
    if low == high:
        raise ValueError("the image must not be constant")
    scaled = image.select(*VOXEL, ((F.col("value") - F.lit(low)) * 255.0 / F.lit(high - low)).alias("value"))
    rows = cut(scaled.join(response.select(*VOXEL, "response"), VOXEL))
    first = otsu(rows).head()["threshold"]
    greatest = rows.agg(F.max("response")).head()[0]
    # Value and response go along with the labels, so that no round has to join them.
    keep = ["value", "response"]
    state = rows.select(*VOXEL, *keep, (F.col("value") > first).cast("int").alias("label"))
    deltas, last = [], None
    counts = lambda: cut(state.groupBy(F.col("label").alias("class"), "value").agg(F.count("*").alias("n")))
    for i in range(outer):
        counted = counts()
        sizes = class_sizes(counted)
        if len(sizes) < 2:
            middle = quantiles(rows, [], [0.5]).head()["quantile"]
            state = rows.select(*VOXEL, *keep, (F.col("value") > middle).cast("int").alias("label"))
            counted = counts()
            sizes = class_sizes(counted)
            if len(sizes) < 2:
                raise ValueError("no value tells foreground from background")
        total = {c: k for c, (k, _) in sizes.items()}
        points = counted
        if most or most_foreground or most_background:
            points = cut(draw(counted, sample_sizes(total, most, most_foreground, most_background), seed + i))
        if model is None:
            model = start(points, {0: background, 1: foreground})
        model = exchange(fit(points, model, inner, inner_tolerance), total)
        new = cut(map_labels(smoothness(state, beta1, dxy, dz, axes, keep), model, beta2, greatest, keep))
        score = new.agg(F.sum("score")).head()[0]
        state = new.select(*VOXEL, *keep, "label")
        if last is not None:
            deltas.append(abs((score - last) / (score or 1e-15)))
            if deltas[-1] < tolerance:
                return Trained(state.select(*VOXEL, "label"), model, deltas, True)
        last = score
    return Trained(state.select(*VOXEL, "label"), model or [], deltas, False)


def segment(image: DataFrame, response: DataFrame, **settings: object) -> DataFrame:
    """The labels of train."""
    return train(image, response, **settings).labels
