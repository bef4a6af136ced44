"""Training of the segmentation's mixtures on counted values.

Values of a class are rows (class, value, n), one for each distinct value, spread over the cluster; what the driver holds are the parts of the two mixtures, as rows
(class, k, pi, mu, sigma), and two counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered, running

Part = tuple[int, int, float, float, float]
#: The spread that all parts start with; fixed value.
START_SIGMA = 256.0


def class_sizes(counted: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and distinct values of each class that has any."""
    return {r[0]: (r[1], r[2]) for r in counted.groupBy("class").agg(F.sum("n"), F.count("*")).collect()}


def sample_sizes(n: Mapping[int, int], most: int | None = None, fore: int | None = None, back: int | None = None) -> dict[int, int]:
    """Draws of each class, 0 for all of its points.

    `most` bounds both classes together in proportion to their sizes, at least one each, and what one class can't take goes to the other;
    without it `fore` and `back` bound a class each.  A class with no more points than its bound takes part whole.
    """
    if not most:
        return {c: bound if bound and n[c] > bound else 0 for c, bound in ((0, back), (1, fore))}
    if n[0] + n[1] <= most:
        return {0: 0, 1: 0}
    own = min(n[1], max(1, round(most * n[1] / (n[0] + n[1])), most - n[0]))
    drawn = {1: own, 0: min(n[0], max(1, most - own))}
    return {c: k if k < n[c] else 0 for c, k in drawn.items()}


def draw(counted: DataFrame, draws: Mapping[int, int], seed: int = 0) -> DataFrame:
    """Values drawn with replacement, as counted values; a class without a number of draws, or 0, stays whole.

    Draw i of a class takes the point whose place in the order of values is a hash of seed, class and i, so draws depend neither on
    partitions nor on their order.  Draws and values meet in ranges of places of which none holds more than some 65,536 values or the 65,536th part of the class.
    """
    n = class_sizes(counted)
    wanted = {c: k for c, k in draws.items() if k and c in n}
    if not wanted:
        return counted
    spark = counted.sparkSession
    # Values of class 1 come after all points of class 0.
    first = {0: 0, 1: n.get(0, (0, 0))[0]}
    per_class = lambda of: F.when(F.col("class") == 0, F.lit(of(0))).otherwise(F.lit(of(1))).cast("long")
    width = per_class(lambda c: max(1 << 16, n.get(c, (0, 0))[0] >> 16))
    placed = running(counted.where(F.col("class").isin(list(wanted))), ["class", "value"], {"place": "n"}) if len(wanted) == 1 else running(counted, ["class", "value"], {"place": "n"})
    if len(wanted) == 2:
        placed = placed.withColumn("place", F.col("place") - per_class(first.get))
    ranges = F.sequence(F.floor(F.col("place") / width), F.floor((F.col("place") + F.col("n") - 1) / width))
    values = placed.select("class", F.explode(ranges).alias("range"), "place", F.lit(0).alias("kind"), "value")
    draws_of = None
    for c, k in wanted.items():
        hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{c}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
        one = spark.range(k).select(F.lit(c).alias("class"), (hashed % n[c][0]).alias("place"))
        draws_of = one if draws_of is None else draws_of.union(one)
    asked = draws_of.select("class", F.floor(F.col("place") / width).alias("range"), "place", F.lit(1).alias("kind"), F.lit(None).cast(counted.schema["value"].dataType).alias("value"))
    order = W.partitionBy("class", "range").orderBy("place", "kind").rowsBetween(W.unboundedPreceding, 0)
    taken = values.union(asked).withColumn("value", F.last("value", ignorenulls=True).over(order)).where("kind = 1")
    out = taken.groupBy("class", "value").agg(F.count("*").alias("n"))
    return out.union(counted.where(~F.col("class").isin(list(wanted))).select("class", "value", "n"))


def _nested(spark, rows: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Centres as one row of a few numbers for each class."""
    by = {c: [(k, m) for q, k, m in rows if q == c] for c in {r[0] for r in rows}}
    return spark.createDataFrame(sorted(by.items()), "class int, centres array<struct<k: int, mu: double>>")


def seeds(counted: DataFrame, parts: Mapping[int, int]) -> list[tuple[int, int, float]]:
    """(class, k, mu) to start from: distinct values at even steps of the order of a class's distinct values, at most as many as it has."""
    n = class_sizes(counted)
    places, before = {}, 0
    for c in sorted(n):
        d = n[c][1]
        k = min(parts.get(c, 0), d)
        places |= {before + (2 * i + 1) * d // (2 * k): (c, i) for i in range(k)}
        before += d
    if not places:
        return []
    found = numbered(counted.select("class", "value"), ["class", "value"], "place", 0).where(F.col("place").isin(list(places))).collect()
    return sorted((*places[r["place"]], float(r["value"])) for r in found)


def lloyd(counted: DataFrame, centres: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Centres moved to the mean of the values nearest to them, equally near ones counting for the smaller k; a centre without values stays."""
    near = F.array_min(F.transform("centres", lambda m: F.struct(F.abs(F.col("value") - m["mu"]).alias("far"), m["k"].alias("k"))))["k"]
    rows = counted.join(F.broadcast(_nested(counted.sparkSession, centres)), "class").select("class", near.alias("k"), "value", "n")
    mean = {(r[0], r[1]): r[2] for r in rows.groupBy("class", "k").agg(F.sum(F.col("n") * F.col("value")) / F.sum("n")).collect()}
    return [(c, k, mean.get((c, k), m)) for c, k, m in centres]


def start(counted: DataFrame, parts: Mapping[int, int], rounds: int = 300, tolerance: float = 1e-6) -> list[Part]:
    """Mixtures to start from: k-means of each class's values, equal weights and wide spreads.

    Rounds end when no centre moves by more than tolerance.  Where a class has fewer distinct values than parts, the rest repeat its last centre with weight 0.
    """
    centres = seeds(counted, parts)
    for _ in range(rounds):
        moved = lloyd(counted, centres)
        far = max((abs(a[2] - b[2]) for a, b in zip(moved, centres, strict=True)), default=0.0)
        centres = moved
        if far <= tolerance:
            break
    out = []
    for c, k in sorted(parts.items()):
        own = [m for q, _, m in centres if q == c]
        if not own:
            raise ValueError("a class has no values to start its mixture from")
        out += [(c, i, 1.0 / len(own) if i < len(own) else 0.0, own[min(i, len(own) - 1)], START_SIGMA) for i in range(k)]
    return out


def exchange(model: Sequence[Part], n: Mapping[int, int]) -> list[Part]:
    """Give the darkest foreground part and the brightest background part to each other's class where the former is darker; weights follow the sizes n of
    the classes and add up to one in each."""
    dark = min((p for p in model if p[0] == 1), key=lambda p: (p[3], p[1]))
    bright = min((p for p in model if p[0] == 0), key=lambda p: (-p[3], p[1]))
    if dark[3] >= bright[3]:
        return list(model)
    ratio = max(n.get(0, 0), 1) / max(n.get(1, 0), 1)
    new = {dark[:2]: (bright[2] * ratio, *bright[3:]), bright[:2]: (dark[2] / ratio, *dark[3:])}
    rows = [(*p[:2], *new.get(p[:2], p[2:])) for p in model]
    total = {c: sum(p[2] for p in rows if p[0] == c) or 1.0 for c in (0, 1)}
    return [(c, k, pi / total[c], mu, sigma) for c, k, pi, mu, sigma in rows]
