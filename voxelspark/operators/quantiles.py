"""Exact quantiles by refined histograms, and the rescaling between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .masks import VOXEL


def quantiles(values: DataFrame, by: Sequence[str], shares: Sequence[float], column: str = "value", times: str | None = None, bins: int = 1024) -> DataFrame:
    """(by..., share, quantile): the least value of each group that at least that share of its values doesn't exceed.

    Each round counts a group's remaining values in equal bins and goes on with the values of the bin that holds the wanted rank, until they are all
    equal; a round leaves about one of `bins` values, nothing is sorted, and a group of any size adds up in partial counts.  Null and NaN values don't count; a
    group without others has no row.  A column `times` counts rows more than once.  The range of a group must fit the column's type.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie between 0 and 1")
    often = F.col(times) if times else F.lit(1)
    rows = values.select(*by, F.col(column).alias("v"), often.cast("long").alias("n")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    ends = rows.groupBy(*by).agg(F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = ends.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in sorted(set(shares))])))
    key = [*by, "share"]
    state = cut(ends.select(*key, F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("share"))).cast("long").alias("rank"), "low", "high"))
    found = state.where("low = high").select(*key, F.col("low").alias("quantile"))
    # A share of a group is told apart by its own rows, so that each narrows its own range.
    left = rows.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in sorted(set(shares))])))
    while state.where("low < high").head(1):
        open_ = state.where("low < high")
        width = F.col("high").cast("double") - F.col("low")
        place = F.least(F.floor((F.col("v").cast("double") - F.col("low")) / width * bins), F.lit(bins - 1)).cast("int")
        inside = left.join(open_, key).where("v BETWEEN low AND high").withColumn("bin", place)
        counts = inside.groupBy(*key, "rank", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # At most `bins` counts of a group and share.
        lists = counts.groupBy(*key, "rank").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("bins"))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(-1).alias("at"))
        # The first bin that reaches the rank stays.
        ahead = lambda a, b: F.when(a["before"] + b["n"] >= F.col("rank"), F.struct(a["before"].alias("before"), b["bin"].alias("at"))).otherwise(F.struct((a["before"] + b["n"]).alias("before"), F.lit(-1).alias("at")))
        first = F.aggregate("bins", start, lambda a, b: F.when(a["at"] >= 0, a).otherwise(ahead(a, b)))
        chosen = lists.withColumn("first", first).withColumn("own", F.filter("bins", lambda b: b["bin"] == F.col("first")["at"])[0])
        state = cut(chosen.select(*key, (F.col("rank") - F.col("first")["before"]).alias("rank"), F.col("own")["low"].alias("low"), F.col("own")["high"].alias("high")))
        found = found.union(state.where("low = high").select(*key, F.col("low").alias("quantile")))
        left = cut(left.join(state.where("low < high").select(*key, "low", "high"), key).where("v BETWEEN low AND high").select(*key, "v", "n"))
    return found


def rescale_between(voxels: DataFrame, by: Sequence[str], low: float, high: float) -> DataFrame:
    """Values mapped to 0..1 between two quantiles of each group, those beyond them to 0 and 1; 0 where both quantiles are equal.

    low and high are shares, such as 0.018 and 0.982.
    """
    if not 0 <= low <= high <= 1:
        raise ValueError("the lower share must not exceed the upper one")
    ends = quantiles(voxels, by, [low, high])
    pick = lambda s: F.max(F.when(F.col("share") == float(s), F.col("quantile").cast("double")))
    ends = ends.groupBy(*by).agg(pick(low).alias("_low"), pick(high).alias("_high"))
    value = F.coalesce(F.try_divide(F.col("value").cast("double") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return voxels.join(ends, list(by)).select(*VOXEL, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("value"))
