"""Tables and statistics of measured objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import running

#: The order of exported columns.
COLUMNS = ("label", "frame", "object_label", "branch_index", "branch_length", "pixels", "voxels", "perimeter", "area", "surface_area", "volume", "branch_number", "junction_number", "endpoint_number", "total_branch_length", "mean_branch_length", "length source")
#: Headers of exported columns.
HEADERS = {
    "label": "object label", "object_label": "object label", "frame": "frame", "branch_index": "branch", "pixels": "pixels (count)", "voxels": "voxels (count)",
    "branch_number": "branch number", "junction_number": "junction number", "endpoint_number": "endpoint number", "length source": "length source",
    "branch_length": "branch length ({unit})", "perimeter": "perimeter ({unit})", "area": "area ({unit}^2)", "surface_area": "surface area ({unit}^2)", "volume": "volume ({unit}^3)",
    "total_branch_length": "total branch length ({unit})", "mean_branch_length": "mean branch length ({unit})",
}


def at_least(objects: DataFrame, size: int) -> DataFrame:
    """Objects of a size or more; 0 or less keeps all."""
    return objects.where(F.col("area") >= size) if size > 0 else objects


def gini(rows: DataFrame, column: str) -> DataFrame:
    """Count of finite positive values and their Gini coefficient, clamped to [0, 1]; from counts of equal values, in range partitions.

    With values in order, 2 * sum(rank * value) / (n * total) - (n + 1) / n; equal values share the sum of their ranks.
    """
    kept = rows.where((F.col(column) > 0) & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranked = running(kept, ["v"], {"below": "c"}).select("v", "c", (F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2).alias("ranks"))
    sums = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("ranks") * F.col("v")).alias("w"), F.sum(F.col("c") * F.col("v")).alias("s"))
    n = F.col("n").cast("double")
    return sums.select("n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * F.col("w"), n * F.col("s")) - F.try_divide(n + 1, n))).alias("gini"))


def lorenz(rows: DataFrame, column: str) -> DataFrame:
    """share_of_rows, share_of_sum: the finite positive values in order, from (0, 0) to (1, 1); equal values make one point, the last of theirs.

    Sums run over range partitions of the values.
    """
    kept = rows.where((F.col(column) > 0) & ~F.isnan(F.col(column).cast("double")) & (F.col(column).cast("double") != float("inf"))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    summed = running(kept.withColumn("s", F.col("v") * F.col("c")), ["v"], {"n0": "c", "s0": "s"})
    whole = summed.agg(F.sum("c").alias("n"), F.sum("s").alias("total")).where("n > 0")
    points = summed.join(F.broadcast(whole)).select(((F.col("n0") + F.col("c")) / F.col("n")).alias("share_of_rows"), ((F.col("s0") + F.col("s")) / F.col("total")).alias("share_of_sum"))
    return points.union(whole.select(F.lit(0.0).alias("share_of_rows"), F.lit(0.0).alias("share_of_sum")))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts in 5 to 20 equal bins by the number of values, the last one closed."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.least(F.lit(20), F.greatest(F.lit(5), F.count("*"))).alias("bins"))
    place = F.coalesce(F.floor(F.try_divide((F.col(column) - F.col("low")) * F.col("bins"), (F.col("high") - F.col("low")).cast("double"))), F.lit(0))
    return rows.join(F.broadcast(ends)).groupBy(F.least(F.col("bins") - 1, place).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def principal_axis(labels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Length of the main axis of plane objects: four times the root of the larger eigenvalue of the coordinates' covariance."""
    y, x = F.col("y") * F.lit(float(spacing[1])), F.col("x") * F.lit(float(spacing[2]))
    rows = labels.groupBy("t", "label").agg(F.var_pop(y).alias("a"), F.covar_pop(y, x).alias("b"), F.var_pop(x).alias("d"))
    most = (F.col("a") + F.col("d")) / 2 + F.sqrt(F.pow((F.col("a") - F.col("d")) / 2, 2) + F.col("b") * F.col("b"))
    return rows.select("t", "label", (4 * F.sqrt(F.greatest(most, F.lit(0.0)))).alias("major_axis_length"))


def shaped(rows: DataFrame, unit: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Columns in export order, further ones after them, hidden ones (_) dropped; headers with {unit} filled in, the usual ones if none are given."""
    order = [c for c in COLUMNS if c in rows.columns] + [c for c in rows.columns if c not in COLUMNS and not c.startswith("_")]
    headers = HEADERS if labels is None else labels
    return rows.select(*[F.col(f"`{c}`").alias(headers.get(c, c).replace("{unit}", unit)) for c in order])
