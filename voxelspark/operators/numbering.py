"""Consecutive numbers over a whole table without a window in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut


def running(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str]) -> DataFrame:
    """df with the sums of columns over all rows before each one in an order that tells rows apart: new name to column; range partitions as in numbered."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select("_part", *[F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}") for n in sums])
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "_part").withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}).drop("_part", *[f"_{n}" for n in sums])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """df with a column that counts its rows from start in the given order, which must tell rows apart.

    Rows are range-partitioned by the order; a partition's numbers begin after the rows of those before it, of which there is one count each.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before") + F.lit(start - 1)).drop("_part", "_before")
