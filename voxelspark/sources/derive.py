"""Voxel relations derived from the relational test tables, and the same relations as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static image: rows of embeddings, (t, z, y, x, value)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return rows.select(F.lit(0).alias("t"), F.lit(0).alias("z"), F.col("vec_id").cast("int").alias("y"), "x", F.floor(F.col("e").cast("double") * 1000000).cast("long").alias("value"))


def event_voxels(events: DataFrame) -> DataFrame:
    """Events by day, user and four-hour slot, (t, z, y, x, value, n)."""
    rows = events.select(
        F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("int").alias("t"), F.lit(0).alias("z"), F.col("user_id").cast("int").alias("y"),
        F.expr("CAST(hour(ts) div 4 AS INT)").alias("x"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"),
    )
    return rows.groupBy("t", "z", "y", "x").agg(F.sum("v").alias("value"), F.count("*").alias("n"))


def tyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse time series: all events as voxels."""
    return event_voxels(table(spark, sf_dir, "events"))


def marked_both(texts: DataFrame, source: str, target: str) -> DataFrame:
    """Words of texts (t, text) that hold a pattern, as voxels of a line for each text, from one reading: (t, z, y, x, s, g).

    x is the word's place; s and g are its bytes where it holds the pattern of source and target, the most at each place.
    """
    words = texts.select("t", F.posexplode(F.regexp_extract_all("text", F.lit("([^ \\t-\\r]+)"))).alias("x", "word"))
    value = lambda p: F.when(F.col("word").rlike(p), F.octet_length("word").cast("long"))
    marked = words.select("t", F.lit(0).alias("z"), F.lit(0).alias("y"), "x", value(source).alias("s"), value(target).alias("g")).where("s IS NOT NULL OR g IS NOT NULL")
    return marked.groupBy("t", "z", "y", "x").agg(F.max("s").alias("s"), F.max("g").alias("g"))


def zyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-channel volume: line items by month, supplier and quantity, (t, z, y, x, src, tgt)."""
    price = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("t"), F.month("l_shipdate").alias("z"), F.col("l_suppkey").cast("int").alias("y"), F.col("l_quantity").cast("int").alias("x"), F.col("l_returnflag").alias("flag"), price.alias("v"))
    of = lambda f: F.sum(F.when(F.col("flag") == f, F.col("v")).otherwise(0))
    return rows.groupBy("t", "z", "y", "x").agg(of("R").alias("src"), of("A").alias("tgt"))


def channel(volume: DataFrame, name: str) -> DataFrame:
    """One channel of a volume as foreground voxels."""
    return volume.where(F.col(name) > 0).select("t", "z", "y", "x", F.col(name).alias("value"))


YX = """yx AS (SELECT 0 AS t, 0 AS z, CAST(vec_id AS INTEGER) AS y, CAST(p - 1 AS INTEGER) AS x, CAST(floor(CAST(e AS DOUBLE) * 1000000) AS BIGINT) AS value
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
TYX = """tyx AS (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS t, 0 AS z, CAST(user_id AS INTEGER) AS y, CAST(hour(ts) // 4 AS INTEGER) AS x,
  CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS value, COUNT(*) AS n FROM events GROUP BY 1, 2, 3, 4)"""
ZYX = """zyx AS (SELECT 0 AS t, CAST(month(l_shipdate) AS INTEGER) AS z, CAST(l_suppkey AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS x,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS src,
  CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS tgt
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
SRC = "src_ AS (SELECT t, z, y, x, src AS value FROM zyx WHERE src > 0)"
TGT = "tgt_ AS (SELECT t, z, y, x, tgt AS value FROM zyx WHERE tgt > 0)"
