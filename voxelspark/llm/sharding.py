"""Weighted rendezvous sharding of stable record keys.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard are numbered within this many hash blocks; the counts of shards * BLOCKS pairs are the only table that is broadcast.
BLOCKS = 4096


def _digest(key: Column, digits: int, *more: Column) -> Column:
    """The first hexadecimal digits of md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat(key, *more)), 1, digits), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(u) / weight, u in (0, 1) from md5 of key and shard; ties go to the lower shard.

    A shard added at the end can only win keys for itself, in proportion to its weight.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.log((_digest(key, 13, F.lit(f":{i}")) + F.lit(0.5)) / F.lit(2.0**52)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def rendezvous_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of docs.

    The shard depends on the id and the weights alone; grown_shard is the shard once one more, of weight `added`, exists.  slot
    numbers the rows of a shard from 0 without gaps, by hash block, id, checksum and size.  No task gets a whole shard: rows are
    numbered within (shard, block) and moved by the running counts of the blocks before.

    A null text has size 1 and checksum 0, as an empty one.  A null id counts as an empty key.  Repeated rows get slots of their own in
    the same shard.  Other columns of docs are not looked at; an empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    block = _digest(key, 3) % BLOCKS
    ids = docs.select(F.col(id_column).alias("doc_id"))
    placed = lambda df: df.withColumns({"shard": shard_of(key, weights), "block": block})
    counts = placed(ids).groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = placed(docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    # At most len(weights) * BLOCKS rows, whatever the input.
    rows = rows.join(F.broadcast(before), ["shard", "block"])
    number = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + number - 1).alias("slot"), shard_of(key, [*weights, added]).alias("grown_shard"))


_DIGEST = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"


def oracle_sql(shards: int = 8) -> str:
    """DuckDB SQL of rendezvous_shards with equal weights; CRC-32 is computed from its rule, byte by byte."""
    best = lambda n: f"(SELECT arg_min(i, -ln((CAST('0x' || substr(md5(k || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) FROM range({n}) r(i))"
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    rule = "SELECT 0 AS round, i AS byte, CAST(i AS BIGINT) AS v FROM range(256) r(i) UNION ALL SELECT round + 1, byte, " + step.format("v") + " FROM crc WHERE round < 8"
    return f"""
WITH RECURSIVE crc AS ({rule}),
lookup AS (SELECT list(v ORDER BY byte) AS t FROM crc WHERE round = 8),
rows_ AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
keyed AS (
  SELECT doc_id, k, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
              lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32
  FROM rows_, lookup),
placed AS (SELECT *, CAST({best(shards)} AS INTEGER) AS shard, CAST({best(shards + 1)} AS INTEGER) AS grown_shard, {_DIGEST.format("k", 3)} AS block FROM keyed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM placed
"""
