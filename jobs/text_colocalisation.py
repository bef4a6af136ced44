"""How two kinds of marks in texts lie to each other: overlap and proximity by text, like those of two channels by frame.

    python -m jobs.text_colocalisation DOCUMENTS OUT [--config FILE]

A text is a frame with one line, on which each word is a voxel; a channel has the words that hold its pattern.  The table OUT has a row for each document,
in partitions by language.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.scalars import fraction
from voxelspark.operators import proximity
from voxelspark.sources.derive import marked_both

from . import common

CONFIG = Path(__file__).with_suffix(".json")
LOG = logging.getLogger("jobs.text_colocalisation")
#: Columns of the summary that are 0 for a text without any mark.
SIZES = ["source_size", "target_size", "overlap_size", "union_size", "near_size"]
SHARES = ["manders_source", "manders_target", "dice", "jaccard", "source_fraction", "near_fraction"]


def colocalisation(documents: DataFrame, source: str, target: str, threshold: float) -> DataFrame:
    """doc_id, lang, sizes, overlap, Manders, Dice, Jaccard, and the source words within a distance (in words) of a target word.

    Null texts have no words; a null language is ``und``.  Rows that repeat an id are one text, whose words lie over each other.  Rows with a null id are left out.
    """
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("t"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # Words of a repeated id at one place count once.
    marks = proximity.near_in_rows(marked_both(rows, source, target), threshold)
    summary = proximity.overlap_of(marks, ["t"], [F.count_if(F.col("near") & F.col("s").isNotNull()).alias("near_size")])
    found = rows.groupBy("t").agg(F.min("lang").alias("lang")).join(summary, "t", "left")
    found = found.fillna(0, SIZES).withColumn("near_fraction", fraction(F.col("near_size"), F.col("source_size")))
    return found.fillna(0.0, SHARES).select(F.col("t").alias("doc_id"), *SIZES, *SHARES, "lang")


def run(spark: SparkSession, documents: str, out: str, config: Mapping[str, Any] | None = None) -> None:
    """Measure all documents and replace the table."""
    config = config or common.settings(CONFIG)
    wrote = Observation()
    texts = spark.read.parquet(documents).select("doc_id", "lang", "text")
    LOG.info("reading %d documents of %s", texts.count(), documents)
    rows = colocalisation(texts, config["source_pattern"], config["target_pattern"], config["threshold"])
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("source_size").alias("source"), F.sum("target_size").alias("target"), F.sum("near_size").alias("near")]
    rows.observe(wrote, *sums).hint("rebalance", "lang").write.partitionBy("lang").mode("overwrite").parquet(out)
    LOG.info(f"wrote {out}: %(rows)d documents with %(source)s source and %(target)s target words, %(near)s of them near", wrote.get)


if __name__ == "__main__":
    common.main(run, "text_colocalisation", ["documents", "out"], CONFIG)
