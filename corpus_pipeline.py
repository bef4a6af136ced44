"""Five stages from raw documents to a sharded training set; each stage's rows are the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import decontaminate, minhash, mixture, quality, sharding
from voxelspark.llm.graph import cut
from voxelspark.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, domain_of

#: Percent of all tokens that the mixture draws at most; capacities by domain, language and source bound it further.
PERCENT = 100


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.  Rows with a null id or text are judged as any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where("quality = 1").select("doc_id"))
    return quality.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id; null ids and texts without words stay."""
    out = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null ids and texts stay."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture draws, as often as it draws them.

    Null texts have no tokens and are drawn with the prefix that they fall into; null levels count as empty.  Rows that repeat an id are told
    apart by their tokens and levels; rows equal in these are drawn alike, as often as the one drawn most.  An empty table stays empty, and columns may have any name.
    """
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    keys = ["doc_id", *levels, "tokens"]
    drawn = mixture.mix_sources(docs, levels, MIX_WEIGHTS, PERCENT, MIX_EPOCHS, MIX_SEED).where("copies > 0").groupBy(*keys).agg(F.max("copies").alias("copies"))
    drawn = drawn.select(F.struct(*keys).alias("_drawn_key"), F.col("copies").alias("_drawn_copies"))
    own = F.struct(F.col("doc_id").cast("long"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()], mixture.n_words(F.col("text").cast("string")).alias("tokens"))
    # The whole row is one column meanwhile, so that none of its columns can have the name of another.
    rows = docs.select(F.struct("*").alias("row"), own.alias("key")).join(drawn, F.col("key").eqNullSafe(F.col("_drawn_key")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), "_drawn_copies"))).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, checksum, shard and slot of each row; null texts have size 1, null ids share a shard, repeated rows are kept, an empty table stays empty."""
    return sharding.rendezvous_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The first two stages can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
