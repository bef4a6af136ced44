"""Registered queries of this package, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, contentsort, decontaminate, fuzzylines, minhash, mixing_lm, mixture, phrases, quality, sharding, suffixes, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 7 by rendezvous hashing of doc_id."""
    return sharding.rendezvous_shards(_table(spark, sf_dir, "documents"))


#: Rules of the query on pages: host, path, whether it blocks.
URL_RULES = (("com", "/en/", True), ("example.com", "/en/7", False), ("net", "/de/", False), ("example.net", "/de/8", True), ("org", "/es/", True))


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on page urls by rules and by path templates."""
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_fuzzylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of nearly equal lines of documents."""
    return fuzzylines.fuzzy_lines(_table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that occur in other documents too."""
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


#: Domains: sources by their number modulo 4; integer weights among siblings.
MIX_WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1, ("d0", "en"): 5, ("d0", "de"): 2, ("d1", "en"): 3, ("d0", "en", "src0"): 2}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 50, 2, 17


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number at the end of a source's name; d0 without one."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 4)


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn under token budgets for domain, language and source."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixture.mix_sources(_table(spark, sf_dir, "documents"), levels, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents, learnt from trusted positives and unlabelled texts."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_contentsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among documents."""
    return contentsort.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of documents under a context-mixing model."""
    return mixing_lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a smaller document has too."""
    return anchors.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_urlfilter": op2_urlfilter,
    "op3_minhash": op3_minhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_fuzzylines": op5_fuzzylines,
    "op6_suffixes": op6_suffixes,
    "op7_mixture": op7_mixture,
    "op8_quality": op8_quality,
    "op9_contentsort": op9_contentsort,
    "op10_mixing_lm": op10_mixing_lm,
    "op11_phrases": op11_phrases,
    "op12_anchors": op12_anchors,
}

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": sharding.oracle_sql(),
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_mixture": mixture.oracle_sql("'d' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER), 0) % 4)", MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED),
    "op9_contentsort": contentsort.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_anchors": anchors.ORACLE,
}
