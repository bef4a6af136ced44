"""Distributed connected components and linking of bucketed candidates.

Everything here is DataFrame code.  Nothing proportional to the data reaches the driver: only counts and checksums.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import arrow_rows, shared_folder, tidy

#: Ids that may be broadcast at once (8 bytes each, so at most some tens of MB in hash form); above it, joins shuffle.
BROADCAST_IDS = 500_000
#: Pairs for each id of a bucket up to which all pairs of different components are compared at once.
SPREAD = 500
#: Pairs up to which the likeliest ones are not compared first.
AT_ONCE = 20_000



def cut(df: DataFrame, batch: int = 256) -> DataFrame:
    """Materialise in the shared checkpoint folder and forget the lineage; survives lost executors.

    batch: rows of an Arrow batch meanwhile; batches of whole texts must stay small.  A skewed join may end in many more partitions than
    are needed to keep all cores busy; they are put together, so that a small table isn't left in thousands of files.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
    with arrow_rows(spark, batch), tidy(spark):
        return df.coalesce(most).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle and checkpoint files of steps that nothing refers to any more.

    It acts when the driver collects garbage, which a driver with little to do puts off while the disks of a long loop fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_ids(df: DataFrame, key: str, ids: DataFrame, name: str, n: int) -> DataFrame:
    """Rows of df whose key is one of n ids; the ids are broadcast only while n is small, else both sides shuffle."""
    ids = ids.select(F.col(name).alias(key))
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for each id in links(a, b): comp is the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): the edges shrink to stars around the smallest ids in a
    number of rounds that grows with the logarithm of the longest chain.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before or not state[0]:
            break
        before = state
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")).union(roots)


def merge(labels: DataFrame, links: DataFrame, join: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """labels (id, comp) after more links: only the components that these touch are worked on."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = cut(join(cut(between.where("a <> b").distinct())))
    old = labels.join(found.select(F.col("id").alias("comp"), F.col("comp").alias("better")), "comp", "left").select("id", F.coalesce("better", "comp").alias("comp"))
    return old.union(found.join(labels.select("id"), "id", "left_anti"))


def link_buckets(buckets: DataFrame, verify: Callable[[DataFrame, bool], DataFrame], traits: Callable[[DataFrame], DataFrame], possible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], sift: Callable[[DataFrame], DataFrame] | None = None, join: Callable[[DataFrame], DataFrame] = components, known: DataFrame | None = None, distance: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """Components under verified links between ids that share a bucket: (id, comp) of linked ids.

    buckets: (key, id).  verify: candidate pairs (a, b), and whether they have been sifted, to the linked ones among them, materialised.  sift: pairs with traits
    (a, b, ta, tb) to those (a, b) that may be linked.  traits: ids to (id, rank, traits) of those that
    can have a link among them at all; possible(x, y) tells from two structs of traits whether a pair may be linked.  join: the components
    (id, comp) of materialised links.  known: (id, rank, traits) of all ids, if they are at hand: then impossible pairs are left out from the first
    step on, and buckets of two are done with it.  distance(x, y) of two structs of traits: the less, the likelier a link; if given, it orders the last step.

    No bucket is expanded into all its pairs.  First each id is compared with one member of its bucket.  While the ids whose bucket
    holds several components would still make more than SPREAD pairs each, they are compared with the member of highest rank in
    the bucket's leading component, so that a large group around a typical member merges, for as long as that links anything.  At last
    every pair that shares a bucket, is still in different components and is possible gets compared, without any cap: pairs within a
    component can't change it.  With a distance, of many such pairs each id's nearest one is compared first, again and again, for as long as a tenth of
    these are links: so a group that grows into one component isn't compared pair by pair.
    """
    spark, shared = buckets.sparkSession, None
    if known is None:
        pick = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("hub")
        shared = cut(buckets.groupBy("key").agg(F.count("*").alias("n"), pick).where("n > 1").select("key", "hub"))
        buckets = cut(buckets.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "key").select("key", "id", "hub"))
        firsts = buckets.where("id <> hub")
    else:
        order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
        first = lambda c: F.first(c).over(order).alias(f"hub_{c}")
        rows = buckets.join(known, "id").select("key", "id", "traits", first("id"), first("traits"), F.row_number().over(order).alias("at"), F.lead("id", 1).over(order).alias("next"), F.lead("id", 2).over(order).alias("third"))
        may = (F.col("id") != F.col("hub_id")) & possible(lambda c: F.col(f"traits.{c}"), lambda c: F.col(f"hub_traits.{c}"))
        # Of a bucket of two, nothing is left to do when its pair has been compared.
        several = F.expr("at > 2 OR third IS NOT NULL OR (at = 2 AND next IS NOT NULL)").alias("several")
        buckets = cut(rows.select("key", "id", F.col("hub_id").alias("hub"), may.alias("may"), several).where("may or several"))
        firsts, buckets = buckets.where("may"), buckets.where("several")
    pairs = firsts.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    labels = cut(join(verify(pairs, False)))
    release(spark)
    mixed, linking = None, True
    while True:
        tagged = (buckets if mixed is None else mixed).select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        if mixed is not None:
            tagged = tagged.join(known, "id")
        several = tagged.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        early, mixed = mixed is None, cut(tagged.join(several, "key", "left_semi"))
        if early:
            known = cut(traits(cut(mixed.select("id").distinct())))
            mixed = cut(mixed.join(known, "id"))
        if not mixed.head(1):
            return labels
        each = mixed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(F.struct("rank", "id", "traits")).alias("best"))
        apart = mixed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        rows, many = apart.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).head()
        lead = each.groupBy("key").agg(F.max(F.struct("n", "comp", "best")).alias("top")).select("key", F.col("top.comp").alias("top"), F.col("top.best.id").alias("hub"), F.col("top.best.traits").alias("other"))
        mixed = mixed.join(lead, "key")
        if not linking or many <= SPREAD * rows:
            break
        may = possible(lambda c: F.col(f"traits.{c}"), lambda c: F.col(f"other.{c}"))
        pairs = mixed.where((F.col("comp") != F.col("top")) & may).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.col("traits").alias("ta"), F.col("other").alias("tb"))
        pairs = (sift(pairs) if sift else pairs.select("a", "b")).distinct()
        found = verify(pairs, sift is not None)
        linking = bool(found.head(1))
        if linking:
            labels = cut(merge(labels, found, join))
        release(spark)
    # A pair is made in the least bucket that it shares.
    keys = mixed.groupBy("id").agg(F.collect_list("key").alias("keys"))
    mixed = cut(mixed.drop("hub", "other").join(keys, "id"))
    del tagged, buckets, firsts, pairs, keys, shared
    release(spark)
    left = mixed.where("comp <> top").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("traits").alias("tx"), F.col("keys").alias("kx"))
    right = mixed.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), "top", F.col("traits").alias("ty"), F.col("keys").alias("ky"))
    may = possible(lambda c: F.col(f"tx.{c}"), lambda c: F.col(f"ty.{c}"))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("top")) | (F.col("x") < F.col("y"))) & may & (left["key"] == F.array_min(F.array_intersect("kx", "ky"))))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("tx").alias("ta"), F.col("ty").alias("tb"))
    if distance:
        far = distance(lambda c: F.col(f"ta.{c}"), lambda c: F.col(f"tb.{c}")).alias("far")
        pairs = cut(pairs.select("a", "b", far).distinct())
        release(spark)
        labels, pairs = _nearest_first(labels, pairs, verify, join)
    else:
        pairs = cut((sift(pairs) if sift else pairs.select("a", "b")).distinct())
    del mixed, left, right
    release(spark)
    found = verify(pairs, sift is not None)
    return cut(merge(labels, found, join)) if found.head(1) else labels


def _nearest_first(labels: DataFrame, pairs: DataFrame, verify: Callable[[DataFrame, bool], DataFrame], join: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """labels after each id's nearest of pairs(a, b, far) has been verified, again and again, and the pairs (a, b) that are still to be."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    while pairs.count() > AT_ONCE:
        least = [pairs.groupBy(F.col(c).alias("id")).agg(F.min(F.struct("far", "a", "b")).alias("pair")) for c in ("a", "b")]
        nearest = cut(least[0].union(least[1]).groupBy("id").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct())
        found = verify(nearest, False)
        labels = cut(merge(labels, found, join)) if found.head(1) else labels
        apart = pairs.join(nearest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        pairs = cut(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "far"))
        few = 10 * found.count() < nearest.count()
        del least, nearest, found, apart
        release(pairs.sparkSession)
        if few:
            break
    return labels, pairs.select("a", "b")
