"""Benchmark decontamination by containment MinHash over size partitions.  DataFrame functions only."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, keep_ids

SHINGLE = 5
#: A document is contaminated by an item when 100 * shared >= PERCENT * shingles of the item.
PERCENT = 75
#: Upper bounds of item sizes (distinct shingles) and the number of minimum hashes kept of an item in each partition.
PARTITIONS = ((16, 16), (128, 24), (None, 48))
#: Chance of missing an item at the threshold.
MISS = 1e-6
#: Rows of item sketches or shingles (16 and some 60 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def fewest_hits(hashes: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest of so many minimum hashes that must occur: with containment at the threshold fewer do with probability below miss."""
    p, tail = percent / 100, 0.0
    for hits in range(hashes + 1):
        tail += comb(hashes, hits) * p**hits * (1 - p) ** (hashes - hits)
        if tail >= miss:
            return max(1, hits)
    return hashes


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: Column, k: int, join: bool) -> Column:
    """All k-word shingles of an array of words: hashes, or strings where join is set."""
    n = F.size(words) - (k - 1)
    each = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, k)]) if join else F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])
    return F.when(n > 0, F.transform(F.slice(words, 1, F.greatest(n, F.lit(1))), each))


def _items(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """item_id, k, string, hash, n: the distinct shingles of each item; k is the words of a shingle, fewer for an item of fewer words."""
    words = items.select(F.col(id_column).cast("long").alias("item_id"), _words(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("words")).where("item_id is not null and size(words) > 0")
    rows = None
    for k in range(1, SHINGLE + 1):
        part = words.where(F.size("words") >= k) if k == SHINGLE else words.where(F.size("words") == k)
        part = part.select("item_id", F.lit(k).alias("k"), F.explode(F.arrays_zip(_shingles(F.col("words"), k, True).alias("s"), _shingles(F.col("words"), k, False).alias("h"))).alias("x"))
        part = part.select("item_id", "k", F.col("x.s").alias("string"), F.col("x.h").alias("hash"))
        rows = part if rows is None else rows.union(part)
    rows = rows.distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, shared, item_shingles: documents that hold 75 % or more of the distinct five-word shingles of an item.

    Texts are lower-cased; words are runs other than blanks.  Items are partitioned by size; of each, the minimum hashes that its
    partition asks for are looked up among all shingles of all documents (containment MinHash: the sketch of the small set is
    tested against the whole large set, so a short item is found in a document of any length).  Pairs with enough hits are
    verified by their distinct shingles as strings.  Items of one to four words are one shingle of their own length.

    Null, empty and blank texts and null ids match nothing.  Rows that repeat an id count as one document or item with all their
    shingles.  Other columns are not looked at.  Sketches are broadcast only while they are small, else both sides shuffle.
    """
    bench = cut(_items(items, item_column, item_text))
    most = F.lit(PARTITIONS[-1][1])
    for bound, hashes in reversed(PARTITIONS[:-1]):
        most = F.when(F.col("n") <= bound, F.lit(hashes)).otherwise(most)
    # The minimum hashes of an item: its hashes in order, in an array of at most the size of the item.
    sketch = bench.groupBy("item_id", "k", "n").agg(F.array_sort(F.collect_set("hash")).alias("all")).select("item_id", "k", "n", F.explode(F.slice("all", 1, most)).alias("hash"))
    sketch = cut(sketch)
    sizes = [r[0] for r in bench.select("k").distinct().collect()]
    small = sketch.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id is not null and text is not null")
    hint = lambda df, ok: F.broadcast(df) if ok else df

    def shingled(df: DataFrame, join: bool, name: str) -> DataFrame:
        words, rows = df.select("doc_id", _words(F.col("text")).alias("words")), None
        for k in sorted(sizes) or [SHINGLE]:
            part = words.select("doc_id", F.lit(k).alias("k"), F.explode(_shingles(F.col("words"), k, join)).alias(name))
            rows = part if rows is None else rows.union(part)
        return rows

    need = F.lit(fewest_hits(PARTITIONS[-1][1]))
    for bound, hashes in reversed(PARTITIONS[:-1]):
        need = F.when(F.col("n") <= bound, F.lit(fewest_hits(hashes))).otherwise(need)
    need = F.when(F.col("n") <= most, F.ceil(F.col("n") * PERCENT / 100)).otherwise(need)
    hits = shingled(texts, False, "hash").join(hint(sketch, small), ["k", "hash"]).groupBy("doc_id", "item_id", "n").agg(F.count_distinct("hash").alias("hits"))
    likely = cut(hits.where(F.col("hits") >= need).select("doc_id", "item_id"))
    some = keep_ids(texts, "doc_id", ids := cut(likely.select("doc_id").distinct()), "doc_id", ids.count())
    few = bench.count() <= BROADCAST_ROWS
    shared = shingled(some, True, "string").join(hint(bench.select("item_id", "k", "string", "n"), few), ["k", "string"]).join(likely, ["doc_id", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id", "n").agg(F.count_distinct("string").alias("shared"))
    return shared.where(100 * F.col("shared") >= PERCENT * F.col("n")).select("doc_id", "item_id", "shared", F.col("n").alias("item_shingles"))


ORACLE = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
bs AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS shared, any_value(n.n) AS item_shingles
FROM bs JOIN ds USING (k, s) JOIN n ON n.id = bs.id GROUP BY ds.id, bs.id HAVING 100 * count(*) >= 75 * any_value(n.n)
"""
