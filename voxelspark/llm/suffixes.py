"""Repeated passages by sparse suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .graph import cut
from .scratch import Scratch

#: Words of the shortest passage that is reported, of a minimiser's gram, and the grams in a window.
PASSAGE, GRAM, WINDOW = 50, 5, 16
#: Words on which suffixes are sorted: what a passage has left behind the first window's minimiser, at least.
PREFIX = PASSAGE - WINDOW + 1


def _slide(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over x[i:i + n] for each i, by doubling; n is a power of two."""
    step = 1
    while step < n:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _run_hash(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of values[i:i + n] for each i."""
    up, down = tokens.powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return tokens.mix((total[n:] - total[:-n]) * down[: len(total) - n])


def minimisers(w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word position within it, and sort key of the retained suffixes.

    A position is retained where its gram has the least hash of a window of grams of its text; ties are all retained.  Two
    texts that share a passage retain the same positions in it, but for the last window at each end.  Keys order suffixes by their first
    two words, each by its hash, then by a hash of the next 35.
    """
    h, n = w.hash, np.diff(w.first)
    if len(h) < PASSAGE:
        return (np.empty(0, np.int64),) * 3
    gram = _run_hash(h, GRAM)
    text = np.repeat(np.arange(len(n)), n)
    span = GRAM + WINDOW - 1
    least = _slide(gram, WINDOW, np.minimum)
    least[text[: len(least)] != text[span - 1 : span - 1 + len(least)]] = 0
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, WINDOW, np.maximum)[: len(gram)] == gram)
    chosen = chosen[chosen + PREFIX <= len(h)]
    chosen = chosen[text[chosen] == text[chosen + PREFIX - 1]]
    top = np.uint64(48)
    key = (h[chosen] >> top << top) | (h[chosen + 1] >> top << np.uint64(32)) | (_run_hash(h, PREFIX)[chosen] >> np.uint64(32))
    return text[chosen], chosen - w.first[text[chosen]], key.view(np.int64)


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to key, doc, pos."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for start, _, w in tokens.text_blocks(batch.column(1), 2 << 20):
            text, pos, key = minimisers(w)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[start + text]), pa.array(pos, pa.int32())], ["key", "doc", "pos"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, positions of suffixes to key, doc, pos: the windows of 50 words that begin at a suffix or up to 15 words left of it."""
    for batch in batches:
        ids, at = batch.column(0).to_numpy(), batch.column(2)
        for start, end, w in tokens.text_blocks(batch.column(1), 2 << 20):
            if len(w.hash) < PASSAGE:
                continue
            own = at.slice(start, end - start)
            pos = own.flatten().to_numpy()
            text = np.repeat(np.arange(end - start), own.value_lengths().to_numpy())
            open_ = np.zeros(len(w.hash) + 1, np.int32)
            inside = pos < np.diff(w.first)[text]
            text, pos = text[inside], pos[inside]
            np.add.at(open_, w.first[text] + np.maximum(pos - (WINDOW - 1), 0), 1)
            np.add.at(open_, w.first[text] + pos + 1, -1)
            begin = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
            of = np.searchsorted(w.first, begin, "right") - 1
            fits = begin + PASSAGE <= w.first[of + 1]
            begin, of = begin[fits], of[fits]
            key = _run_hash(w.hash, PASSAGE)[begin].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[start + of]), pa.array(begin - w.first[of], pa.int32())], ["key", "doc", "pos"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted key, doc, pos to the rows of runs of one key that hold two documents, and of the first and last run of the partition.

    other: the least other document of the run; edge: a first or last run, which may go on in another partition.
    """
    rows = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
    if not rows:
        return
    key, doc, pos = (np.concatenate([r[i] for r in rows]) for i in range(3))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    # Within a run documents ascend: the second document begins at the first change.
    change = np.append(np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] != doc[:-1])) + 1, len(key))
    second = change[np.searchsorted(change, begin)]
    several = second < begin + size
    edge = np.zeros(len(begin), bool)
    edge[[0, -1]] = True
    run = np.repeat(np.arange(len(begin)), size)
    take = np.flatnonzero((several | edge)[run])
    run = run[take]
    low, next_ = doc[begin], doc[np.minimum(second, len(doc) - 1)]
    other = np.where(doc[take] == low[run], next_[run], low[run])
    for i in range(0, len(take), 50_000):
        own = slice(i, i + 50_000)
        at = take[own]
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(doc[at]), pa.array(pos[at]), pa.array(other[own]), pa.array(edge[run[own]])], ["key", "doc", "pos", "other", "edge"])


def _repeated(rows: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """doc, pos, other of the rows (key, doc, pos) whose key another document has too, by sorting them and comparing neighbours.

    The order goes on with document and position, so that a run of many equal keys may span partitions.
    """
    ordered = rows.repartitionByRange(parts, "key", "doc", "pos").sortWithinPartitions("key", "doc", "pos")
    found = scratch.table(ordered.mapInArrow(_neighbours, "key long, doc long, pos int, other long, edge boolean"))
    # Two keys for each partition at most; of a run's parts, the least two documents are the least two of those that the parts name.
    named = found.where("edge").groupBy("key").agg(F.min("doc").alias("low"), F.min(F.greatest("doc", "other")).alias("next"), F.max("doc").alias("high"))
    least = found.where("edge").groupBy("key", "doc").agg(F.first("key").alias("_")).drop("_")
    next_ = least.join(F.broadcast(named.select("key", "low")), "key").where("doc > low").groupBy("key", "low").agg(F.min("doc").alias("next"))
    all_ = found.join(F.broadcast(next_), "key", "left")
    over = F.when(F.col("doc") == F.col("low"), F.col("next")).otherwise(F.col("low"))
    return all_.where("not edge or low is not null").select("doc", "pos", F.when(F.col("edge"), over).otherwise(F.col("other")).alias("other"))


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_id: passages of 50 words or more that another document has too.

    A-Z is lower-cased, words are runs other than blanks and told apart by 64-bit hashes.  Suffixes at minimiser positions are
    sorted by hashes of their first words and of the 35 words that follow, in range partitions that may split a run of equal keys, and neighbours are compared: only
    suffixes whose key another document has too go on; words themselves are not compared.  Any passage of 50 words has such a suffix among its first 16
    words.  These matches are extended to the left and right by the windows of 50 words around them, again sorted and compared
    with their neighbours.  Repeated windows that overlap or touch are one passage, so all words of all repeated passages are covered;
    other_id is the least document that has one of the windows.  No pairs of documents are made.

    A document without such a passage has no row.  Null, empty and short texts have none.  Rows with a null id are left out; rows that
    repeat an id are one document, whose matches are those of any of its texts.  Ids are cast to long.  A very long text is worked on as
    a block of its own.  Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id is not null and text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "key long, doc long, pos int"
    with Scratch(spark) as scratch:
        kept = scratch.table(texts.mapInArrow(_retain, kind), batch=1000)
        suffixes = scratch.table(_repeated(kept, parts, scratch).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("pos").alias("at")))
        spans = _repeated(scratch.table(texts.join(suffixes, "doc_id").select("doc_id", "text", "at").mapInArrow(_extend, kind), batch=500), parts, scratch)
        order = W.partitionBy("doc").orderBy("pos")
        new = F.coalesce((F.col("pos") > F.lag("pos").over(order) + PASSAGE).cast("int"), F.lit(1))
        spans = spans.groupBy("doc", "pos").agg(F.min("other").alias("other")).withColumn("new", new).withColumn("island", F.sum("new").over(order))
        spans = spans.groupBy(F.col("doc").alias("doc_id"), "island").agg(F.min("pos").alias("start_word"), (F.max("pos") + PASSAGE).alias("end_word"), F.min("other").alias("other_id"))
        return cut(spans.select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), "other_id"))
