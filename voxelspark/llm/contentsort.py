"""Exact deduplication by sorting contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .graph import cut

#: Bytes of the text in the range key; the digest and the id after it place texts that share them.
PREFIX = 32
FLUSH = 8192


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to doc_id, lower-cased bytes, their SHA-256."""
    for batch in batches:
        raw, at = tokens.buffers(batch.column(1))
        low = tokens._LOWER[raw].tobytes()
        view = memoryview(low)
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        norm = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(low)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), norm, pa.array(digests, pa.binary())], ["doc_id", "norm", "sha"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted doc_id, norm, sha to doc_id, sha, and the size and largest id of the run of equal neighbours.

    edge: the run touches an end of the partition, so that it may go on in another; head: the first row of its run.
    """
    names = ["doc_id", "sha", "n", "last", "edge", "head"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    out: list[list] = [[] for _ in names]
    ids: list[int | None] = []
    previous: bytes | None = None
    digest, runs = b"", 0

    def close(edge: bool) -> None:
        n, last = len(ids), max((i for i in ids if i is not None), default=None)
        for column, values in zip(out, (ids, [digest] * n, [n] * n, [last] * n, [edge] * n, [True] + [False] * (n - 1)), strict=True):
            column.extend(values)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        own, (raw, at) = batch.column(0).to_pylist(), tokens.buffers(batch.column(1))
        view, shas, at = memoryview(raw.tobytes()), batch.column(2), at.tolist()
        for i, doc in enumerate(own):
            text = view[at[i] : at[i + 1]]
            if previous is None or len(text) != len(previous) or text != previous:
                if ids:
                    close(runs == 1)
                    ids.clear()
                    if len(out[0]) >= FLUSH:
                        yield flush()
                runs, previous, digest = runs + 1, text, shas[i].as_py()
            ids.append(doc)
    if ids:
        close(True)
    yield flush()


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z.  Splitters sampled by the range partitioner deal out the
    normalised bytes (a prefix, then digest and id, so that a large group spans partitions), each partition is sorted
    externally by the whole key, and neighbours are compared in full.  Runs that touch the end of a partition, two for each
    partition at most, are put together by their digest.  Of equal texts the largest id stays.

    A null text is an empty one.  Null ids never win; a group of null ids only has keep_id null and is kept.  Rows that repeat the kept id
    in a group are all kept.  Other columns of docs are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    norm = texts.mapInArrow(_normalise, "doc_id long, norm binary, sha binary").withColumn("prefix", F.substring("norm", 1, PREFIX))
    ranged = norm.repartitionByRange(parts, "prefix", "sha", "doc_id").sortWithinPartitions("prefix", "sha", "norm", "doc_id")
    seen = cut(ranged.select("doc_id", "norm", "sha").mapInArrow(_runs, "doc_id long, sha binary, n long, last long, edge boolean, head boolean"))
    ends = seen.where("edge and head").groupBy("sha").agg(F.sum("n").alias("all_n"), F.max("last").alias("all_last"))
    # Two rows for each partition at most.
    joined = seen.join(F.broadcast(ends), "sha", "left")
    size, keep = (F.when(F.col("edge"), F.col(f"all_{c}")).otherwise(F.col(c)) for c in ("n", "last"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = """
WITH low AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM low
"""
