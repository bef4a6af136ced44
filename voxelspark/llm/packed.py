"""Rows of fixed width, shuffled in packs.

A pack holds the rows of one bucket that one task has gathered, column by column and byte plane by byte plane, so that planes of small
or ordered values all but vanish when the shuffle compresses them.  A Spark row per value would take two to three times the disk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, data binary"
#: Rows of a bucket that a task holds at once, in the mean.
BUCKET_ROWS = 4_000_000


def buckets(rows: int, least: int) -> int:
    """How many buckets so many rows take; at least as many as there are shuffle partitions."""
    return max(1, least, -(-rows // BUCKET_ROWS))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets from the upper half of 64-bit hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def spread(bucket: np.ndarray, columns: Sequence[np.ndarray]) -> pa.RecordBatch | None:
    """One pack for each bucket that has rows; the order of rows stays within a pack."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    planes = [np.ascontiguousarray(c[order]).view(np.uint8).reshape(len(own), -1) for c in columns]
    ends = [*begin[1:].tolist(), len(own)]
    packs = [b"".join(np.ascontiguousarray(p[i:j].T).tobytes() for p in planes) for i, j in zip(begin.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(own[begin], pa.int32()), pa.array(packs, pa.binary())], ["bucket", "data"])


def exchange(packs: DataFrame, n: int) -> DataFrame:
    """Each bucket in a partition of its own."""
    return packs.repartitionById(n, F.col("bucket"))


def gather(batches: Iterator[pa.RecordBatch], kinds: Sequence[np.dtype | type]) -> list[np.ndarray]:
    """The columns of all packs of a partition."""
    kinds = [np.dtype(k) for k in kinds]
    width, parts = sum(k.itemsize for k in kinds), [[] for _ in kinds]
    for batch in batches:
        for pack in batch.column(1):
            raw, at = np.frombuffer(pack.as_buffer(), np.uint8), 0
            n = len(raw) // width
            for part, kind in zip(parts, kinds):
                size = kind.itemsize * n
                part.append(np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, n).T).view(kind).ravel())
                at += size
    return [np.concatenate(p) if p else np.empty(0, k) for p, k in zip(parts, kinds)]


def groups(keys: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run of them begins."""
    order = np.lexsort(tuple(reversed(keys))) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def estimated_words(docs: DataFrame, text_column: str) -> int:
    """An upper guess at the words of all texts, from their bytes."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_column)))).head()[0] or 0) // 5
