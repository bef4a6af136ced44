"""Materialisation and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that a task contracts at once.
_EDGES = 1 << 20


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset, a local one, but only for a master that is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp("-ckpt")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Write tables to a folder of their own below the shared one and read them back; it goes at the end, so what outlasts it must be cut.

    A checkpoint hands on the size estimated from its plan, which each join multiplies; a long computation in several parts starts each from a table,
    whose size is known.
    """
    base, n = f"{_shared(spark)}/tables-{uuid.uuid4().hex}", 0

    def write(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{base}/{n}")
        return spark.read.schema(df.schema).parquet(f"{base}/{n}")

    try:
        yield write
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of these edges and the least id that each reaches by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(ids))
    a, b = at[: len(a)], at[len(a) :]
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (id, root) within each part of a task's edges."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _EDGES:
            yield _star(held)
            held, rows = [], 0
    if rows:
        yield _star(held)


def _star(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    edges = pa.Table.from_batches(batches)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in roots_of(*(edges.column(i).to_numpy() for i in range(2)))], ["id", "root"])


def connected(nodes: DataFrame, edges: DataFrame, near: Sequence[str] = ("a",)) -> DataFrame:
    """(id, root) of nodes(id) under undirected edges(a, b), both of whole numbers: root is the least id reachable.

    near: columns of edges in whose order connected edges mostly lie close; they change no result.  Ranges of this order are contracted to stars first, so
    that rounds over the whole table are left only for the stars that share a node with another range.
    """
    kind = nodes.schema["id"].dataType
    work = cut(edges.where("a <> b").select(F.col("a").cast("long").alias("_a"), F.col("b").cast("long").alias("_b"), *near))
    stars = cut(work.repartitionByRange(*near).select("_a", "_b").mapInArrow(_stars, "id long, root long"))
    least = cut(stars.groupBy("id").agg(F.min("root").alias("star"), F.max("root").alias("most")))
    shared = stars.join(least.where("star <> most").select("id", "star"), "id").where("root <> star").select(F.col("root").alias("a"), F.col("star").alias("b"))
    joined = rounds(shared).select(F.col("id").alias("star"), F.col("root").alias("better"))
    found = least.join(joined, "star", "left").select("id", F.coalesce("better", "star").alias("root"))
    return nodes.select(F.col("id").cast("long").alias("id")).join(found, "id", "left").select(F.col("id").cast(kind).alias("id"), F.coalesce("root", "id").cast(kind).alias("root"))


def rounds(edges: DataFrame) -> DataFrame:
    """(id, root) of the ids in edges(a, b) but the roots themselves.

    Each round replaces every edge by edges to the least neighbour, first of the larger and then of the smaller end; the rounds grow with the
    logarithm of the longest chain, and nothing but a checksum reaches the driver.
    """
    work = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == seen or not state[0]:
            break
        seen = state
        both = work.union(work.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(least, "a")
        work = cut(near.select("a", F.col("m").alias("b")).union(near.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    return work.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
