"""Intermediate tables in the shared folder, removed once the result stands."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a query go when it ends; should anything still need them, their stage is run again.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where that is unset, a local one, but only for a master that is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.gettempdir()).rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, n: int | None) -> Iterator[None]:
    """At most n rows in an Arrow batch; as set before if n is None."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, before if n is None else n)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned and run meanwhile leave no shuffle files behind; for tables that are written out whole."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


class Scratch:
    """A folder below the shared one for Parquet tables."""

    def __init__(self, spark: SparkSession):
        base = shared_folder(spark)
        self._spark, self._path, self._n = spark, f"{base}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, by: Sequence[str] = (), batch: int | None = None) -> DataFrame:
        """Write df as Parquet, in folders by some columns if so wished, and read it back with the same schema.

        batch: rows of an Arrow batch meanwhile; batches of whole texts must stay small.
        """
        self._n += 1
        path = f"{self._path}/{self._n}"
        with arrow_rows(self._spark, batch):
            df.write.partitionBy(*by).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
