"""Groups in Arrow batches, and sampling of many small objects."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import assignment
from voxelspark.operators.groups import whole


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_no_group_is_cut(size):
    keys = [0, 0, 0, 1, 2, 2, 3, 4, 4, 4, 4, 4, 5]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(len(keys)))], ["k", "i"])
    tables = list(whole((rows.slice(i, size) for i in range(0, len(keys), size)), [0]))
    assert [i for t in tables for i in t.column(1).to_pylist()] == list(range(len(keys)))
    seen = [k for t in tables for k in dict.fromkeys(t.column(0).to_pylist())]
    assert seen == list(range(6))


def test_objects_taken_whole_need_no_kernel(spark, monkeypatch):
    """Only objects with more voxels than sample points reach the Python kernel, whatever the batches."""
    monkeypatch.setattr(assignment, "_sampled", lambda batches: iter(()))
    voxels = spark.range(3000).selectExpr("0 AS t", "CAST(id div 3 AS INT) AS label", "0 AS z", "CAST(id AS INT) AS y", "CAST(id % 3 AS INT) AS x", "1 AS value")
    samples = spark.range(1000).selectExpr("0 AS t", "CAST(id AS INT) AS label", "IF(id % 2 = 0, 3L, 2L) AS samples")
    got = assignment.sample_points(voxels, samples).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert len(got) == 500 and all(r.label % 2 == 0 and r.n == 3 for r in got)


def test_small_objects_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        voxels = spark.range(300).selectExpr("0 AS t", "CAST(id div 3 AS INT) AS label", "0 AS z", "CAST(id AS INT) AS y", "0 AS x", "1 AS value")
        samples = spark.range(100).selectExpr("0 AS t", "CAST(id AS INT) AS label", "2L AS samples")
        got = assignment.sample_points(voxels, samples).groupBy("label").agg(F.count("*").alias("n")).collect()
        assert len(got) == 100 and all(r.n == 2 for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
