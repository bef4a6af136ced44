"""Optimal matching and sampling against exhaustive search and invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import assignment


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (5, 5), (4, 6)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(5):
        cost = rng.integers(0, 20, shape).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(shape[0])) for p in itertools.permutations(range(shape[1]), shape[0]))
        got = assignment.assign(cost)
        assert len(set(got)) == shape[0] and cost[np.arange(shape[0]), got].sum() == best


def test_matching_with_unmatched_cost(spark):
    edges = [(0, 1, 1, 5.0, 1.0), (0, 1, 2, 1.0, 1.0), (0, 2, 2, 1.5, 1.0), (0, 3, 3, 9.0, 1.0), (1, 1, 1, 2.0, 1.0)]
    got = {(r.t, r.src, r.dst) for r in assignment.match_optimal(spark.createDataFrame(edges, "t int, src long, dst long, cost double, dist double"), 6.0).collect()}
    # 1-1 and 2-2 cost 6.5; 1-2 with 2 left out costs 7; 3 is dearer than being left out.
    assert got == {(0, 1, 1), (0, 2, 2), (1, 1, 1)}


def test_sampling(spark):
    voxels = spark.range(40).selectExpr("0 AS t", "1 AS label", "0 AS z", "CAST(id div 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x", "1.0D AS value")
    samples = spark.createDataFrame([(0, 1, 5)], "t int, label int, samples long")
    rows = assignment.sample_points(voxels, samples).collect()
    assert len({(r.y, r.x) for r in rows}) == 5
    assert assignment.sample_points(voxels, samples.withColumn("samples", F.lit(99))).count() == 40


def test_sparse_assignment_costs_as_much_as_the_dense_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m = rng.integers(1, 14, 2)
        there = rng.random((n, m)) < 0.4
        price = rng.integers(0, 9, (n, m)).astype(float)
        dense = np.full((n, m + n), 1e12)
        dense[:, :m][there] = price[there]
        dense[np.arange(n), m + np.arange(n)] = 5.0
        rows, columns = np.nonzero(there)
        edge = assignment.assign_sparse(np.searchsorted(rows, np.arange(n + 1)), columns, price[there], m, 5.0)
        taken = edge[edge >= 0]
        assert (rows[taken] == np.flatnonzero(edge >= 0)).all() and len(set(columns[taken])) == len(taken)
        assert price[there][taken].sum() + 5.0 * (edge < 0).sum() == dense[np.arange(n), assignment.assign(dense)].sum()


def test_matching_of_a_large_frame_pair(spark):
    """30,000 sources in one frame pair, in components of two: their matrix would take 14 GB."""
    edges = spark.range(15000).selectExpr("explode(array((0, 0, 1.0D), (0, 1, 2.0D), (1, 0, 1.5D), (1, 1, 9.0D))) AS e", "id")
    edges = edges.selectExpr("0 AS t", "2 * id + e.col1 AS src", "2 * id + e.col2 AS dst", "e.col3 AS cost", "e.col3 AS dist")
    got = assignment.match_optimal(edges, 6.0)
    # 0-1 and 1-0 cost 3.5, 0-0 with 1 left out costs 7.
    assert got.count() == 30000 and got.where("src = dst").count() == 0 and got.agg(F.sum("cost")).head()[0] == 15000 * 3.5
