"""Exact quantiles against sorted values."""

import math

import numpy as np
import pytest

from voxelspark.operators import quantiles


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(0, 1e6, 700).round(3), 2: np.full(40, 7.5), 3: np.array([-1e-9, 0.0, 1e18, 5.0, 5.0]), 4: rng.integers(0, 4, 900).astype(float), 5: np.array([2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, float("nan")), (2, None), (6, None)]
    shares = [0.0, 0.018, 0.5, 0.982, 1.0]
    df = spark.createDataFrame(rows, "t int, value double")
    want = {(g, s): float(np.sort(v)[max(1, math.ceil(len(v) * s)) - 1]) for g, v in groups.items() for s in shares}
    for parts, bins in ((1, 1024), (7, 2)):
        got = {(r.t, r.share): r["quantile"] for r in quantiles.quantiles(df.repartition(parts), ["t"], shares, bins=bins).collect()}
        assert got == want


def test_counted_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 3), (5, 90), (9, 7)], "value int, n int")
    assert {r.share: r["quantile"] for r in quantiles.quantiles(df, [], [0.03, 0.04, 0.93, 0.94], times="n").collect()} == {0.03: 1, 0.04: 5, 0.93: 5, 0.94: 9}
    assert quantiles.quantiles(df.limit(0), [], [0.5]).where("quantile IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="between"):
        quantiles.quantiles(df, [], [1.5])


def test_rescaling_between_quantiles(spark):
    rows = [(t, 0, 0, x, float(x if t else 4), x) for t in range(2) for x in range(101)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, value double, n int")
    got = {(r.t, r.x): r.value for r in quantiles.rescale_between(df, ["t"], 0.1, 0.9).collect()}
    assert all(got[(0, x)] == 0 for x in range(101))
    assert got[(1, 3)] == 0 and got[(1, 99)] == 1 and got[(1, 50)] == pytest.approx((50 - 10) / 80)
