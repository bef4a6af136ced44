"""Holes and false loops against flooding from outside."""

import random
from itertools import product

import numpy as np
import pytest

from voxelspark.operators import branches
from voxelspark.operators.holes import fill_holes, holes


def flooded(mask, planar):
    """Background that can't be reached from outside, of a boolean volume."""
    pad = ((0, 0) if planar else (1, 1), (1, 1), (1, 1))
    space = np.pad(mask, pad)
    left = set(map(tuple, np.argwhere(~space)))
    steps = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1 and not (planar and o[0])]
    todo = [p for p in left if p[1] == 0]
    left -= set(todo)
    while todo:
        p = todo.pop()
        near = {q for o in steps if (q := tuple(a + b for a, b in zip(p, o))) in left}
        left -= near
        todo += near
    return {(z - pad[0][0], y - 1, x - 1) for z, y, x in left}


@pytest.mark.parametrize(("planar", "share"), [(True, 0.55), (True, 0.7), (False, 0.8), (False, 0.9)])
def test_holes(spark, planar, share):
    rng = np.random.default_rng(int(share * 100))
    frames = {t: rng.random((4, 12, 14)) < share for t in (-1, 3)}
    rows = [(t, *map(int, p)) for t, m in frames.items() for p in np.argwhere(m)]
    df = spark.createDataFrame(rows + rows[:5], "t int, z int, y int, x int")
    want = {(t, *p) for t, m in frames.items() for p in flooded(m, planar)}
    got = [tuple(map(int, r)) for r in holes(df, planar).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {tuple(r) for r in fill_holes(df, planar).collect()} == want | set(rows)


def test_no_holes(spark):
    assert holes(spark.createDataFrame([], "t int, z int, y int, x int")).count() == 0


def _voxels(spark, objects):
    return spark.createDataFrame([(0, k, *p) for k, ps in objects.items() for p in ps], "t int, label int, z int, y int, x int")


def test_false_loops(spark):
    """Equal rings with tails, one around a hole, one drawn in a solid object, and one whose inside shows from above only."""
    ring = {(1, y, x) for y in range(9) for x in range(9) if y in (0, 8) or x in (0, 8)} | {(1, 4, x) for x in range(9, 20)} | {(1, y, 4) for y in range(-12, 0)}
    solid = {(1, y, x) for y in range(9) for x in range(9)} | ring
    thick = {(z, *p[1:]) for p in ring for z in range(3)}
    shift = lambda ps, by: {(z, y + by, x) for z, y, x in ps}
    skeletons = {1: ring, 2: shift(ring, 100), 3: shift(ring, 200)}
    objects = {1: ring, 2: shift(solid, 100), 3: shift(thick, 200)}
    rows = branches.simplified(_voxels(spark, skeletons), (1.0, 1.0, 1.0), False, 2.0, _voxels(spark, objects)).collect()
    of = {k: sorted(round(r.length) for r in rows if r.label == k) for k in skeletons}
    kept = branches.simplified(_voxels(spark, skeletons), (1.0, 1.0, 1.0), False, 2.0).collect()
    assert of[1] == of[3] == sorted(round(r.length) for r in kept if r.label == 1) and len(of[1]) == 4
    # In the solid object the longer of two ways round goes, and what is left is one line.
    assert len(of[2]) == 1 and of[2][0] < sum(of[1])


def test_real_and_false_loops_by_rows(spark):
    row = "t int, label int, branch_id long, start_node long, start_kind string, end_node long, end_kind string, length double, points long"
    rng = random.Random(3)
    square = lambda at, n: [(0, at + y, x) for y in range(n) for x in range(n) if y in (0, n - 1) or x in (0, n - 1)]
    rows, points, mask = [], [], set()
    for k in range(6):
        path = square(50 * k, 6)
        half = rng.randint(5, 12)
        rows += [(0, 1, 10 * k, k, "junction", k if k % 2 else 100 + k, "junction", 9.0, half)]
        points += [(0, 1, 10 * k, *p) for p in path[:half]]
        if k % 2 == 0:
            rows += [(0, 1, 10 * k + 1, 100 + k, "junction", k, "junction", 5.0, 20 - half)]
            points += [(0, 1, 10 * k + 1, *p) for p in path[half:]]
        else:
            points += [(0, 1, 10 * k, *p) for p in path[half:]]
        filled = {(0, 50 * k + y, x) for y in range(6) for x in range(6)} if k > 2 else set(path)
        mask |= filled
    rows += [(0, 1, 999, None, None, None, None, 3.0, 5), (0, 1, 998, 7, "endpoint", 8, "junction", 3.0, 5)]
    table = spark.createDataFrame(rows, row)
    at = spark.createDataFrame(points, "t int, label int, branch_id long, z int, y int, x int")
    got = branches.without_false_loops(table, at, spark.createDataFrame([(0, 1, *p) for p in mask], "t int, label int, z int, y int, x int"), planar=True)
    assert {r.branch_id for r in got.collect()} == {0, 1, 10, 20, 21, 41, 999, 998}
