"""Skeletons keep topology and don't depend on tiles."""

from itertools import product

import numpy as np
import pytest

from voxelspark.operators import thinning

FULL = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
FACES = [o for o in FULL if sum(map(abs, o)) == 1]


def parts(mask, steps):
    left, n = set(map(tuple, np.argwhere(mask))), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            p = todo.pop()
            near = {q for o in steps if (q := tuple(a + b for a, b in zip(p, o))) in left}
            left -= near
            todo += near
    return n


def euler(mask):
    """Corners - edges + faces - voxels of the union of closed cubes."""
    cells = set()
    for p in np.argwhere(mask):
        cells |= {tuple(2 * p + o) for o in product((-1, 0, 1), repeat=3)}
    return sum((-1) ** sum(c % 2 == 0 for c in cell) for cell in cells)


def kept(before, after):
    """Parts, holes (by the Euler number) and cavities are the same; nothing is added."""
    assert (after <= before).all()
    assert parts(before, FULL) == parts(after, FULL)
    assert parts(~np.pad(before, 1), FACES) == parts(~np.pad(after, 1), FACES)
    assert euler(before) == euler(after)


@pytest.mark.parametrize(("seed", "share"), [(1, 0.3), (2, 0.6), (3, 0.85), (4, 0.97)])
def test_volumes(seed, share):
    image = np.random.default_rng(seed).random((7, 9, 8)) < share
    kept(image, thinning.passes(image.astype(np.int64), (0, 0, 0), False) > 0)


def test_simple_voxels_of_all_planes():
    """All 256 neighbourhoods in the plane: a voxel can go if parts and holes of the 3 x 3 image stay the same, and it is at a border."""
    steps, *_ = thinning._around(True)
    code = np.arange(256)
    got = thinning.simple(code, True)
    for c in code:
        image = np.zeros((1, 3, 3), bool)
        for i, (_, dy, dx) in enumerate(steps):
            image[0, 1 + dy, 1 + dx] = c >> i & 1
        with_ = image.copy()
        with_[0, 1, 1] = True
        flat = [o for o in FACES if not o[0]]
        outside = lambda m: parts(~np.pad(m, ((0, 0), (1, 1), (1, 1))), flat)
        assert got[c] == (parts(image, FULL) == parts(with_, FULL) and outside(image) == outside(with_)), c


def test_ends_of_lines_stay():
    line = np.zeros((1, 5, 30), bool)
    line[0, 1:4, 1:29] = True
    left = thinning.passes(line.astype(np.int64), (0, 0, 0), True) > 0
    assert parts(left, FULL) == 1 and 20 < left.sum() <= 30
    thin = np.zeros((3, 3, 9), bool)
    thin[1, 1] = True
    assert (thinning.passes(thin.astype(np.int64), (0, 0, 0), False) > 0).sum() == 9


@pytest.mark.parametrize(("planar", "tiles"), [(True, [(6, 1), (7, 2), (128, 4)]), (False, [(10, 1), (13, 2), (32, 1)])])
def test_tiles(spark, planar, tiles):
    rng = np.random.default_rng(7)
    shape = (2, 40, 50) if planar else (18, 20, 25)
    image = np.zeros(shape, np.int64)
    for k in range(9):
        low = [rng.integers(0, n) for n in shape]
        image[tuple(slice(a, a + int(rng.integers(4, 18))) for a in low)] = k % 4 + 1
    image[rng.random(shape) < 0.03] = 0
    at = np.argwhere(image)
    rows = [(t, int(image[tuple(p)]) * 1000, *(int(v) - 3 for v in p)) for p in at for t in (0, 5)]
    df = spark.createDataFrame(rows, "t int, label int, z int, y int, x int")
    own = {}
    for z in range(shape[0]) if planar else (0,):
        plane = image[z : z + 1] if planar else image
        left = thinning.passes(plane, (z - 3, -3, -3), planar)
        own |= {(int(p[0]) + z - 3, int(p[1]) - 3, int(p[2]) - 3): int(left[tuple(p)]) * 1000 for p in np.argwhere(left)}
        for k in range(1, 5):
            if planar:
                assert parts(plane == k, FULL) == parts(left == k, FULL)
            else:
                kept(plane == k, left == k)
    for tile in tiles:
        got = thinning.skeletons(df, planar, tile).collect()
        for t in (0, 5):
            assert {(r.z, r.y, r.x): r.label for r in got if r.t == t} == own
        assert len(got) == 2 * len(own) < len(rows) / 2
    assert thinning.skeletons(df.limit(0), planar).count() == 0
