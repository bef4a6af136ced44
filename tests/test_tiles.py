"""Work on tiles of the image: what lies across their borders, and how little is left for the whole image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import branches, components, graph
from voxelspark.operators.neighbors import skeleton_edges

V = "t int, z int, y int, x int"


@pytest.mark.parametrize("full, parts", [(False, 3), (True, 1)])
def test_pieces_meet_at_the_corners_of_tiles(spark, full, parts, monkeypatch):
    seen = []
    monkeypatch.setattr(components, "rounds", lambda edges: seen.append(edges.count()) or graph.rounds(edges))
    line = [(0, 31, 127, x) for x in range(120, 128)] + [(0, 32, 128, 127), (0, 33, 129, 128), (0, 33, 129, 129)]
    got = {tuple(r)[:4]: r.label for r in components.label(spark.createDataFrame(line, V), full).collect()}
    assert len(got) == len(line) and len(set(got.values())) == parts and got[line[0]] == 1
    # An object inside a tile leaves nothing to the rounds over the whole image.
    square = spark.createDataFrame([(1, 0, y - 40, x) for y in range(9) for x in range(9)], V)
    assert components.label(square, full).agg(F.count("*"), F.max("label")).head() == (81, 1) and seen[0] > 0 == seen[1]


@pytest.mark.parametrize("planar", [False, True])
def test_pairs_of_a_skeleton_on_tiles(spark, planar):
    """The steps found on tiles are those of skeleton_edges, each from both ends, with the degrees that follow from them."""
    rng = np.random.default_rng(2)
    rows = [(0, int(label), int(z) + 31, int(y) + 126, int(x) - 2) for (z, y, x), label in np.ndenumerate(rng.integers(1, 3, (3, 5, 6))) if rng.random() < 0.4]
    voxels = branches._numbers(spark.createDataFrame(rows, "t int, label int, z int, y int, x int"))
    found = [r for r in branches._pairs(voxels, (1.0, 1.0, 1.0), planar).collect() if r.step]
    place = {r.id: (r.z, r.y, r.x) for r in voxels.collect()}
    want = set()
    for r in skeleton_edges(voxels, planar, branches.OBJECT).collect():
        a, b = (r.z, r.y, r.x), (r.z + r.dz, r.y + r.dy, r.x + r.dx)
        want |= {(a, b), (b, a)}
    assert {(place[r.u], place[r.v]) for r in found} == want and len(found) == len(want)
    degree = lambda p: sum(a == p for a, _ in want)
    assert all((r.degree, r.other) == (degree(place[r.u]), degree(place[r.v])) for r in found)
    assert sorted(r.u for r in found if r.lead) == sorted({r.u for r in found})
