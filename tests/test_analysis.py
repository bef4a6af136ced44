"""Morphology in one call, Lorenz curves, match summaries and Otsu thresholds against plain programs."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from test_branches import plain

from voxelspark.operators import analysis, morphology, segment, thinning, tracking

SPACING = (2.0, 0.5, 1.5)


def _objects():
    bar = {(0, y, x) for y in range(3) for x in range(20)} | {(0, y, 10) for y in range(3, 12)}
    blob = {(0, y + 30, x) for y in range(2) for x in range(2)}
    pair, one = {(0, 50, 0), (0, 50, 1)}, {(0, 60, 0)}
    ring = {(0, 70 + y, x) for y in range(9) for x in range(9) if not (2 <= y <= 6 and 2 <= x <= 6)}
    return {(0, 1): bar, (0, 2): blob, (0, 3): pair, (0, 4): one, (3, 1): ring, (3, 7): {(0, 100, x) for x in range(7)}}


def _skeleton(points, planar):
    low = [min(p[i] for p in points) for i in range(3)]
    image = np.zeros([max(p[i] for p in points) - low[i] + 1 for i in range(3)], np.int64)
    for p in points:
        image[tuple(a - b for a, b in zip(p, low))] = 1
    return {tuple(int(a) + b for a, b in zip(p, low)) for p in np.argwhere(thinning.passes(image, tuple(low), planar))}


def _axis_length(points, spacing):
    at = np.array(sorted(points), float)
    along = np.round((at - at.mean(0)) @ np.linalg.eigh(np.cov(at.T, bias=True))[1][:, 2], 9)
    return {round(math.dist(at[i] * spacing, at[j] * spacing), 6) for i in np.flatnonzero(along == along.min()) for j in np.flatnonzero(along == along.max())}


def _frame(spark, objects):
    return spark.createDataFrame([(t, k, *p) for (t, k), ps in objects.items() for p in ps], "t int, label int, z int, y int, x int")


def test_plane_objects(spark):
    objects = _objects()
    got = analysis.analyze(_frame(spark, objects), SPACING, planar=True)
    assert got.radii is None and got.objects.columns[:3] == ["label", "frame", "pixels"]
    rows = {(r.frame, r.label): r for r in got.objects.collect()}
    assert set(rows) == set(objects) - {(0, 4)}
    lengths = defaultdict(list)
    for r in got.branches.collect():
        lengths[(r.frame, r.object_label)].append(r.branch_length)
    for key, r in rows.items():
        thin = _skeleton(objects[key], True)
        own = plain(thin, SPACING)
        assert r.pixels == len(objects[key]) and r.area == pytest.approx(len(objects[key]) * 0.75)
        if own:
            assert r["length source"] == "skeleton" and r.branch_number == len(own) and r.total_branch_length == pytest.approx(sum(b[2] for b in own))
        else:
            assert (r["length source"], r.branch_number, r.junction_number, r.endpoint_number) == ("principal_axis", 1, 0, 2)
            assert round(r.total_branch_length, 6) in _axis_length(thin if len(thin) > 1 else objects[key], SPACING)
        assert r.mean_branch_length == pytest.approx(r.total_branch_length / r.branch_number) and sum(lengths[key]) == pytest.approx(r.total_branch_length)
    assert rows[(0, 3)]["length source"] == rows[(0, 2)]["length source"] == "principal_axis" and rows[(3, 1)].endpoint_number == 0
    # The contour of a line of seven pixels: long sides, and the corners cut.
    assert rows[(3, 7)].perimeter == pytest.approx(2 * 6 * 1.5 + 4 * math.hypot(0.25, 0.75))


def test_volumes(spark):
    tube = {(z, y, x) for z in range(5) for y in range(5) for x in range(40) if (z - 2) ** 2 + (y - 2) ** 2 <= 5}
    spur = {(2, y, 20) for y in range(5, 7)}
    objects = {(0, 1): tube | spur, (0, 2): {(20, 0, x) for x in range(30)}, (1, 1): {(20, 0, x) for x in range(4)}, (1, 2): {(0, 0, 0)}}
    got = analysis.analyze(_frame(spark, objects), (1.0, 1.0, 1.0))
    rows = {(r.frame, r.label): r for r in got.objects.collect()}
    assert set(rows) == set(objects) - {(1, 2)} and rows[(0, 1)].voxels == len(objects[(0, 1)])
    radii = {r.t: r.radius for r in got.radii.collect()}
    length = sum(sum(math.dist(a, b) for a, b in steps) for steps in (_steps(_skeleton(objects[k], False)) for k in ((0, 1), (0, 2))))
    assert radii[0] == pytest.approx(math.sqrt(sum(len(objects[k]) for k in ((0, 1), (0, 2))) / (math.pi * length))) and radii[1] == pytest.approx(math.sqrt(4 / (math.pi * 3)))
    # No branch to an end is as short as the radius, and the surface is that of the exposed faces.
    assert rows[(0, 2)].total_branch_length == 29 and rows[(0, 2)].surface_area == 30 * 4 + 2 and rows[(0, 1)].branch_number <= 3
    assert {r.object_label for r in got.branches.where("frame = 0").collect()} == {1, 2}


def _steps(points):
    from test_branches import near

    return {tuple(sorted((p, q))) for p in points for q in near(p, points)}


def test_lorenz_curve(spark):
    rng = random.Random(1)
    values = [float(rng.randint(0, 40)) for _ in range(500)] + [float("nan"), float("inf"), -3.0, None]
    got = sorted(map(tuple, morphology.lorenz(spark.createDataFrame([(v,) for v in values], "v double").repartition(7), "v").collect()))
    kept = sorted(v for v in values if v is not None and v > 0 and math.isfinite(v))
    want = [(0.0, 0.0)] + [(sum(w <= v for w in kept) / len(kept), sum(w for w in kept if w <= v) / sum(kept)) for v in sorted(set(kept))]
    assert np.allclose(got, want)
    assert morphology.lorenz(spark.createDataFrame([], "v double"), "v").count() == 0


def test_match_summary(spark):
    points = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4), (3, 5), (3, 6)], "t int, point_id int")
    matches = spark.createDataFrame([(0, 1, 4)], "t int, src int, dst int")
    got = {r.frame_from: tuple(r)[1:] for r in tracking.match_summary(points, matches).collect()}
    assert got == {0: (1, 3, 1, 1, 1 / 3, 1.0), 1: (2, 1, 0, 0, 0.0, 0.0), 2: (3, 0, 2, 0, 0.0, 0.0), None: (None, 4, 3, 1, 0.25, 1 / 3)}
    assert tracking.match_summary(points.limit(0), matches.limit(0)).count() == 0


@pytest.mark.parametrize("bins", [256, 16])
def test_otsu(spark, bins):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(60, 15, 400), rng.normal(180, 20, 300), [255.0, 0.0, 300.0, -4.0]])
    inside = values[(values >= 0) & (values <= 255)]
    count = np.bincount(np.minimum((inside * bins / 255).astype(int), bins - 1), minlength=bins).astype(float)
    center = (np.arange(bins) + 0.5) * 255 / bins
    best = [count[: k + 1].sum() * count[k + 1 :].sum() * ((count * center)[: k + 1].sum() / count[: k + 1].sum() - (count * center)[k + 1 :].sum() / count[k + 1 :].sum()) ** 2 if count[: k + 1].sum() and count[k + 1 :].sum() else -1 for k in range(bins - 1)]
    got = segment.otsu(spark.createDataFrame([(float(v),) for v in values], "value double"), bins).head()
    assert got.threshold_bin == int(np.argmax(best)) and got.threshold == pytest.approx(center[int(np.argmax(best))])


def test_segmentation_ends_by_itself(spark):
    """With the usual limits the labels are those of higher ones, however rows are dealt out, and split two kinds of values."""
    rng = np.random.default_rng(4)
    inside = np.zeros((12, 14), bool)
    inside[3:9, 4:10] = True
    values = np.where(inside, rng.normal(180, 12, inside.shape), rng.normal(60, 12, inside.shape)).round(3)
    rows = [(0, 0, y, x, float(values[y, x]), float(inside[y, x])) for y in range(12) for x in range(14)]
    frame = lambda n: spark.createDataFrame(rows, "t int, z int, y int, x int, value double, response double").repartition(n)
    run = lambda n, **kw: {(r.y, r.x): r.label for r in segment.segment(frame(n).drop("response"), frame(n).drop("value"), **kw).collect()}
    got = run(2)
    assert got == {(y, x): int(inside[y, x]) for y in range(12) for x in range(14)}
    assert got == run(9, outer=60, inner=40)


def test_log_likelihood(spark):
    model = [(0, 0, 0.4, 10.0, 2.0), (0, 1, 0.6, 20.0, 3.0), (1, 0, 1.0, 50.0, 5.0)]
    points = [(0, 11.0), (0, 19.0), (0, 19.0), (1, 47.0)]
    pdf = lambda v, m, s: math.exp(-((v - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    want = sum(math.log(sum(p * pdf(v, m, s) for k, _, p, m, s in model if k == c)) for c, v in points) / len(points)
    table = spark.createDataFrame(model, "class int, k int, pi double, mu double, sigma double")
    assert segment.log_likelihood(spark.createDataFrame(points, "class int, value double"), table).head()[0] == pytest.approx(want)
    assert segment.log_likelihood(spark.createDataFrame([(0, 11.0, 1), (0, 19.0, 2), (1, 47.0, 1)], "class int, value double, n long"), table).head()[0] == pytest.approx(want)
