"""Known values and invariants of the image operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.functions import scalars as S
from voxelspark.operators import components, distance, kernels, masks, morphology, neighbors, proximity, segment, topology, tracking
from voxelspark.operators.graph import connected

V = "t int, z int, y int, x int"


def voxels(spark, array, value="value double"):
    array = np.asarray(array)
    full = array.reshape((1,) * (4 - array.ndim) + array.shape)
    return spark.createDataFrame([(*map(int, p), float(full[tuple(p)])) for p in np.argwhere(full != 0)], f"{V}, {value}")


def dense(spark, array):
    array = np.asarray(array)
    full = array.reshape((1,) * (4 - array.ndim) + array.shape)
    return spark.createDataFrame([(*map(int, p), float(full[p])) for p in itertools.product(*map(range, full.shape))], f"{V}, value double")


def test_faces_of_a_cube(spark):
    cube = np.ones((3, 3, 3))
    measure = lambda a, s: neighbors.exposed_measure(voxels(spark, a), s).head().measure
    assert measure(cube, (1, 1, 1)) == 54
    cube[1, 1, 1] = 0
    assert measure(cube, (1, 1, 1)) == 60
    assert measure(cube, (3, 0.5, 0.5)) == 65
    assert neighbors.exposed_measure(voxels(spark, cube).limit(0), (1, 1, 1)).head().measure == 0


def test_contours_and_axes_of_a_bar(spark):
    bar = np.ones((5, 20))
    size = lambda a: neighbors.contour_length(voxels(spark, a).withColumn("label", F.lit(1)), 1.0, 3.0).head().perimeter
    assert size(bar) > size(bar.T)
    axis = lambda a, s: morphology.principal_axis(voxels(spark, a).withColumn("label", F.lit(1)), s).head().major_axis_length
    assert axis(bar, (1, 1, 3)) == pytest.approx(axis(bar.T, (1, 3, 1)))


def test_eigenvalues(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 3, 3))
    m = m + m.transpose(0, 2, 1)
    m = np.concatenate([m, np.zeros((1, 3, 3)), np.eye(3)[None]])
    rows = [(i, *map(float, (a[0, 0], a[1, 1], a[2, 2], a[0, 1], a[0, 2], a[1, 2]))) for i, a in enumerate(m)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double, f double")
    got = df.select("i", *S.eigenvalues_3x3(*[F.col(c) for c in "abcdef"])).orderBy("i").collect()
    assert np.allclose([r[1:] for r in got], np.linalg.eigvalsh(m)[:, ::-1], atol=1e-9)


def test_constant_images_have_no_response(spark):
    flat = dense(spark, np.full((9, 8), 7.0))
    assert kernels.vesselness(flat, 5, (1.0, 2.0)).agg(F.max("response")).head()[0] == 0
    assert kernels.derivative(flat, 5, 1.0, "x").agg(F.max(F.abs("value"))).head()[0] == 0
    assert kernels.smooth(flat, 5, 1.0).agg(F.max(F.abs(F.col("value") - 7))).head()[0] < 1e-9


def test_lines_respond(spark):
    image = np.zeros((15, 15))
    image[7, :] = 100
    got = {(r.y, r.x): r.response for r in kernels.vesselness(dense(spark, image), 7, (1.0, 1.5)).collect()}
    assert got[(7, 7)] > 0.9 and got[(7, 7)] <= 1 and got[(1, 7)] < 0.1


def test_volumes_respond_to_lines_and_sheets(spark):
    line, sheet = np.zeros((9, 9, 9)), np.zeros((9, 9, 9))
    line[4, 4, :] = 100
    sheet[4] = 100
    at = lambda a, mode: {(r.z, r.y, r.x): r.response for r in kernels.response_3d(dense(spark, a), 5, (1.0,), mode).collect()}[(4, 4, 4)]
    assert at(line, "vesselness") > 0.8 > 0.3 > at(line, "sheetness")
    assert at(sheet, "sheetness") > 0.9 and at(sheet, "vesselness") < 0.1
    flat = kernels.response_3d(dense(spark, np.full((4, 5, 6), 3.0)), 5, (1.0,))
    assert flat.agg(F.max("response")).head()[0] < 1e-6 and flat.count() == 120


def test_second_derivatives_on_tiles(spark):
    """Gaps count as the fill value; tiles agree with a plain program on the whole array, mirrored borders included."""
    image = np.random.default_rng(5).random((3, 5, 150))
    image[:, :, 60:75] = 0
    got = {(r.z, r.y, r.x): r for r in kernels.hessian_3d(voxels(spark, image), 5, 1.5, 0.8, fill=0.0).collect()}
    assert len(got) == image.size
    scale = {"z": 1.5 * 0.8, "y": 1.5, "x": 1.5}

    def along(work, axis, steep):
        half = scale["zyx"[axis]] / 2**0.5
        w = kernels.gaussian_weights(5, half)
        n = work.shape[axis]
        mirrored = lambda k: np.take(work, [max(0, min(n - 1, j if j < n else 2 * (n - 1) - j)) for j in (abs(i + k) for i in range(n))], axis)
        return sum((k / half**2 * w[k] * (mirrored(k) - mirrored(-k)) if steep else w[k] * (mirrored(k) + mirrored(-k)) for k in (1, 2)), 0 * work if steep else w[0] * work)

    for a, b in ("zz", "zy", "zx", "yy", "yx", "xx"):
        want = image
        for c in (b, a):
            for axis in range(3):
                want = along(want, axis, "zyx"[axis] == c)
        want = want * scale[a] * scale[b]
        assert np.allclose([got[p][f"h{a}{b}"] for p in np.ndindex(image.shape)], want.ravel(), atol=1e-12)


@pytest.mark.parametrize("within, spacing", [(0.0, (1, 1, 1)), (2**0.5, (1, 1, 1)), (3.0, (2.0, 1.5, 0.75)), (-1.0, (1, 1, 1))])
def test_bounded_search_on_tiles(spark, within, spacing, monkeypatch):
    """Steps on tiles find the same targets as the rows around each voxel, across borders of tiles and below 0."""
    rng = np.random.default_rng(11)
    some = lambda share: [tuple(map(int, p)) for p in np.argwhere(rng.random((3, 40, 9)) < share)]
    src = spark.createDataFrame([(t, z - 2, y + 108, x - 4) for t in (0, 1) for z, y, x in some(0.2)] * 2, V)
    dst = spark.createDataFrame([(0, z - 1, y + 110, x - 4, k) for z, y, x in some(0.05) for k in (7, 3)], V + ", label int")
    steps = distance._steps_within(within, [float(s) for s in spacing])
    assert steps is not None and distance._steps_within(1e9, (1.0, 1.0, 1.0)) is None
    got = distance.nearest(src, dst, spacing, within)
    rows = sorted(got.collect(), key=lambda r: r[:4])
    monkeypatch.setattr(distance, "MOST_STEPS", -1)
    other = distance.nearest(src, dst.groupBy("t", "z", "y", "x").agg(F.min("label").alias("label")), spacing, within)
    assert got.schema == other.schema and rows == sorted(other.collect(), key=lambda r: r[:4])
    assert any(r.d2 is not None for r in rows) == (within > 0 or any(r.d2 == 0 for r in rows))


@pytest.mark.parametrize("full", [False, True])
def test_components(spark, full):
    rng = np.random.default_rng(3)
    mask = rng.random((2, 3, 6, 7)) < 0.4
    got = {(r.t, r.z, r.y, r.x): r.label for r in components.label(voxels(spark, mask), full).collect()}
    for t in range(2):
        points = [tuple(p) for p in np.argwhere(mask[t])]
        parent = {p: p for p in points}

        def find(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for a, b in itertools.combinations(points, 2):
            d = [abs(i - j) for i, j in zip(a, b)]
            if (max(d) <= 1) if full else (sum(d) == 1):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
        rank = {r: k + 1 for k, r in enumerate(sorted({find(p) for p in points}))}
        assert all(got[(t, *p)] == rank[find(p)] for p in points)


def test_components_of_nothing(spark):
    assert components.label(spark.createDataFrame([], f"{V}, value double")).count() == 0


def test_connected_chain(spark):
    nodes = spark.range(40)
    got = {r.id: r.root for r in connected(nodes, spark.range(30).selectExpr("id AS a", "id + 1 AS b")).collect()}
    assert got == {i: 0 if i <= 30 else i for i in range(40)}


def test_distances(spark):
    rng = np.random.default_rng(4)
    src, dst = rng.random((4, 5, 6)) < 0.3, rng.random((4, 5, 6)) < 0.1
    spacing = np.array([2.0, 0.5, 1.0])
    target = np.argwhere(dst)
    for r in distance.nearest(voxels(spark, src), voxels(spark, dst), tuple(spacing)).collect():
        assert r.d2 == pytest.approx(((((target - (r.z, r.y, r.x)) * spacing) ** 2).sum(1)).min())
    none = distance.nearest(voxels(spark, src), voxels(spark, dst).limit(0))
    assert none.where("d2 is not null").count() == 0 and none.count() == src.sum()


def test_identical_masks(spark):
    square = np.zeros((8, 8))
    square[2:4, 2:4] = 5
    r = proximity.overlap_summary(voxels(spark, square), voxels(spark, square)).head()
    assert (r.dice, r.jaccard, r.manders_source, r.overlap_size) == (1.0, 1.0, 1.0, 4)
    empty = proximity.overlap_summary(voxels(spark, square).limit(0), voxels(spark, square).limit(0)).head()
    assert (empty.dice, empty.manders_source) == (0.0, 0.0)


def test_polygons(spark):
    rois = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 6.0), (6.0, 0.0)]), (2, [(float("nan"), 0.0), (1.0, 1.0), (2.0, 0.0)]), (3, [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)])], "roi_id int, vertices array<struct<y double, x double>>")
    got = {(r.y, r.x) for r in proximity.roi_voxels(voxels(spark, np.ones((8, 8))), rois).collect()}
    assert got == {(y, x) for y in range(8) for x in range(8) if x < 6 - y}


def test_large_ids_stay_exact(spark):
    rows = [(str(2**63 + 1),), (str(2**64 - 1),), ("7",), ("7",), ("0",)]
    got = masks.compact_ids(spark.createDataFrame(rows, "s string").select(F.col("s").cast("decimal(20,0)").alias("label"))).collect()
    assert {int(r.original): r.compact for r in got} == {7: 1, 2**63 + 1: 2, 2**64 - 1: 3}


def test_potentials(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, (1, 3, 5, 6))
    padded = np.pad(labels[0], 1)
    want = sum(w * (2 * np.roll(padded, s, a)[1:-1, 1:-1, 1:-1] - 1) for a, w in ((0, 0.35), (1, 0.7), (2, 0.7)) for s in (1, -1))
    df = dense(spark, labels).select("t", "z", "y", "x", F.col("value").cast("int").alias("label"))
    for r in segment.smoothness(df, 0.7, 0.1, 0.2, ("z", "y", "x")).collect():
        assert r.potential == pytest.approx(want[r.z, r.y, r.x], abs=1e-9)


def test_segmentation(spark):
    ramp = np.arange(64.0).reshape(8, 8)
    image = dense(spark, ramp)
    got = segment.segment(image, image.withColumnRenamed("value", "response"), outer=3, inner=2)
    by = {(r.y, r.x): r.label for r in got.collect()}
    assert by[(0, 0)] == 0 and by[(7, 7)] == 1 and len(by) == 64
    with pytest.raises(ValueError, match="constant"):
        segment.segment(dense(spark, np.ones((4, 4))), image.withColumnRenamed("value", "response"))
    with pytest.raises(ValueError, match="nonempty"):
        segment.segment(image.limit(0), image.withColumnRenamed("value", "response"))


def test_matching_is_sequential_greedy(spark):
    rng = random.Random(6)
    edges = [(t, a, b, float(rng.randint(0, 9)), float(rng.randint(0, 3))) for t in range(2) for a in range(12) for b in range(12) if rng.random() < 0.4]
    got = {(r.t, r.src, r.dst) for r in tracking.match_points(spark.createDataFrame(edges, "t int, src int, dst int, cost double, dist double")).collect()}
    used, want = set(), set()
    for t, a, b, c, d in sorted(edges, key=lambda e: (e[0], e[3], e[4], e[1], e[2])):
        if (t, "s", a) not in used and (t, "d", b) not in used:
            used |= {(t, "s", a), (t, "d", b)}
            want.add((t, a, b))
    assert got == want


def test_tracking_of_a_split(spark):
    movie = np.zeros((3, 1, 6, 10))
    movie[0, 0, 2, 2:8] = movie[1, 0, 2, 2:8] = 1
    movie[2, 0, 2, 2:4] = movie[2, 0, 2, 6:8] = 1
    movie[2, 0, 5, 0] = 1
    out = tracking.track(voxels(spark, movie), tracking.TrackingConfig(max_distance=3.0, min_link_size=1, cost_cutoff=3.0))
    kinds = {r.kind for r in out["events"].collect()}
    assert {"continuation", "fission", "birth"} <= kinds
    lineage = {r.det_id: r.lineage_id for r in out["lineages"].collect()}
    assert len(lineage) == out["objects"].count() and lineage[0] == lineage[1] == lineage[2] == lineage[3] == 1


def test_skeleton_topology(spark):
    """A line, a tee, a ring, a thick bar and a single voxel, in one plane."""
    line, tee = {(0, x) for x in range(6)}, {(10, x) for x in range(9)} | {(y, 4) for y in range(10, 16)}
    ring = {(y, x) for y in range(20, 28) for x in range(8) if y in (20, 27) or x in (0, 7)}
    bar = {(y, x) for y in range(40, 47) for x in range(21)}
    rows = [(0, k, 0, *p) for k, ps in enumerate((line, tee, ring, bar, {(60, 0)}), 1) for p in ps]
    got = {r.label: r for r in topology.skeleton_topology(spark.createDataFrame(rows, "t int, label int, z int, y int, x int")).collect()}
    assert tuple(got[1])[2:] == (6, 1, 0, 2, 5.0) and tuple(got[2])[3:6] == (3, 1, 3)
    assert tuple(got[3])[3:6] == (1, 0, 0) and got[3].total_branch_length > 20
    assert got[4].skeleton_size < 40 and got[4].branches >= 1 and tuple(got[5])[2:] == (1, 0, 0, 0, 0.0)


def test_gini_and_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 0, float("nan"))], "v double")
    v = np.sort([1, 1, 2, 5])
    want = 2 * (np.arange(1, 5) * v).sum() / (4 * v.sum()) - 5 / 4
    r = morphology.gini(df, "v").head()
    assert r.n == 4 and r.gini == pytest.approx(want)
    same = spark.createDataFrame([(3,)] * 6, "v int")
    assert [tuple(x) for x in morphology.histogram(same, "v").collect()] == [(0, 6)]


def test_lines_between_voxels(spark):
    r = spark.range(1).select(S.line_points([F.lit(0), F.lit(0)], [F.lit(2), F.lit(5)]).alias("p")).head().p
    assert [tuple(p) for p in r] == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]


def test_upsampling(spark):
    got = {(r.y, r.x): r.value for r in kernels.upsample(dense(spark, [[0, 4], [8, 12]]), 2).collect()}
    assert [[got[(y, x)] for x in range(4)] for y in range(4)] == [[0, 1, 3, 4], [2, 3, 5, 6], [6, 7, 9, 10], [8, 9, 11, 12]]


def _dealt(weights, capacity, budget):
    """Sample points one by one."""
    n = len(weights)
    left = min(budget, sum(capacity)) - n
    exact = [w / sum(weights) * left for w in weights]
    got = [1 + min(int(e), c - 1) for e, c in zip(exact, capacity)]
    left -= sum(got) - n
    while left > 0:
        for i in sorted(range(n), key=lambda i: (-(exact[i] - int(exact[i])), -weights[i], i)):
            if left > 0 and got[i] < capacity[i]:
                got[i], left = got[i] + 1, left - 1
    return got


def test_sample_points_are_dealt_out_whole(spark):
    rng = random.Random(7)
    frames = [([90, 5, 5], [5, 50, 50])] + [([rng.randint(1, 99) for _ in range(k)], [rng.randint(1, 30) for _ in range(k)]) for k in range(2, 12)]
    rows = [(t, i, w, c) for t, (ws, cs) in enumerate(frames) for i, (w, c) in enumerate(zip(ws, cs))]
    df = spark.createDataFrame(rows, "t int, label int, weight long, capacity long")
    got = {(r.t, r.label): r.samples for r in tracking.allocate_samples(df, 60).collect()}
    assert [got[(0, i)] for i in range(3)] == [5, 28, 27]
    for t, (ws, cs) in enumerate(frames):
        assert [got[(t, i)] for i in range(len(ws))] == _dealt(ws, cs, 60)
    with pytest.raises(Exception, match="less than one"):
        tracking.allocate_samples(df, 2).collect()


def test_rescued_links(spark):
    """Sequential selection over random candidates."""
    rng = random.Random(8)
    cutoff, least = 1.5, 10
    for seed in range(3):
        area = {i: rng.choice([3, 5, 20, 40]) for i in range(40)}
        links = [(a // 20, a, b, round(rng.uniform(0.2, 3.0), 1), rng.randint(1, 4), area[a], area[b]) for a in range(20) for b in range(20, 40) if rng.random() < 0.12]
        df = spark.createDataFrame(links, "t int, src int, dst int, cost double, matched_points int, src_area int, dst_area int")
        got = {(r.src, r.dst) for r in tracking.rescue_links(df, tracking.select_links(df, cutoff, least), cutoff, least).collect()}
        ordered = [(r[1], r[2], r[3]) for r in sorted(links, key=lambda r: (r[3], -r[4], r[1], r[2]))]
        big = lambda i: area[i] > least
        want = {(a, b) for a, b, c in ordered if big(a) and big(b) and c <= cutoff}
        for free, lone in ((0, 1), (1, 0)):
            taken = {p[lone] for p in want}
            pool = [x for x in ordered if not big(x[free]) and big(x[lone]) and x[lone] not in taken]
            used, done = set(), set()
            for x in pool:
                if x[2] <= cutoff and x[free] not in used:
                    want.add(x[:2])
                    used.add(x[free])
                    done.add(x[lone])
            for x in pool:
                if x[lone] not in done and x[free] not in used:
                    want.add(x[:2])
                    used.add(x[free])
                    done.add(x[lone])
        sources, targets = {a for a, _ in want}, {b for _, b in want}
        for a, b, _ in ordered:
            if big(a) and big(b) and (a, b) not in want and (a not in sources or b not in targets):
                want.add((a, b))
                sources.add(a)
                targets.add(b)
        assert got == want


def test_connected_across_ranges(spark):
    """Random edges over many ranges and batches, with chains that wind through all ranges, against a plain search."""
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + 97 * i % 500, 1000 + 97 * (i + 1) % 500) for i in range(300)]
    root = {i: i for p in pairs for i in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    edges = spark.createDataFrame(pairs, "a int, b int").repartition(7)
    got = connected(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges)
    assert got.schema["root"].dataType.simpleString() == "int"
    assert {r.id: r.root for r in got.collect()} == root


def test_roots_of_a_range():
    """A range of edges is contracted in one call, to the least id of each part."""
    from voxelspark.operators.graph import roots_of

    ids, roots = roots_of(np.array([5, 9, 3, 8, 20]), np.array([9, 3, 7, 5, 21]))
    assert dict(zip(ids.tolist(), roots.tolist())) == {3: 3, 5: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20}


def test_lines_are_swept_in_slices(monkeypatch):
    """Memory follows some positions or one line, not the number of long lines in a batch."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    line = [[{"ny": int(p), "d2": float(rng.integers(0, 50))} for p in rng.permutation(40)[: rng.integers(1, 30)]] for _ in range(50)]
    at = [rng.permutation(40)[: rng.integers(1, 30)].tolist() for _ in line]
    batch = pa.RecordBatch.from_pylist([{"x": i, "line": a, "at": b} for i, (a, b) in enumerate(zip(line, at))], pa.schema([("x", pa.int32()), ("line", pa.list_(pa.struct([("ny", pa.int32()), ("d2", pa.float64())]))), ("at", pa.list_(pa.int32()))]))
    seen, plain = [], distance.lowest
    monkeypatch.setattr(distance, "lowest", lambda *a: seen.append(len(a[0]) + len(a[4])) or plain(*a))
    monkeypatch.setattr(distance, "_AT_ONCE", 100)
    out = pa.Table.from_batches(distance._swept(1, 2.0, ["x", "y", "d2", "ny"])(iter([batch]))).to_pylist()
    assert len(seen) > 1 and max(seen) <= 100
    got = {(r["x"], r["y"]): r["d2"] for r in out}
    assert got == {(i, y): min(p["d2"] + (2.0 * (p["ny"] - y)) ** 2 for p in line[i]) for i, ys in enumerate(at) for y in ys}
