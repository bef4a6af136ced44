"""The proximity result against brute force on small grids."""

import math
from collections import Counter
from itertools import product
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators.numbering import numbered
from voxelspark.operators.proximity_result import COMPONENTS, SUMMARY, proximity_result

SIZE = {"z": 2.0, "y": 0.5, "x": 1.0}
ROIS = [(1, "left", -1, [(-0.5, -0.5), (-0.5, 2.5), (6.5, 2.5), (6.5, -0.5)]), (2, "one frame", 1, [(0.5, 0.5), (0.5, 5.5), (4.5, 5.5), (4.5, 0.5)]), (3, "line", -1, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
ROI_SCHEMA = "roi_id int, roi_name string, frame int, vertices array<struct<y double, x double>>"


def _frame(spark, voxels, kind="long"):
    rows = [(*p, *v) if isinstance(v, tuple) else (*p, v) for p, v in voxels.items()]
    return spark.createDataFrame(rows, f"t int, z int, y int, x int, value long{', label ' + kind if rows and len(rows[0]) == 6 else ''}")


def _steps():
    return [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _faces(mask, p):
    area = [SIZE["y"] * SIZE["x"], SIZE["z"] * SIZE["x"], SIZE["z"] * SIZE["y"]]
    return sum(area[[bool(c) for c in s].index(True)] for s in _steps() if (p[0], p[1] + s[0], p[2] + s[1], p[3] + s[2]) not in mask)


def _distance(p, mask):
    near = [sum(((a - b) * s) ** 2 for a, b, s in zip(p[1:], q[1:], SIZE.values(), strict=True)) for q in mask if q[0] == p[0]]
    return float(np.float32(math.sqrt(min(near)))) if near else math.inf


def _expected(source, target, inside, roi_size, threshold, surface):
    out, unit = {"roi_size": roi_size, "roi_size_physical": roi_size * 1.0}, 1.0
    s, g = ({p: v for p, v in m.items() if inside(p)} for m in (source, target))
    both = s.keys() & g.keys()
    out |= {"source_size": len(s), "target_size": len(g), "overlap_size": len(both), "overlap_size_physical": len(both) * unit}
    for name, i, own, whole, other in (("source", 1, s, source, target), ("target", 2, g, target, source)):
        basis = {p for p in own if not surface or _faces(whole, p) > 0}
        far = {p: _distance(p, other) for p in basis}
        near = {p for p in basis if far[p] <= threshold}
        total = lambda ps: sum(own[p] for p in ps)  # noqa: B023, E731
        finite = [d for d in far.values() if math.isfinite(d)]
        out |= {
            f"{name}_proximity_size": len(near), f"{name}_proximity_size_physical": sum(_faces(whole, p) if surface else unit for p in near), f"{name}_proximity_fraction": len(near) / len(basis) if basis else 0.0,
            f"proximity_manders_m{i}": total(near) / total(basis) if total(basis) > 0 else 0.0, f"manders_m{i}": total(both) / total(own) if total(own) > 0 else 0.0,
            f"{name}_mean_distance": sum(finite) / len(finite) if finite else math.nan, f"{name}_median_distance": median(finite) if finite else math.nan,
        }
    union = len(s.keys() | g.keys())
    return out | {"dice": 2 * len(both) / (len(s) + len(g)) if s or g else 0.0, "jaccard": len(both) / union if union else 0.0}


def _parts(mask):
    left, out = set(mask), []
    while left:
        start = min(left)
        todo, part = [start], {start}
        left.discard(start)
        while todo:
            p = todo.pop()
            for s in _steps():
                q = (p[0], p[1] + s[0], p[2] + s[1], p[3] + s[2])
                if q in left:
                    left.discard(q)
                    part.add(q)
                    todo.append(q)
        out.append(part)
    return out


def _channels(seed, shape):
    rng = np.random.default_rng(seed)
    return [{p: int(rng.integers(1, 50)) for p in product(*map(range, shape)) if rng.random() < share} for share in (0.6, 0.3)]


def _same(row, want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, rel=1e-9, nan_ok=True), k


@pytest.mark.parametrize("surface", [True, False])
def test_full_image(spark, surface):
    shape = (2, 3, 5, 6)
    source, target = _channels(1, shape)
    # A frame without target.
    target = {p: v for p, v in target.items() if p[0] == 0}
    found = proximity_result(_frame(spark, source), _frame(spark, target), shape, voxel_size=tuple(SIZE.values()), threshold=0.5, surface_only=surface)
    assert found.summary.columns[: len(SUMMARY)] == list(SUMMARY)
    row = found.summary.collect()
    assert [(r.roi_id, r.roi_name, r.frame) for r in row] == [(1, "Full image", -1)]
    _same(row[0], _expected(source, target, lambda p: True, math.prod(shape), 0.5, surface))
    parts = [part for t in range(2) for part in _parts({p for p in source if p[0] == t})]
    label = {p: i for i, part in enumerate(parts, 1) for p in part}
    close = [p for p in target if (not surface or _faces(target, p) > 0) and _distance(p, source) <= 0.5]
    owner = {p: label[min((sum(((a - b) * s) ** 2 for a, b, s in zip(p[1:], q[1:], SIZE.values(), strict=True)), q) for q in source if q[0] == p[0])[1]] for p in close}
    near = Counter(owner.values())
    order = sorted(range(1, len(parts) + 1), key=lambda i: (-len(parts[i - 1]), i))
    assert found.components.columns == list(COMPONENTS)
    rows = sorted(found.components.collect(), key=lambda r: r.global_component_id)
    assert [(r.frame, r.component_id, r.global_component_id, r.size, r.source_label, r.source_size) for r in rows] == [(-1, i, n, near[i], i, len(parts[i - 1])) for n, i in enumerate(order, 1)]
    assert sum(r.size_physical for r in rows) == pytest.approx(row[0].target_proximity_size_physical)
    number = {i: n for n, i in enumerate(order, 1)}
    assert {(r.t, r.z, r.y, r.x): r.global_component_id for r in found.labels.collect()} == {p: number[i] for p, i in owner.items()}
    flags = {(r.t, r.z, r.y, r.x): (r.source, r.target, r.target_near) for r in found.voxels.collect()}
    assert flags == {p: (p in source, p in target, p in owner) for p in source.keys() | target.keys()}


def test_regions(spark):
    shape = (2, 2, 6, 7)
    source, target = _channels(2, shape)
    found = proximity_result(_frame(spark, source), _frame(spark, target), shape, spark.createDataFrame(ROIS, ROI_SCHEMA), tuple(SIZE.values()), threshold=1.0)
    rows = {r.roi_id: r for r in found.summary.collect()}
    inside = {1: lambda p: p[3] <= 2, 2: lambda p: p[0] == 1 and 1 <= p[2] <= 4 and 1 <= p[3] <= 5}
    assert rows.keys() == inside.keys()
    sizes = {i: sum(map(f, product(*map(range, shape)))) for i, f in inside.items()}
    want, number = [], 0
    for i, f in inside.items():
        _same(rows[i], _expected(source, target, f, sizes[i], 1.0, True))
        near = {p for p in target if f(p) and _faces(target, p) > 0 and _distance(p, source) <= 1.0}
        for t in range(2):
            for k, part in enumerate(_parts({p for p in near if p[0] == t}), 1):
                number += 1
                want.append((i, t, k, number, len(part), pytest.approx(sum(_faces(target, p) for p in part)), 0, 0, 0.0))
    assert sorted((tuple(r) for r in found.components.collect()), key=lambda r: r[3]) == want


def test_large_ids_are_kept(spark):
    small = {(0, 0, y, x): 1 for y, x in product((1, 2), (1, 2))} | {(0, 0, y, x): 2 for y, x in product((6, 7), (7, 8))}
    target = _frame(spark, dict.fromkeys(small, 1))
    for ids in ((1, 2), (2**63 + 1, 2**64 - 1)):
        source = _frame(spark, dict.fromkeys(small, 1)).join(spark.createDataFrame([(*p, str(ids[i - 1])) for p, i in small.items()], "t int, z int, y int, x int, label string"), ["t", "z", "y", "x"])
        source = source.withColumn("label", F.col("label").cast("decimal(20,0)"))
        rows = proximity_result(source, target, (1, 1, 10, 12), axes=("y", "x"), surface_only=False, threshold=0).components.orderBy("global_component_id").collect()
        assert [(int(r.source_label), int(r.component_id), r.size, r.source_size) for r in rows] == [(i, i, 4, 4) for i in ids]


def test_empty_masks_have_undefined_distances(spark):
    none = spark.createDataFrame([], "t int, z int, y int, x int, value long")
    found = proximity_result(none, none, (2, 1, 8, 9), axes=("y", "x"))
    row = found.summary.collect()[0]
    assert (row.roi_size, row.source_size, row.dice, row.manders_m1, row.target_proximity_fraction) == (144, 0, 0.0, 0.0, 0.0)
    assert math.isnan(row.source_mean_distance) and math.isnan(row.target_median_distance)
    assert not found.components.head(1) and not found.labels.head(1)


def test_numbers_follow_the_order_over_partitions(spark):
    rows = numbered(spark.range(5000).selectExpr("id", "id * 7919 % 5000 AS k").repartition(7), ["k"], "n")
    assert [r.n for r in rows.orderBy("k").collect()] == list(range(1, 5001))
