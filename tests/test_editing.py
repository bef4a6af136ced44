"""Any sequence of edits gives what a rebuild from the edited links gives, and leaves other frame pairs alone."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from voxelspark.operators import editing, tracking

LINK = "t int, src long, dst long, cost double, matched_points double, src_area long, dst_area long, selected boolean"


def _movie(spark, seed):
    rng = random.Random(seed)
    dets, at = [], {}
    for t in range(6):
        at[t] = range(len(dets), len(dets) + rng.randint(3, 6))
        dets += [(i, t, rng.randint(1, 5)) for i in at[t]]
    area = {i: a for i, _, a in dets}
    links = [(t, a, b, rng.random(), float(rng.randint(1, 3)), area[a], area[b], rng.random() < 0.4) for t in range(5) for a in at[t] for b in at[t + 1] if rng.random() < 0.6]
    return spark.createDataFrame(dets, "det_id long, t int, area long"), links, area, at


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_edits_equal_a_rebuild(spark, tmp_path):
    dets, links, _, _ = _movie(spark, 3)
    rng = random.Random(8)
    table = f"{tmp_path}/links"
    spark.createDataFrame(links, LINK).write.partitionBy("t").parquet(table)
    now = spark.createDataFrame([r for r in links if r[-1]], LINK)
    events, ancestors = tracking.events(dets, now, 0.3, 2), editing.ancestry(dets, now)
    picked = {r[1:3]: r[-1] for r in links}
    for step in range(2):
        some = rng.sample(sorted(r[:3] for r in links if r[0] in (1, 2 + step)), 3)
        edits = [(k, a, b, rng.random() < 0.5) for k, (_, a, b) in enumerate(some + some[:2])]
        picked |= {(a, b): w for _, a, b, w in edits}
        # The other partitions can't be read.
        for p in Path(table).glob("t=*"):
            if p.name not in ("t=1", f"t={2 + step}"):
                p.rename(f"{tmp_path}/away-{p.name}")
                p.mkdir()
                (p / "part-broken.parquet").write_bytes(b"no parquet")
        got = editing.refine(dets, spark.read.schema(LINK).parquet(table), spark.createDataFrame(edits, "seq int, src long, dst long, selected boolean"), events, ancestors, 0.3, 2)
        got.links.write.partitionBy("t").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)
        for p in Path(table).glob("t=*/part-broken.parquet"):
            p.unlink()
            p.parent.rmdir()
            Path(f"{tmp_path}/away-{p.parent.name}").rename(p.parent)
        events, ancestors = got.events, got.ancestry
        want = [r for r in links if picked[r[1:3]]]
        again = spark.createDataFrame(want, LINK)
        assert sorted(r.src for r in spark.read.parquet(table).where("selected").collect()) == sorted(r[1] for r in want)
        assert _rows(events) == _rows(tracking.events(dets, again, 0.3, 2))
        assert _rows(ancestors) == _rows(editing.ancestry(dets, again))
        assert _rows(editing.lineage_ids(ancestors)) == _rows(tracking.lineages(dets, tracking.dominant_parents(again)))


def test_faults(spark):
    dets, links, _, at = _movie(spark, 5)
    table = spark.createDataFrame(links, LINK)
    edit = lambda a, b: editing.refine(dets, table, spark.createDataFrame([(0, a, b, True)], "seq int, src long, dst long, selected boolean"), tracking.events(dets, table, 0.3, 2), editing.ancestry(dets, table), 0.3, 2)
    missing = next((a, b) for a in at[0] for b in at[1] if (a, b) not in {r[1:3] for r in links})
    with pytest.raises(ValueError, match="no candidate link"):
        edit(*missing)
    with pytest.raises(Exception, match="next frame"):
        edit(at[0][0], at[2][0])
    with pytest.raises(Exception, match="unknown object"):
        edit(at[0][0], 9999)


def test_manual_links(spark):
    rng = np.random.default_rng(1)
    points = {1: rng.integers(0, 6, (20, 3)), 2: rng.integers(2, 9, (15, 3)), 3: rng.integers(0, 9, (1, 3))}
    center = {k: p.mean(0) for k, p in points.items()}
    dets = spark.createDataFrame([(k, len(p), *map(float, center[k])) for k, p in points.items()], "det_id long, area long, cz double, cy double, cx double")
    held = spark.createDataFrame([(k, *map(int, v)) for k, p in points.items() for v in p], "det_id long, z int, y int, x int")
    pairs = spark.createDataFrame([(0, 1, 2), (0, 1, 3)], "t int, src long, dst long")
    spacing = (4.0, 1.0, 2.0)
    config = tracking.TrackingConfig(max_distance=10.0)
    scale = np.array(spacing) / 2.0
    for r in editing.manual_links(pairs, dets, held, config, spacing).collect():
        a, b = points[r.src] * scale, points[r.dst] * scale
        moved = a + b.mean(0) - a.mean(0)
        forth, back = ([min(math.dist(p, q) for q in other) for p in own] for own, other in ((moved, b), (b, moved)))
        share = lambda d: sum(x <= scale.min() for x in d)
        overlap, matched = 0.5 * (share(forth) / len(a) + share(back) / len(b)), 0.5 * (share(forth) + share(back))
        gap = math.dist(center[r.src] * scale, center[r.dst] * scale)
        cost = 0.2 * gap / 10 + 0.8 * (1 - overlap) + (1 - min(matched / min(len(a), len(b), 3), 1))
        assert (r.distance, r.overlap, r.matched_points, r.cost) == pytest.approx((gap, overlap, matched, cost))
        assert r.nearest == pytest.approx(min(forth + back)) and r.average == pytest.approx(float(np.mean(forth + back))) and r.area_ratio == pytest.approx(abs(len(a) - len(b)) / max(len(a), len(b)))
