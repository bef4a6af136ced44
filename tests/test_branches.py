"""Branch tracing, pruning and contraction against a plain tracer."""

import math
import random
from collections import defaultdict
from itertools import product

import pytest

from voxelspark.operators import branches

ROW = "t int, label int, branch_id long, start_node long, start_kind string, end_node long, end_kind string, length double, points long"


def near(p, points):
    """Neighbours of a voxel but for diagonals with a voxel on a shorter way."""
    out = []
    for o in product((-1, 0, 1), repeat=3):
        q = tuple(a + b for a, b in zip(p, o))
        if any(o) and q in points:
            ways = [tuple(a + b * k for a, b, k in zip(p, o, keep)) for keep in product((0, 1), repeat=3)]
            if not any(w in points for w in ways if w not in (p, q)):
                out.append(q)
    return out


def touching(points):
    """The least voxel of each voxel's part, across faces, edges and corners."""
    left, out = set(points), {}
    while left:
        todo, part = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                part.add(p)
                todo += [tuple(a + b for a, b in zip(p, o)) for o in product((-1, 0, 1), repeat=3)]
        out |= dict.fromkeys(part, min(part))
    return out


def plain(points, spacing):
    """Branches of one object: (start, kind, end, kind, length, voxels in order), by walking along."""
    around = {p: near(p, points) for p in points}
    kind = {p: "endpoint" if len(n) == 1 else "junction" for p, n in around.items() if len(n) == 1 or len(n) > 2}
    node = {p: (k, first) for k in ("endpoint", "junction") for p, first in touching({p for p in points if kind.get(p) == k}).items()}
    step = lambda p, q: math.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(p, q, spacing)))
    found, direct = {}, defaultdict(list)
    for p in sorted(node):
        for q in around[p]:
            path = [p, q]
            while path[-1] not in node:
                path.append(next(n for n in around[path[-1]] if n != path[-2]))
            if node[p] != node[path[-1]] or len(path) > 2:
                length = sum(step(a, b) for a, b in zip(path, path[1:]))
                if len(path) == 2:
                    direct[tuple(sorted((node[p], node[q])))].append((length, path))
                else:
                    found[min(tuple(path), tuple(path[::-1]))] = length
    out = [(node[k[0]], node[k[-1]], length, k) for k, length in found.items()]
    out += [(*ends, *min((length, min(path, path[::-1])) for length, path in options)) for ends, options in direct.items()]
    if not node:
        left = {p for p in points if len(around[p]) == 2}
        while left:
            path = [min(left)]
            path.append(min(around[path[0]]))
            while path[-1] != path[0]:
                path.append(next(n for n in around[path[-1]] if n != path[-2]))
            left -= set(path)
            out.append((None, None, sum(step(a, b) for a, b in zip(path, path[1:])), tuple(path)))
    return out


def _skeletons(seed):
    """Voxels of several objects: random ones, and some with rings, lines and single voxels."""
    rng = random.Random(seed)
    out = {(t, k): {p for p in product(range(5), range(6), range(7)) if rng.random() < share} for t, k, share in ((0, 1, 0.12), (0, 2, 0.3), (3, 1, 0.2), (4, 9, 0.6))}
    ring = {(1, y, x) for y in range(6) for x in range(6) if y in (0, 5) or x in (0, 5)} - {(1, 0, 0), (1, 5, 5)}
    out |= {(5, 1): ring, (5, 2): ring | {(1, 0, k) for k in range(6, 12)}, (5, 3): {(0, 0, k) for k in range(40)}, (5, 4): {(3, 3, 3)}, (5, 5): {(0, 0, 0), (0, 1, 1)}, (5, 6): ring | {(5, y + 20, x) for _, y, x in ring}}
    taken = set()
    for key in sorted(out):
        # A voxel belongs to one object; objects of the last frame lie apart.
        shift = 30 * key[1] if key[0] == 5 else 0
        out[key] = {(z, y + shift, x) for z, y, x in out[key]} - {p[1:] for p in taken if p[0] == key[0]}
        taken |= {(key[0], *p) for p in out[key]}
    return out


def _frame(spark, objects):
    return spark.createDataFrame([(*k, *p) for k, ps in objects.items() for p in ps], "t int, label int, z int, y int, x int")


SPACING = (2.0, 1.0, 0.5)


@pytest.mark.parametrize("seed", [1])
def test_branches(spark, seed):
    objects = _skeletons(seed)
    got = branches.trace(_frame(spark, objects), SPACING)
    at = defaultdict(dict)
    for r in got.points.collect():
        at[r.branch_id][r.position] = ((r.z, r.y, r.x), r.distance)
    nodes = {(r.t, r.label, r.z, r.y, r.x): r.node for r in got.nodes.collect()}
    seen = defaultdict(list)
    for r in got.rows.collect():
        path = [at[r.branch_id][i] for i in range(r.points)]
        places = [p for p, _ in path]
        assert len(at[r.branch_id]) == r.points and path[0][1] == 0 and path[-1][1] == pytest.approx(r.length)
        assert all(d2 - d1 == pytest.approx(math.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(p, q, SPACING)))) for (p, d1), (q, d2) in zip(path, path[1:]))
        assert (r.start_node, r.end_node) == (nodes.get((r.t, r.label, *places[0])), nodes.get((r.t, r.label, *places[-1])))
        seen[(r.t, r.label)].append((tuple(sorted((r.start_kind or "", r.end_kind or ""))), round(r.length, 6), min(tuple(places), tuple(places[::-1])) if r.points > 2 else ()))
    want = {}
    for key, points in objects.items():
        if rows := plain(points, SPACING):
            want[key] = sorted((tuple(sorted((a[0] if a else "", b[0] if b else ""))), round(length, 6), min(tuple(path), tuple(path[::-1])) if len(path) > 2 else ()) for a, b, length, path in rows)
    assert {k: sorted(v) for k, v in seen.items()} == want
    assert len(want[(5, 1)]) == 1 and len(want[(5, 6)]) == 2 and (5, 4) not in want and (5, 5) not in want
    # Numbers and totals of the same rows.
    numbers = defaultdict(list)
    for r in branches.table(got.rows).collect():
        numbers[r.frame].append((r.object_label, r.object_branch_index, r.branch_index, -r.branch_length))
    for t, rows in numbers.items():
        rows.sort()
        assert [n for _, _, n, _ in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: (r[0], r[3], r[1]))
        assert len(rows) == sum(len(v) for k, v in want.items() if k[0] == t)
    for r in branches.totals(got.rows).collect():
        own = plain(objects[(r.t, r.label)], SPACING)
        ends = defaultdict(int)
        for a, b, *_ in own:
            for e in (a, b):
                if e:
                    ends[e] += 1
        assert (r.branch_number, r.endpoint_number, r.junction_number) == (len(own), sum(n == 1 for n in ends.values()), sum(n > 2 for e, n in ends.items() if e[0] == "junction"))
        assert r.total_branch_length == pytest.approx(sum(x[2] for x in own)) and r.mean_branch_length == pytest.approx(sum(x[2] for x in own) / len(own))


def test_no_branches(spark):
    empty = spark.createDataFrame([], "t int, label int, z int, y int, x int")
    got = branches.trace(empty)
    assert got.rows.count() == got.points.count() == got.nodes.count() == 0
    assert branches.table(got.rows).count() == branches.totals(got.rows).count() == branches.contract(got.rows).count() == 0


def merged(rows):
    """Contraction one junction at a time, the greatest of a ring last; rows of (start, kind, end, kind, length)."""
    rows = list(rows)
    while True:
        at = defaultdict(list)
        for i, (a, ka, b, kb, _) in enumerate(rows):
            at[(a, ka)].append(i)
            at[(b, kb)].append(i)
        ripe = sorted(n for n, i in at.items() if n[1] == "junction" and len(i) == 2 and i[0] != i[1])
        if not ripe:
            return sorted((*sorted(((a, ka), (b, kb))), round(length, 6)) for a, ka, b, kb, length in rows)
        node, (i, j) = ripe[0], at[ripe[0]]
        ends = [e for k in (i, j) for e in (rows[k][:2], rows[k][2:4]) if e != node]
        length = rows[i][4] + rows[j][4]
        rows = [r for k, r in enumerate(rows) if k not in (i, j)] + [(*ends[0], *ends[1], length)]


@pytest.mark.parametrize("seed", [2])
def test_contraction(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        a, b = rng.sample(range(14), 2) if rng.random() < 0.9 else [rng.randrange(14)] * 2
        rows.append((a, "junction" if a else "endpoint", b, "junction" if b else "endpoint", float(rng.randint(1, 9))))
    rows += [(100, "junction", 101, "junction", 1.0), (101, "junction", 102, "junction", 2.0), (102, "junction", 100, "junction", 4.0), (200, "junction", 201, "junction", 1.0), (201, "junction", 200, "junction", 2.0)]
    chain = [(1000 + i, "endpoint" if i == 0 else "junction", 1001 + i, "endpoint" if i == 999 else "junction", 0.5) for i in range(1000)]
    df = spark.createDataFrame([(0, 1, i, *r, 2) for i, r in enumerate(rows + chain)], ROW)
    got = branches.contract(df)
    assert sorted((*sorted(((r.start_node, r.start_kind), (r.end_node, r.end_kind))), round(r.length, 6)) for r in got.collect()) == merged(rows + chain)
    long = got.where("length = 500").collect()
    assert len(long) == 1 and {long[0].start_node, long[0].end_node} == {1000, 2000}


def test_pruning_and_contraction(spark):
    """A line with short and long side branches: the short ones go, and the line is one branch between the long ones."""
    line = {(0, 10, x) for x in range(60)}
    for at, n in ((10, 2), (20, 6), (30, 2), (34, 3), (45, 1)):
        line |= {(0, 10 + k, at) for k in range(1, n + 1)}
    rows = branches.simplified(_frame(spark, {(0, 1): line}), (1.0, 1.0, 1.0), False, 3.0).collect()
    assert len(rows) == 3 and [round(r.length) for r in sorted(rows, key=lambda r: r.length)] == [6, 20, 39]
    kept = branches.simplified(_frame(spark, {(0, 1): line, (0, 2): {(4, 0, 0)}}), (1.0, 1.0, 1.0), False, None).collect()
    assert len(kept) > 6 and {r.label for r in kept} == {1}
