"""Skeletons of objects, on tiles of the image with a border from the tiles around them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Edge of a tile in voxels, and the passes over a tile before its border is renewed, for plane images and volumes.
PLANE, VOLUME = (128, 4), (32, 1)


@lru_cache(maxsize=2)
def _around(planar: bool) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int, int]:
    """Steps to the neighbours (across faces, edges and corners), which of them touch each other, which share a face, and the masks of those at faces and of all but corners."""
    steps = [o for o in product((0,) if planar else (-1, 0, 1), (-1, 0, 1), (-1, 0, 1)) if any(o)]
    far = lambda a, b: [abs(p - q) for p, q in zip(a, b)]
    touch = np.array([sum(1 << j for j, b in enumerate(steps) if a != b and max(far(a, b)) == 1) for a in steps], np.uint32)
    inner = [sum(map(abs, o)) < 3 for o in steps]
    face = np.array([sum(1 << j for j, b in enumerate(steps) if sum(far(a, b)) == 1 and inner[j]) for a in steps], np.uint32)
    at_faces = sum(1 << j for j, o in enumerate(steps) if sum(map(abs, o)) == 1)
    return steps, touch, face, at_faces, sum(1 << j for j, i in enumerate(inner) if i)


def _flooded(start: np.ndarray, room: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Bits of room that can be reached from the bits of start."""
    while True:
        grown = start.copy()
        for i, mask in enumerate(beside):
            grown |= np.where(start >> np.uint32(i) & np.uint32(1), mask, np.uint32(0)) & room
        if (grown == start).all():
            return start
        start = grown


def simple(code: np.ndarray, planar: bool) -> np.ndarray:
    """Whether a voxel can go without a change of topology, by the bits of its neighbours.

    Its neighbours hang together without it, and so does the background at its faces.
    """
    _, touch, face, at_faces, near = _around(planar)
    lowest = lambda x: x & (~x + np.uint32(1))
    some, place = np.unique(code.astype(np.uint32), return_inverse=True)
    whole = (some != 0) & (_flooded(lowest(some), some, touch) == some)
    open_ = ~some & np.uint32(near)
    faces = open_ & np.uint32(at_faces)
    whole &= (faces != 0) & ((_flooded(lowest(faces), open_, face) & faces) == faces)
    return whole[place]


def passes(image: np.ndarray, first: tuple[int, int, int], planar: bool, most: int | None = None) -> np.ndarray:
    """A label image after so many passes (until nothing changes, if None); first: coordinates of its first voxel.

    A pass goes through the classes of voxels that agree in the parity of their coordinates.  No two voxels of a class are neighbours, so all those of a class
    that were at the border when the pass began, can go and are no ends of lines, go at once, as if one after the other.
    """
    work = np.pad(image, 1)
    steps, *_, at_faces, _ = _around(planar)
    shape = work.shape
    flat = work.ravel()
    offset = [(dz * shape[1] + dy) * shape[2] + dx for dz, dy, dx in steps]
    passed = 0
    while most is None or passed < most:
        own = np.flatnonzero(flat)
        code = lambda at: np.bitwise_or.reduce([(flat[at + o] == flat[at]).astype(np.uint32) << np.uint32(i) for i, o in enumerate(offset)]) if len(at) else np.empty(0, np.uint32)
        border = own[(~code(own) & np.uint32(at_faces)) != 0]
        z, y, x = np.unravel_index(border, shape)
        parity = ((z - 1 + first[0]) % 2 * (0 if planar else 4)) + (y - 1 + first[1]) % 2 * 2 + (x - 1 + first[2]) % 2
        gone = 0
        for k in range(4 if planar else 8):
            at = border[parity == k]
            bits = code(at)
            drop = at[(np.bitwise_count(bits) > 1) & simple(bits, planar)] if len(at) else at
            flat[drop] = 0
            gone += len(drop)
        passed += 1
        if not gone:
            break
    return flat.reshape(shape)[1:-1, 1:-1, 1:-1]


def _tile(planar: bool, edge: int, most: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # Tiles of a plane image are told apart by their plane.
        corner = [key[1].as_py() * (1 if planar else edge), key[2].as_py() * edge, key[3].as_py() * edge]
        size = [1 if planar else edge, edge, edge]
        at = [rows.column(c).to_numpy() for c in "zyx"]
        first = [int(a.min()) for a in at]
        image = np.zeros([int(a.max()) - f + 1 for a, f in zip(at, first)], np.int64)
        # Objects are told apart by their order here, since any integer may be a label.
        names, own = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        image[tuple(a - f for a, f in zip(at, first))] = own + 1
        left = passes(image, tuple(first), planar, most)
        inside = tuple(slice(max(0, c - f), max(0, c + n - f)) for c, n, f in zip(corner, size, first))
        found = np.argwhere(left[inside])
        label = names[left[inside][tuple(found.T)] - 1]
        kind = {f.name: f.type for f in rows.schema}
        place = [pa.array(found[:, i] + max(f, c), kind[n]) for i, (n, f, c) in enumerate(zip("zyx", first, corner))]
        return pa.table({"t": pa.array([key[0].as_py()] * len(found), kind["t"]), "label": pa.array(label, kind["label"]), **dict(zip("zyx", place))})

    return run


def skeletons(labels: DataFrame, planar: bool = False, tile: tuple[int, int] | None = None) -> DataFrame:
    """(t, label, z, y, x) of the skeletons of all objects (t, label, z, y, x): lines that keep each object's parts, holes and cavities, and the ends of its lines.

    The image is cut into tiles; each gets a border from the tiles around it, as wide as what happens outside can reach in the passes that are made, so the
    result doesn't depend on the tiles.  Borders are renewed until no voxel goes.  A task holds one tile.  Voxels of other objects are background.
    planar: planes are images of their own.  tile: edge, and passes between renewals.  A voxel that several objects claim belongs to the least.
    """
    edge, most = tile or (PLANE if planar else VOLUME)
    # In a pass voxels look at their neighbours once and then once for each class.
    reach = most * (5 if planar else 9)
    axes = "yx" if planar else "zyx"
    kinds = {f.name: f.dataType.simpleString() for f in labels.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("t", "label", "z", "y", "x"))
    left = cut(labels.groupBy("t", "z", "y", "x").agg(F.min("label").alias("label")).select("t", "label", "z", "y", "x"))
    n = left.count()
    while n:
        rows = left.select("*", *([F.col("z").alias("tz")] if planar else []))
        for c in axes:
            rows = rows.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge))))
        after = cut(rows.groupBy("t", "tz", "ty", "tx").applyInArrow(_tile(planar, edge, most), schema))
        before, n, left = n, after.count(), after
        if n == before:
            break
    return left
