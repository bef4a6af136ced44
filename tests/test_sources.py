"""Exports and bounded metadata."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from voxelspark.sources import clx, export


def item(kind, name, body):
    encoded = (name + "\0").encode("utf-16-le")
    return bytes([kind, len(encoded) // 2]) + encoded + body


def level(name, *items):
    inner = b"".join(items)
    head = len(item(clx.LEVEL, name, b"")) + 12
    return item(clx.LEVEL, name, struct.pack("<IQ", len(items), head + len(inner))) + inner + b"\0" * (8 * len(items))


def test_metadata():
    raw = level("root", item(clx.INT32, "a", struct.pack("<i", 7)), level("in", item(clx.DOUBLE, "dCalibration", struct.pack("<d", 0.13))), item(clx.TEXT, "s", "hi\0".encode("utf-16-le")))
    tree = clx.decode(raw)
    assert tree["root"]["a"] == 7 and tree["root"]["s"] == "hi" and clx.calibration(tree) == 0.13
    packed = bytes([clx.PACKED, 0]) + b"\0" * 10 + zlib.compress(raw)
    assert clx.decode(packed) == tree
    with pytest.raises(clx.InvalidMetadata):
        clx.decode(bytes([clx.PACKED, 0]) + b"\0" * 10 + zlib.compress(b"\0" * 100_000), budget=clx.Budget(bytes=1024))
    with pytest.raises(clx.InvalidMetadata):
        clx.decode(raw, budget=clx.Budget(items=2))
    with pytest.raises(clx.InvalidMetadata):
        clx.decode(raw[:20])
    deep = item(clx.INT32, "x", struct.pack("<i", 1))
    for _ in range(clx.MOST_DEPTH + 2):
        deep = level("l", deep)
    with pytest.raises(clx.InvalidMetadata):
        clx.decode(deep)


def test_short_numbers(spark):
    values = [0.0, 1.5, -2.0, 123456.7, 1234567.0, 0.0001234567, 0.00001234, 999999.5, 1e-300, 3.14159265, 100000.0, float("inf"), float("nan"), -0.5]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(export.short(F.col("v")).alias("s")).collect()]
    want = [f"{v:.6g}" for v in values]
    assert [float(g) if not math.isnan(float(w)) else w for g, w in zip(got, want)] == [float(w) if not math.isnan(float(w)) else w for w in want]
    assert [g for g, w in zip(got, want) if "e" not in w] == [w for w in want if "e" not in w]


def test_event_tables(spark, tmp_path):
    rows = spark.createDataFrame([("fission", 1, 2, [1], [2, 3]), ("birth", 2, 2, [], [4]), ("death", 9, 9, [5], [])], "kind string, frame_from int, frame_to int, sources array<long>, targets array<long>")
    export.write_events(rows, str(tmp_path / "e"), 0, 5, ["fission", "birth", "death"])
    got = {tuple(r) for r in export.read_events(spark, str(tmp_path / "e")).collect()}
    assert got == {("fission", 1, 2, 1, 2), ("fission", 1, 2, 1, 3), ("birth", 2, 2, None, 4)}
    export.write_table(spark.createDataFrame([(1, 2.5, 0)], "label int, area double, _hidden int"), str(tmp_path / "t"), headers={"area": "area ({unit}^2)"})
    assert (tmp_path / "t").exists()
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert set(text.splitlines()) == {"label,area (um^2)", "1,2.5"}
