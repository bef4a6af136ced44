"""Round trips and calibration of TIFF stacks."""

import numpy as np
import pytest

from voxelspark.sources import tiff


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32"])
def test_round_trip(spark, tmp_path, dtype):
    stack = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff.encode(stack))
    (tmp_path / "b.txt").write_text("not an image")
    rows = tiff.read_voxels(spark, str(tmp_path)).collect()
    assert {(r.z, r.y, r.x): r.value for r in rows} == {tuple(map(int, p)): float(stack[tuple(p)]) for p in np.argwhere(stack >= 0)}


def test_calibration(spark, tmp_path):
    text = "ImageJ=1.53\nimages=6\nframes=2\nslices=3\nunit=micron\nspacing=0.2\nfinterval=72.579\n"
    (tmp_path / "a.tif").write_bytes(tiff.encode(np.zeros((6, 8, 9), np.uint16), text, (9087619, 1000000)))
    r = tiff.read_catalogue(spark, str(tmp_path)).head()
    assert (r.dims, r.nt, r.nc, r.nz, r.ny, r.nx, r.sz, r.time_interval) == ("TZYX", 2, 1, 3, 8, 9, 0.2, 72.579)
    assert r.sx == pytest.approx(1000000 / 9087619) and not r.assumed
    layers = tiff.layers(tiff.read_voxels(spark, str(tmp_path))).collect()
    assert [(x.c, x.dims) for x in layers] == [(0, "TZYX")]


@pytest.mark.parametrize("order,places", [("XYCZT", "tzc"), ("XYTZC", "czt")])
def test_ome_orders(order, places):
    xml = f'<OME xmlns="x"><Image><Pixels DimensionOrder="{order}" SizeT="2" SizeC="3" SizeZ="4" PhysicalSizeX="110" PhysicalSizeXUnit="nm" PhysicalSizeZ="0.2" TimeIncrement="2" TimeIncrementUnit="min"/></Image></OME>'
    info = tiff.layout([{tiff.DESCRIPTION: xml}] * 24)
    assert (info["order"], info["nt"], info["nc"], info["nz"], info["interval"]) == (places, 2, 3, 4, 120.0)
    assert info["sx"] == pytest.approx(0.11) and info["sz"] == 0.2
    assert tiff.ome("<OME") == {}


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"II*\0\xff\xff\xff\x7f")
    (tmp_path / "b.tif").write_bytes(b"nothing")
    rows = tiff.read_catalogue(spark, str(tmp_path)).collect()
    assert all(r.error and r.nt is None for r in rows) and len(rows) == 2
