"""Reading TIFF stacks into voxels with Spark's binary reader: own decoder of baseline and deflated files."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MICROMETRES, SECONDS

SUFFIXES = "*.{tif,tiff,TIF,TIFF}"
# Tags and type sizes of the format.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, XRES, YRES, UNIT, PREDICTOR, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 282, 283, 296, 317, 339


def pages(raw: bytes) -> list[dict[int, object]]:
    """The tags of each page of a classic or large file; values are numbers, tuples, text or (numerator, denominator)."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    out: list[dict[int, object]] = []
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        at += 8 if big else 2
        tags: dict[int, object] = {"order": order}  # type: ignore[dict-item]
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, at + i * (20 if big else 12))
            inline = at + i * (20 if big else 12) + (12 if big else 8)
            size = _SIZES.get(kind, 0) * count
            if not size:
                continue
            place = inline if size <= (8 if big else 4) else struct.unpack_from(order + ("Q" if big else "I"), raw, inline)[0]
            if place + size > len(raw):
                raise ValueError("truncated TIFF file")
            if kind in (2, 7):
                value: object = raw[place : place + size].split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw[place : place + size]
            elif kind in (5, 10):
                parts = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw, place)
                value = (parts[0], parts[1])
            else:
                parts = struct.unpack_from(f"{order}{count}{_CODES[kind]}", raw, place)
                value = parts[0] if count == 1 else parts
            tags[tag] = value
        out.append(tags)
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at + n * (20 if big else 12))[0]
    return out


def decode(raw: bytes, tags: Mapping[int, object]) -> np.ndarray:
    """The samples of a page: rows x columns, or rows x columns x samples."""
    many = lambda v: v if isinstance(v, tuple) else (v,)
    height, width, samples = int(tags[HEIGHT]), int(tags[WIDTH]), int(tags.get(SAMPLES, 1))
    bits = many(tags.get(BITS, 1))[0]
    kind = {1: "u", 2: "i", 3: "f"}[many(tags.get(FORMAT, 1))[0]]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample are not supported")
    compression = int(tags.get(COMPRESSION, 1))
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression} is not supported")
    parts = []
    for start, size in zip(many(tags[OFFSETS]), many(tags[COUNTS]), strict=True):
        strip = raw[start : start + size]
        parts.append(strip if compression == 1 else zlib.decompress(strip))
    flat = np.frombuffer(b"".join(parts), f"{tags['order']}{kind}{bits // 8}")  # type: ignore[index]
    image = flat[: height * width * samples].reshape(height, width, samples)
    if int(tags.get(PREDICTOR, 1)) == 2:
        image = np.cumsum(image, axis=1, dtype=image.dtype)
    return image[:, :, 0] if samples == 1 else image


def ome(xml: str) -> dict[str, float]:
    """Physical sizes in micrometres and the time step in seconds from OME-XML; nothing from malformed text."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return {}
    found = next((e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "Pixels"), None)
    out: dict[str, float] = {}
    for name, attribute, known, default in (("sz", "PhysicalSizeZ", MICROMETRES, "um"), ("sy", "PhysicalSizeY", MICROMETRES, "um"), ("sx", "PhysicalSizeX", MICROMETRES, "um"), ("interval", "TimeIncrement", SECONDS, "s")):
        value = None if found is None else found.get(attribute)
        unit = "" if found is None else (found.get(attribute + "Unit") or default).strip().lower().replace("μ", "µ")
        try:
            number = float(value) * known[unit]  # type: ignore[arg-type]
        except (TypeError, ValueError, KeyError):
            continue
        if number > 0:
            out[name] = number
    if found is not None:
        out |= {f"n{c.lower()}": int(found.get(f"Size{c}") or 1) for c in "TCZ"}
        out["order"] = found.get("DimensionOrder") or "XYCZT"  # type: ignore[assignment]
    return out


def imagej(text: str) -> dict[str, str]:
    """The key=value lines of an ImageJ description."""
    return dict(line.split("=", 1) for line in text.splitlines() if "=" in line) if text.startswith("ImageJ=") else {}


def layout(tags: list[dict[int, object]]) -> dict[str, object]:
    """Sizes of T, C and Z, the order of pages, calibration in micrometres and seconds, and what was assumed."""
    first = tags[0]
    text = str(first.get(DESCRIPTION, ""))
    out: dict[str, object] = {"nt": 1, "nc": 1, "nz": len(tags), "order": "tzc", "sz": 1.0, "sy": 1.0, "sx": 1.0, "interval": None, "assumed": len(tags) > 1}
    unit = {2: 25400.0, 3: 10000.0}.get(first.get(UNIT, 2))  # type: ignore[call-overload]
    ij = imagej(text)
    length = MICROMETRES.get(ij.get("unit", "").replace("\\u00B5", "µ").strip().lower(), unit)
    for name, tag in (("sx", XRES), ("sy", YRES)):
        value = first.get(tag)
        if isinstance(value, tuple) and value[0] > 0 and value[1] > 0 and length and (ij or unit):
            out[name] = length * value[1] / value[0]
    if ij:
        number = lambda k: int(ij.get(k, 1) or 1)
        t, c, z = number("frames"), number("channels"), number("slices")
        if t * c * z == len(tags):
            out |= {"nt": t, "nc": c, "nz": z, "assumed": False}
        if "spacing" in ij and length:
            out["sz"] = float(ij["spacing"]) * length
        if float(ij.get("finterval", 0) or 0) > 0:
            out["interval"] = float(ij["finterval"])
        elif float(ij.get("fps", 0) or 0) > 0:
            out["interval"] = 1 / float(ij["fps"])
    elif "<OME" in text:
        found = ome(text)
        order = str(found.pop("order", "XYCZT"))
        sizes = {k: int(found.pop(k, 1)) for k in ("nt", "nc", "nz")}
        if sizes["nt"] * sizes["nc"] * sizes["nz"] == len(tags):
            out |= sizes | {"order": order[:1:-1].lower(), "assumed": False}
        out |= found
    elif text.startswith("{"):
        try:
            shape, axes = json.loads(text).get("shape"), json.loads(text).get("axes")
        except ValueError:
            shape = axes = None
        if axes and re.fullmatch(r"[TCZYX]+", axes):
            sizes = dict(zip(axes, shape or [], strict=False))
            if np.prod([sizes.get(a, 1) for a in "TCZ"]) == len(tags):
                out |= {"nt": sizes.get("T", 1), "nc": sizes.get("C", 1), "nz": sizes.get("Z", 1), "order": "".join(a.lower() for a in axes if a in "TCZ"), "assumed": False}
    return out


def _place(page: int, info: Mapping[str, object]) -> tuple[int, int, int]:
    """t, c, z of a page; the last axis of the order changes fastest."""
    at: dict[str, int] = {}
    for axis in reversed(str(info["order"])):
        size = int(info[f"n{axis}"])  # type: ignore[call-overload]
        at[axis], page = page % size, page // size
    return at.get("t", 0), at.get("c", 0), at.get("z", 0)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true").load(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: dims, sizes and calibration, without decoding pixels.  An unreadable file has an error and nulls."""
    schema = "image_id string, dims string, nt int, nc int, nz int, ny int, nx int, sz double, sy double, sx double, time_interval double, assumed boolean, error string"

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, raw in zip(part["path"], part["content"], strict=True):
                try:
                    tags = pages(raw)
                    i = layout(tags)
                    samples = int(tags[0].get(SAMPLES, 1))
                    colours = min(samples, 3) if samples > 2 else samples
                    dims = ("T" if i["nt"] > 1 else "") + ("Z" if i["nz"] > 1 else "") + "YX"  # type: ignore[operator]
                    rows.append((name, dims, i["nt"], i["nc"] * colours, i["nz"], tags[0][HEIGHT], tags[0][WIDTH], i["sz"], i["sy"], i["sx"], i["interval"], i["assumed"], None))  # type: ignore[operator]
                except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                    rows.append((name, *[None] * 11, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return _files(spark, path).select("path", "content").mapInPandas(scan, schema)


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, t, c, z, y, x, value) of all files.

    Colour samples are channels; alpha is dropped, and three equal colours are one.  A file is one row to its task, which decodes it page by page: memory follows the file.
    """
    schema = "image_id string, t int, c int, z int, y int, x int, value double"

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"], strict=True):
                tags = pages(raw)
                info = layout(tags)
                samples = int(tags[0].get(SAMPLES, 1))
                grey = samples > 2 and all(bool((a[..., 0] == a[..., 1]).all() and (a[..., 0] == a[..., 2]).all()) for a in (decode(raw, g) for g in tags))
                colours = 1 if samples < 3 or grey else 3
                for k, tag in enumerate(tags):
                    image = decode(raw, tag)
                    t, c, z = _place(k, info)
                    for s in range(colours):
                        plane = image if image.ndim == 2 else image[..., s]
                        y, x = np.indices(plane.shape)
                        yield pd.DataFrame({"image_id": name, "t": t, "c": c * colours + s, "z": z, "y": y.ravel(), "x": x.ravel(), "value": plane.ravel().astype(float)})

    return _files(spark, path).select("path", "content").mapInPandas(scan, schema)


def layers(voxels: DataFrame) -> DataFrame:
    """Images by channel with dims after singleton axes are dropped: (image_id, c, dims, nt, nz)."""
    sizes = voxels.groupBy("image_id", "c").agg((F.max("t") + 1).alias("nt"), (F.max("z") + 1).alias("nz"))
    dims = F.concat(F.when(F.col("nt") > 1, "T").otherwise(""), F.when(F.col("nz") > 1, "Z").otherwise(""), F.lit("YX"))
    return sizes.select("image_id", "c", dims.alias("dims"), "nt", "nz")


def encode(stack: np.ndarray, description: str = "", resolution: tuple[int, int] | None = None) -> bytes:
    """An uncompressed file of pages x rows x columns, little endian."""
    stack = np.ascontiguousarray(stack if stack.ndim == 3 else stack[None])
    kind = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind]
    out = bytearray(b"II*\0\x08\0\0\0")
    text = description.encode() + b"\0"
    for k, page in enumerate(stack):
        body = page.astype(page.dtype.newbyteorder("<")).tobytes()
        entries = [(WIDTH, 4, 1, page.shape[1]), (HEIGHT, 4, 1, page.shape[0]), (BITS, 3, 1, page.dtype.itemsize * 8), (COMPRESSION, 3, 1, 1), (OFFSETS, 4, 1, 0), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, page.shape[0]), (COUNTS, 4, 1, len(body)), (FORMAT, 3, 1, kind)]
        if k == 0 and description:
            entries.append((DESCRIPTION, 2, len(text), 0))
        if resolution:
            entries += [(XRES, 5, 1, 0), (YRES, 5, 1, 0), (UNIT, 3, 1, 1)]
        entries.sort()
        data = len(out) + 2 + 12 * len(entries) + 4
        extra = bytearray()
        table = bytearray(struct.pack("<H", len(entries)))
        for tag, form, count, value in entries:
            if tag in (XRES, YRES):
                value = data + len(extra)
                extra += struct.pack("<II", *resolution)  # type: ignore[misc]
            elif tag == DESCRIPTION and len(text) > 4:
                value = data + len(extra)
                extra += text + b"\0" * (len(text) % 2)
            elif tag == DESCRIPTION:
                value = int.from_bytes(text.ljust(4, b"\0"), "little")
            elif tag == OFFSETS:
                value = -1
            table += struct.pack("<HHI", tag, form, count) + (struct.pack("<I", value) if value >= 0 else b"????")
        image_at = data + len(extra)
        table = table.replace(b"????", struct.pack("<I", image_at))
        follow = image_at + len(body) + len(body) % 2
        out += table + struct.pack("<I", follow if k + 1 < len(stack) else 0) + extra + body + b"\0" * (len(body) % 2)
    return bytes(out)
