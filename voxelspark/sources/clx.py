"""Bounded decoder of the tagged binary metadata that some microscopes store in private TIFF tags."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

# Limits on untrusted input.
MOST_DEPTH, MOST_ITEMS, MOST_BYTES, MOST_TEXT = 64, 100_000, 64 << 20, 4 << 20
# Item kinds of the format.
BOOL, INT32, UINT32, INT64, UINT64, DOUBLE, POINTER, TEXT, BYTES, NEXT, LEVEL, PACKED = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 76
_NUMBERS = {BOOL: "<?", INT32: "<i", UINT32: "<I", INT64: "<q", UINT64: "<Q", DOUBLE: "<d", POINTER: "<Q"}


class InvalidMetadata(ValueError):
    """Malformed or oversized metadata."""


@dataclass
class Budget:
    items: int = MOST_ITEMS
    bytes: int = MOST_BYTES

    def spend(self, items: int = 0, size: int = 0) -> None:
        self.items, self.bytes = self.items - items, self.bytes - size
        if self.items < 0 or self.bytes < 0:
            raise InvalidMetadata("metadata exceeds its budget")


class _Stream:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise InvalidMetadata("truncated metadata")
        part = self.raw[self.at : self.at + n]
        self.at += n
        return part

    def number(self, form: str) -> float:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self, budget: Budget) -> str:
        end = self.at
        while True:
            pair = self.raw[end : end + 2]
            if len(pair) < 2:
                raise InvalidMetadata("unterminated text")
            if pair == b"\0\0":
                break
            end += 2
            if end - self.at > MOST_TEXT:
                raise InvalidMetadata("text exceeds its limit")
        budget.spend(size=end - self.at)
        out = self.take(end - self.at).decode("utf-16-le", "replace")
        self.at += 2
        return out


def decode(raw: bytes, count: int = 1, budget: Budget | None = None) -> dict[str, object]:
    """Items by name; of equal names the last counts, but nameless items become a list.  Raises InvalidMetadata beyond the limits."""
    return _items(_Stream(raw), count, 0, budget or Budget())


def _items(stream: _Stream, count: int, depth: int, budget: Budget) -> dict[str, object]:
    if depth > MOST_DEPTH:
        raise InvalidMetadata("metadata is nested too deeply")
    out: dict[str, object] = {}
    for _ in range(count):
        if stream.at >= len(stream.raw):
            break
        budget.spend(items=1)
        begin = stream.at
        kind, length = stream.take(2)
        if kind == PACKED:
            stream.take(10)
            unpacker = zlib.decompressobj()
            try:
                inner = unpacker.decompress(stream.raw[stream.at :], max(1, budget.bytes))
            except zlib.error as e:
                raise InvalidMetadata("damaged compressed metadata") from e
            if unpacker.unconsumed_tail:
                raise InvalidMetadata("metadata exceeds its budget")
            if not unpacker.eof:
                raise InvalidMetadata("truncated compressed metadata")
            budget.spend(size=len(inner))
            stream.at = len(stream.raw) - len(unpacker.unused_data)
            return _items(_Stream(inner), 1, depth + 1, budget)
        name = stream.take(2 * length).decode("utf-16-le", "replace").rstrip("\0")
        if kind in _NUMBERS:
            value: object = stream.number(_NUMBERS[kind])
        elif kind == TEXT:
            value = stream.text(budget)
        elif kind == BYTES:
            size = int(stream.number("<Q"))
            budget.spend(size=size)
            value = stream.take(size)
        elif kind == LEVEL:
            number, size = int(stream.number("<I")), int(stream.number("<Q"))
            end = begin + size
            if end > len(stream.raw) or end < stream.at:
                raise InvalidMetadata("level exceeds the metadata")
            inner = _Stream(stream.raw[:end], stream.at)
            value = _items(inner, number, depth + 1, budget)
            stream.at = end
            stream.take(min(8 * number, len(stream.raw) - end))
        else:
            raise InvalidMetadata(f"unknown item kind {kind}")
        if name == "" and name in out:
            old = out[name]
            out[name] = [*old, value] if isinstance(old, list) else [old, value]
        else:
            out[name] = value
    return out


def find(tree: object, name: str) -> object | None:
    """The first value of a name, depth first."""
    if isinstance(tree, dict):
        if name in tree:
            return tree[name]
        children: list[object] = list(tree.values())
    elif isinstance(tree, list):
        children = tree
    else:
        return None
    return next((v for v in (find(c, name) for c in children) if v is not None), None)


def calibration(tree: object, name: str = "dCalibration") -> float | None:
    """A positive, finite pixel size, else nothing."""
    value = find(tree, name)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 < value < float("inf") else None
