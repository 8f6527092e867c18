"""EWKB cells: a bounded scanner that never recurses, and header edits."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from geolode.errors import EngineError

Z, M, SRID, BBOX = 0x80000000, 0x40000000, 0x20000000, 0x10000000
NAMES = {
    1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection", 8: "CircularString", 9: "CompoundCurve",
    10: "CurvePolygon", 11: "MultiCurve", 12: "MultiSurface", 15: "PolyhedralSurface", 16: "Tin", 17: "Triangle",
}
RINGS = {3, 17}
POINTS = {2, 8}
PARTS = {4, 5, 6, 7, 9, 10, 11, 12, 15, 16}


@dataclass(frozen=True)
class Cell:
    geometry_type: str
    dimensions: str
    srid: int | None
    components: int
    max_depth: int


def _bad(message: str) -> EngineError:
    return EngineError("data_mapping", f"geometry: {message}", "read")


def _header(data: bytes, at: int) -> tuple[str, int, bool, bool, int | None, int]:
    if at + 5 > len(data) or data[at] > 1:
        raise _bad("no header")
    end = "<" if data[at] else ">"
    (word,) = struct.unpack_from(end + "I", data, at + 1)
    if word & BBOX:
        raise _bad("an embedded box")
    z, m, has_srid, code = bool(word & Z), bool(word & M), bool(word & SRID), word & 0x0FFFFFFF
    if code >= 1000:
        thousands, code = divmod(code, 1000)
        if thousands > 3:
            raise _bad("unknown type")
        z, m = z or thousands in (1, 3), m or thousands in (2, 3)
    if code not in NAMES:
        raise _bad("unknown or abstract type")
    at += 5
    srid = None
    if has_srid:
        if at + 4 > len(data):
            raise _bad("cut off")
        (srid,) = struct.unpack_from(end + "I", data, at)
        at += 4
    return end, code, z, m, srid, at


def inspect(data: bytes, most_components: int = 1 << 24, most_depth: int = 64, most_bytes: int = 64 << 20) -> Cell:
    """What a cell holds; raises for anything that is not exactly one geometry within the limits."""
    if len(data) > most_bytes:
        raise EngineError("resource_limit", "a geometry is larger than its limit", "read")
    first: tuple | None = None
    components, deepest = 0, 0
    left = [1]  # geometries still to come, by depth
    at = 0

    def count(end: str) -> int:
        nonlocal at
        if at + 4 > len(data):
            raise _bad("cut off")
        (n,) = struct.unpack_from(end + "I", data, at)
        at += 4
        return n

    while left:
        if not left[-1]:
            left.pop()
            continue
        left[-1] -= 1
        end, code, z, m, srid, at = _header(data, at)
        first = first or (code, z, m, srid)
        if (z, m) != first[1:3]:
            raise _bad("parts of different dimensions")
        components += 1
        deepest = max(deepest, len(left))
        width = 8 * (2 + z + m)
        if code in PARTS:
            n = count(end)
            left.append(n)
            if len(left) > most_depth:
                raise EngineError("resource_limit", "a geometry is nested too deeply", "read")
            continue
        for _ in range(count(end) if code in RINGS else 1):
            n = 1 if code == 1 else count(end)
            components += n if code != 1 else 0
            if at + n * width > len(data):
                raise _bad("cut off")
            at += n * width
            if components > most_components:
                raise EngineError("resource_limit", "a geometry has too many parts", "read")
    if at != len(data):
        raise _bad("bytes after its end")
    code, z, m, srid = first
    return Cell(NAMES[code], "xy" + "z" * z + "m" * m, srid, components, deepest)


def with_srid(data: bytes, srid: int | None) -> bytes:
    """The cell with this SRID in its header; None takes it out."""
    end, _, _, _, _, at = _header(data, 0)
    (word,) = struct.unpack_from(end + "I", data, 1)
    word = word & ~SRID | (SRID if srid is not None else 0)
    return data[:1] + struct.pack(end + "I", word) + (struct.pack(end + "I", srid) if srid is not None else b"") + data[at:]
