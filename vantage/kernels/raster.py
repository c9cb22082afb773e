"""Rasters as tiles: windows, blocks, mosaics with priorities, bilinear samples; reading and writing plain GeoTIFF without a library."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np


@dataclass
class Tile:
    """A raster of cell centres: the corner's place, cell sizes (``dy`` negative), heights with nan for no data."""

    name: str
    west: float
    north: float
    dx: float
    dy: float
    z: np.ndarray

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        rows, cols = self.z.shape
        return self.west, self.north + rows * self.dy, self.west + cols * self.dx, self.north

    def window(self, west: float, south: float, east: float, north: float) -> Tile | None:
        """The part that meets some bounds, or None."""
        rows, cols = self.z.shape
        place = lambda x, origin, step: round((x - origin) / step, 9)
        c0, c1 = max(0, math.floor(place(west, self.west, self.dx))), min(cols, math.ceil(place(east, self.west, self.dx)))
        r0, r1 = max(0, math.floor(place(north, self.north, self.dy))), min(rows, math.ceil(place(south, self.north, self.dy)))
        if c0 >= c1 or r0 >= r1:
            return None
        return Tile(self.name, self.west + c0 * self.dx, self.north + r0 * self.dy, self.dx, self.dy, self.z[r0:r1, c0:c1])

    def sample(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Bilinear between cell centres; nan outside and where any of the four has no data."""
        col, row = np.round((lon - self.west) / self.dx - 0.5, 9), np.round((lat - self.north) / self.dy - 0.5, 9)
        rows, cols = self.z.shape
        c, r = np.clip(np.floor(col), 0, max(0, cols - 2)).astype(int), np.clip(np.floor(row), 0, max(0, rows - 2)).astype(int)
        inside = (col >= 0) & (row >= 0) & (col <= cols - 1) & (row <= rows - 1)
        x, y = col - c, row - r
        below, right = np.minimum(r + 1, rows - 1), np.minimum(c + 1, cols - 1)
        z = (self.z[r, c] * (1 - x) + self.z[r, right] * x) * (1 - y) + (self.z[below, c] * (1 - x) + self.z[below, right] * x) * y
        return np.where(inside, z, np.nan)


class Mosaic:
    """Tiles in order of priority: the first with data at a place gives the height."""

    def __init__(self, tiles: list[Tile]):
        self.tiles = tiles

    def sample(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(height, number of the tile, -1 for none); tiles are asked only for places in their bounds that are still open."""
        z, source = np.full(np.shape(lon), np.nan), np.full(np.shape(lon), -1)
        for i, tile in enumerate(self.tiles):
            west, south, east, north = tile.bounds
            asked = np.flatnonzero((source < 0) & (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north))
            if len(asked):
                found = tile.sample(lon[asked], lat[asked])
                good = np.isfinite(found)
                z[asked[good]], source[asked[good]] = found[good], i
        return z, source

    def __call__(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return self.sample(lon, lat)[0]


_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}


def write_geotiff(west: float, north: float, dx: float, dy: float, bands: np.ndarray) -> bytes:
    """An uncompressed little-endian GeoTIFF of 32-bit floats, bands after each other: (band, row, column)."""
    count, rows, cols = bands.shape
    data = np.ascontiguousarray(bands, "<f4").tobytes()
    size = rows * cols * 4
    tags = [
        (256, 4, [cols]), (257, 4, [rows]), (258, 3, [32] * count), (259, 3, [1]), (262, 3, [1]), (273, 4, [8 + b * size for b in range(count)]), (277, 3, [count]), (278, 4, [rows]),
        (279, 4, [size] * count), (284, 3, [2]), (339, 3, [3] * count), (33550, 12, [dx, -dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (42113, 2, list(b"nan\0")),
    ]
    at = 8 + len(data)
    head, tail = struct.pack("<H", len(tags)), b""
    for tag, kind, values in tags:
        code, width = _TYPES[kind]
        raw = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{code}", *values)
        if len(raw) > 4:
            place = at + 2 + 12 * len(tags) + 4 + len(tail)
            tail += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        head += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + data + head + struct.pack("<I", 0) + tail


def read_geotiff(data: bytes, name: str = "", band: int = 0) -> Tile:
    """A band of an uncompressed GeoTIFF with strips or tiles, of integers or floats; the no-data value becomes nan."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        code, width = _TYPES[kind]
        place = at + 2 + 12 * i + 8
        if width * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = list(data[place : place + count]) if kind in (1, 2) else list(struct.unpack_from(f"{order}{count}{code}", data, place))
    if tags.get(259, [1])[0] != 1:
        raise ValueError(f"{name}: compressed rasters are not read")
    cols, rows, bits, form, bands = tags[256][0], tags[257][0], tags[258][0], tags.get(339, [1])[0], tags.get(277, [1])[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    z = np.full((rows, cols), np.nan)
    planar = tags.get(284, [1])[0] == 2
    inner, own = (1, band) if planar or bands == 1 else (bands, 0)
    if 324 in tags:  # tiles
        width, height, starts = tags[322][0], tags[323][0], tags[324]
        across = -(-cols // width)
        blocks = [(i // across * height, i % across * width, height, width) for i in range(across * -(-rows // height))]
    else:
        height, starts = min(rows, tags.get(278, [rows])[0]), tags[273]
        blocks = [(r, 0, min(height, rows - r), cols) for r in range(0, rows, height)]
    for i, (r, c, h, w) in enumerate(blocks):
        start = starts[i + own * len(blocks)] if planar else starts[i]
        values = np.frombuffer(data, dtype, h * w * inner, start).reshape(h, w, inner)[:, :, 0 if planar or bands == 1 else band]
        z[r : r + h, c : c + w] = values[: rows - r, : cols - c]
    missing = bytes(tags.get(42113, b"")).split(b"\0")[0].strip()
    if missing and missing != b"nan":
        z[z == float(missing)] = np.nan
    dx, dy, _ = tags[33550][:3]
    i, j, _, x, y, _ = tags[33922][:6]
    return Tile(name, x - i * dx, y + j * dy, dx, -dy, z)


#: size of a point record by format of the public point-cloud exchange file (fixed values)
_POINT_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36}


def read_las(data: bytes, first: int, count: int) -> dict[str, np.ndarray]:
    """``count`` returns from number ``first`` on of an uncompressed LAS file: x, y, z, class and whether withheld."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    offset, _, kind, width = struct.unpack_from("<IIBH", data, 96)
    (total,) = struct.unpack_from("<I", data, 107)
    if minor >= 4:
        total = struct.unpack_from("<Q", data, 247)[0] or total
    scale, shift = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    if kind not in _POINT_BYTES:
        raise ValueError(f"point format {kind} is not read")
    count = max(0, min(count, total - first))
    raw = np.frombuffer(data, np.uint8, count * width, offset + first * width if count else 0).reshape(count, width)
    xyz = raw[:, :12].copy().view("<i4").reshape(count, 3) * scale + shift
    cls = raw[:, 16] if kind >= 6 else raw[:, 15] & 31
    withheld = (raw[:, 15] & 4 if kind >= 6 else raw[:, 15] & 128) > 0
    return {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "cls": cls.astype(np.int32), "withheld": withheld}
