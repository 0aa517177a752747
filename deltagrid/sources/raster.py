"""Georeferenced rasters and point clouds as data sources.

`raster`: one row a pixel and band (px, py, band, v, x, y: the pixel's middle in the file's coordinates), by tiles or strips;
rows of missing tiles are left out. Plain or deflated data of 8, 15 (packed), 16 or 32 bits, with or without predictors.
`points`: one row a point of an uncompressed point-cloud file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import File, runs

BYTES = 8 << 20
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("Q", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8)}
_PIXELS = pa.schema([("px", pa.int32()), ("py", pa.int32()), ("band", pa.int32()), ("v", pa.float64()), ("x", pa.float64()), ("y", pa.float64())])
_POINTS = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("intensity", pa.int32()), ("return_number", pa.int32()), ("class", pa.int32())])


def tags(f: File) -> dict[int, tuple | bytes]:
    """The first directory's entries."""
    end = {b"II": "<", b"MM": ">"}[f.at(0, 2)]
    version, first = f.unpack(end + "HI", 2)
    if version != 42:
        raise ValueError("a raster of unknown version")
    (n,) = f.unpack(end + "H", first)
    out: dict[int, tuple | bytes] = {0: (end,)}
    for k in range(n):
        p = first + 2 + 12 * k
        tag, kind, count = f.unpack(end + "HHI", p)
        if kind not in _SIZES:
            continue
        form, size = _SIZES[kind]
        where = p + 8 if count * size <= 4 else f.unpack(end + "I", p + 8)[0]
        out[tag] = f.at(where, count) if kind == 2 else f.unpack(f"{end}{count}{form}", where)
    return out


def zone(keys: tuple[int, ...]) -> int | None:
    """The northern zone of a projected grid, 0 for degrees; an error for any other system."""
    model = projected = None
    for k in range(4, len(keys) - 3, 4):
        if keys[k + 1] == 0:
            model, projected = (keys[k + 3] if keys[k] == 1024 else model), (keys[k + 3] if keys[k] == 3072 else projected)
    if model == 2 or (model is None and projected is None):
        return 0
    # Where the codes of northern zones begin, for three datums.
    for base, last in ((32600, 60), (26900, 23), (6328, 20)):
        if model == 1 and projected is not None and 1 <= projected - base <= last:
            return projected - base
    raise ValueError("an unknown coordinate system")


def unpacked_lzw(data: bytes) -> bytes:
    """Strings of a table that grows by each one's first byte: codes of 9 to 12 bits, the highest bit first; 256 begins a new table, 257 ends. Codes get a bit longer one entry before the table fills them."""
    out, table, bits, held, n, last = [], [], 9, 0, 0, b""
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, held = held >> n, held & (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            found = table[code]
        elif last and code == len(table):
            found = last + last[:1]
        else:
            raise ValueError("a code that no table has")
        out.append(found)
        if last:
            table.append(last + found[:1])
        last = found
        bits = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def samples(data: bytes, t: dict, w: int, h: int) -> np.ndarray:
    """(h, w, bands) of one tile or strip."""
    end, bands = t[0][0], t.get(277, (1,))[0]
    bits, form, packing = t.get(258, (1,))[0], t.get(339, (1,))[0], t.get(259, (1,))[0]
    if packing in (8, 32946):
        data = zlib.decompress(data)
    elif packing == 5:
        data = unpacked_lzw(data)
    elif packing != 1:
        raise ValueError(f"packing {packing} is not read")
    if bits == 15:
        rows = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(h, -1)[:, : w * bands * 15].reshape(h, w, bands, 15)
        return rows @ (1 << np.arange(14, -1, -1))
    kind = np.dtype(end + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    predictor = t.get(317, (1,))[0]
    if predictor == 3:
        b = np.frombuffer(data, np.uint8).reshape(h, -1).astype(np.uint32)
        for k in range(bands):
            b[:, k::bands] = np.cumsum(b[:, k::bands], 1) & 255
        b = b.astype(np.uint8).reshape(h, kind.itemsize, w * bands).transpose(0, 2, 1)
        return np.ascontiguousarray(b).view(">f4").reshape(h, w, bands)
    a = np.frombuffer(data, kind, h * w * bands).reshape(h, w, bands)
    return np.cumsum(a, 1, dtype=a.dtype.newbyteorder("=")) if predictor == 2 else a


@dataclass
class Tiles(InputPartition):
    which: tuple[int, int]


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def layout(self, t: dict) -> tuple[int, int, tuple, tuple]:
        """Width and height of a tile, places and sizes of all."""
        width, height = t[256][0], t[257][0]
        if 322 in t:
            return t[322][0], t[323][0], t[324], t[325]
        return width, min(t.get(278, (height,))[0], height), t[273], t[279]

    def partitions(self) -> list[Tiles]:
        with File(self.path) as f:
            t = tags(f)
            zone(t.get(34735, ()))
            w, h, _, sizes = self.layout(t)
            return [Tiles(r) for r in runs([w * h * 8 for _ in sizes], BYTES)]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        with File(self.path) as f:
            t = tags(f)
            width, height = t[256][0], t[257][0]
            w, h, places, sizes = self.layout(t)
            scale, tie = t[33550], t[33922]
            x0, y0 = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
            across = -(-width // w)
            for k in range(*partition.which):
                if not sizes[k]:
                    continue
                top, left = k // across * h, k % across * w
                rows = h if 322 in t else min(h, height - top)
                a = samples(f.at(places[k], sizes[k]), t, w, rows)[: height - top, : width - left].astype(float)
                py, px, band = np.indices(a.shape).reshape(3, -1)
                px, py = px + left, py + top
                cols = [px.astype(np.int32), py.astype(np.int32), band.astype(np.int32), a.ravel(), x0 + (px + 0.5) * scale[0], y0 - (py + 0.5) * scale[1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PIXELS)


class Raster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "px int, py int, band int, v double, x double, y double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"])


@dataclass
class Span(InputPartition):
    first: int
    last: int


class PointReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def head(self, f: File) -> tuple[int, int, int, int, tuple, tuple]:
        if f.at(0, 4) != b"LASF":
            raise ValueError("not a point-cloud file")
        (data,), (kind, size, n) = f.unpack("<I", 96), f.unpack("<BHI", 104)
        if kind & 0xC0:
            raise ValueError("compressed point clouds are not read")
        if f.at(25, 1)[0] >= 4 and not n:
            (n,) = f.unpack("<Q", 247)
        return data, kind, size, n, f.unpack("<3d", 131), f.unpack("<3d", 155)

    def partitions(self) -> list[Span]:
        with File(self.path) as f:
            _, _, size, n, _, _ = self.head(f)
        step = max(1, BYTES // size)
        return [Span(a, min(n, a + step)) for a in range(0, n, step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with File(self.path) as f:
            data, kind, size, _, scale, zero = self.head(f)
            for a in range(partition.first, partition.last, 65_536):
                n = min(65_536, partition.last - a)
                b = np.frombuffer(f.at(data + a * size, n * size), np.uint8).reshape(n, size)
                at = lambda p, form, width: np.ascontiguousarray(b[:, p : p + width]).view(form)[:, 0]  # noqa: B023, E731
                xyz = [at(4 * k, "<i4", 4) * scale[k] + zero[k] for k in range(3)]
                returns, cls = (b[:, 14] & 15, b[:, 16]) if kind >= 6 else (b[:, 14] & 7, b[:, 15] & 31)
                cols = [*xyz, at(12, "<u2", 2).astype(np.int32), returns.astype(np.int32), cls.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_POINTS)


class Points(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return "x double, y double, z double, intensity int, return_number int, class int"

    def reader(self, schema) -> PointReader:
        return PointReader(self.options["path"])
