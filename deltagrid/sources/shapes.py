"""Shape files (with their tables) as a data source, and the layers read from them.

`spark.dataSource.register(Shapes)`, then `spark.read.format("shapes").load("x.shp")` gives one row a record: number, shape
(its type), parts, envelope, attrs. The index file deals the records to tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import classify as K
from ..functions import measure as M
from .files import File, runs

RINGS = "array<array<struct<lat:double,lon:double>>>"
SCHEMA = f"number int, shape int, parts {RINGS}, lat0 double, lon0 double, lat1 double, lon1 double, attrs map<string,string>"
BYTES = 16 << 20
_ARROW = pa.schema([("number", pa.int32()), ("shape", pa.int32()), ("parts", pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))), *((c, pa.float64()) for c in ("lat0", "lon0", "lat1", "lon1")), ("attrs", pa.map_(pa.string(), pa.string()))])


def geometry(body: bytes) -> tuple:
    """(type, parts, envelope) of a record; lines and areas, with or without heights and measures."""
    (kind,) = struct.unpack_from("<i", body)
    if kind % 10 not in (3, 5):
        return kind, [], (None,) * 4
    x0, y0, x1, y1, parts, n = struct.unpack_from("<4d2i", body, 4)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2)
    return kind, [[{"lat": y, "lon": x} for x, y in xy[a:b].tolist()] for a, b in zip(starts, starts[1:], strict=False)], (y0, x0, y1, x1)


@dataclass
class Records(InputPartition):
    first: int
    places: list[tuple[int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.stem = path, path[: -len(".shp")]

    def partitions(self) -> list[Records]:
        with File(f"{self.stem}.shx") as f:
            index = np.frombuffer(f.at(100, f.size - 100), ">i4").reshape(-1, 2).astype(np.int64) * 2
        return [Records(a, index[a:b].tolist()) for a, b in runs(index[:, 1].tolist(), BYTES)] or [Records(0, [])]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with File(self.path) as shp, File(f"{self.stem}.dbf") as dbf:
            head, size = dbf.unpack("<HH", 8)
            columns, at = [], 1
            for p in range(32, head - 32, 32):
                d = dbf.at(p, 32)
                if d[0] == 0x0D:
                    break
                columns.append((d[:11].split(b"\0")[0].decode("latin-1"), at, d[16]))
                at += d[16]
            for a, b in runs([n for _, n in partition.places], 4 << 20):
                rows = []
                for k in range(a, b):
                    offset, n = partition.places[k]
                    kind, parts, box = geometry(shp.at(offset + 8, n))
                    line = dbf.at(head + (partition.first + k) * size, size)
                    rows.append((partition.first + k, kind, parts, *box, [(c, line[s : s + w].decode("utf8", "replace").strip()) for c, s, w in columns]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def _text(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _lines(shapes: DataFrame) -> DataFrame:
    return shapes.where("shape % 10 = 3")


def address_ranges(shapes: DataFrame) -> DataFrame:
    """(number, street, left, right, points): lines with a name and two points at least, and on one side at least a range of plain numbers (first, last, parity 1 odd, 2 even, 3 both, zip)."""

    def side(first: str, last: str, parity: str, zip_: str) -> Column:
        digits = _text(first).rlike("^[0-9]+$") & _text(last).rlike("^[0-9]+$")
        s = F.struct(_text(first).try_cast("int").alias("first"), _text(last).try_cast("int").alias("last"), F.when(_text(parity) == "O", 1).when(_text(parity) == "E", 2).otherwise(3).alias("parity"), F.coalesce(_text(zip_).try_cast("int"), F.lit(0)).alias("zip"))
        return F.when(digits & s["first"].isNotNull() & s["last"].isNotNull(), s)

    out = _lines(shapes).select("number", _text("FULLNAME").alias("street"), side("LFROMHN", "LTOHN", "PARITYL", "ZIPL").alias("left"), side("RFROMHN", "RTOHN", "PARITYR", "ZIPR").alias("right"), F.flatten("parts").alias("points"))
    return out.where((F.col("street") != "") & (F.size("points") >= 2) & (F.col("left").isNotNull() | F.col("right").isNotNull()))


def river_reaches(shapes: DataFrame, least: float) -> DataFrame:
    """(number, part, points, weight): the parts, of two points at least, of reaches with so much discharge."""
    flow = F.coalesce(_text("DIS_AV_CMS").try_cast("double"), F.lit(0.0))
    out = _lines(shapes).where(flow >= least).select("number", F.posexplode("parts").alias("part", "points"), M.river_weight(flow).alias("weight"))
    return out.where(F.size("points") >= 2)


def ownership(shapes: DataFrame, manager: str = "MANAGER", kind: str = "OWNERTYPE") -> DataFrame:
    """(number, class, rings, paint): owners' polygons; tribal land is painted first, so parcels lie over it."""
    out = shapes.where("shape % 10 = 5").where(F.size("parts") > 0).select("number", K.owner_class(_text(manager), _text(kind)).alias("class"), F.col("parts").alias("rings"))
    return out.withColumn("paint", F.when(F.col("class") == 9, 0).otherwise(1).cast("bigint") * (1 << 32) + F.col("number"))


def wilderness(shapes: DataFrame) -> DataFrame:
    return shapes.where("shape % 10 = 5").where(F.size("parts") > 0).select("number", F.col("parts").alias("rings"))


def motor_use(shapes: DataFrame, kind: str) -> DataFrame:
    """(number, part, class, points) of lines open to motor vehicles; kind: road or trail."""
    cls = K.motor_use_class(_text("SYMBOL_NAME"), F.lit(kind), _text("SEASONAL"))
    return _lines(shapes).select("number", F.posexplode("parts").alias("part", "points"), cls.alias("class")).where(F.size("points") >= 2)


def sea(shapes: DataFrame, lat0: float, lon0: float, lat1: float, lon1: float) -> DataFrame:
    """Polygons whose envelope meets a box."""
    return shapes.where((F.col("lat0") <= lat1) & (F.col("lat1") >= lat0) & (F.col("lon0") <= lon1) & (F.col("lon1") >= lon0)).where("shape % 10 = 5").select("number", F.col("parts").alias("rings"))
