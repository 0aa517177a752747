"""Map extracts in the protocol-buffer format as a data source, and what is read from them.

`read(spark, path)` registers the source and gives one row an element. The driver reads block headers only; a task reads a
run of blocks. The option `kinds` skips the groups of other kinds before they are decoded. It is an option and no pushed
filter, as scans of one file under different pushed filters can be taken for one another when a plan is reused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import classify as K
from .files import File, runs

SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<kind:string,id:bigint,role:string>>"
KINDS = ("node", "way", "relation")
BLOCKS = 16 << 20
_ARROW = pa.schema(
    [("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("kind", pa.string()), ("id", pa.int64()), ("role", pa.string())])))]
)


def varints(data: bytes) -> np.ndarray:
    """Packed numbers of seven bits a byte."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.uint64)
    size = last - first
    for k in range(int(size.max(initial=-1)) + 1):
        on = size >= k
        out[on] |= (b[first[on] + k] & np.uint64(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: a number, or the bytes of a longer one."""
    p, n = 0, len(data)

    def number() -> int:
        nonlocal p
        out = shift = 0
        while True:
            c = data[p]
            p += 1
            out |= (c & 127) << shift
            if c < 128:
                return out
            shift += 7

    while p < n:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, data[p : p + size]
            p += size
        elif key & 7 in (1, 5):
            p += 8 if key & 7 == 1 else 4
        else:
            raise ValueError(f"a field of unknown kind {key & 7}")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def headers(f: File) -> list[tuple[int, int]]:
    """Place and size of each block of data."""
    out, p = [], 0
    while p < f.size:
        (n,) = f.unpack(">I", p)
        found = dict(fields(f.at(p + 4, n)))
        p += 4 + n
        if found[1] == b"OSMData":
            out.append((p, found[3]))
        p += found[3]
    return out


def unpacked(blob: bytes) -> bytes:
    got = dict(fields(blob))
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    if 7 in got:
        import zstandard

        return zstandard.decompress(got[7], got.get(2, 0))
    raise ValueError("a block of unknown compression")


def elements(block: bytes, kinds: frozenset[str]) -> Iterator[tuple]:
    """Rows of one block, of these kinds."""
    strings, groups, scale, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [x.decode("utf8", "replace") for _, x in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = signed(v)
        elif k == 20:
            lon0 = signed(v)
    degrees = lambda x, zero: (zero + scale * x) * 1e-9
    tags = lambda d: [(strings[a], strings[b]) for a, b in zip(varints(d.get(2, b"")).tolist(), varints(d.get(3, b"")).tolist(), strict=True)]
    for group in groups:
        for k, v in fields(group):
            if k == 2 and "node" in kinds:
                d = dict(fields(v))
                ids, la, lo = (np.cumsum(unzigzag(varints(d.get(n, b"")))) for n in (1, 8, 9))
                words, at = varints(d.get(10, b"")).tolist(), 0
                for i, y, x in zip(ids.tolist(), degrees(la, lat0).tolist(), degrees(lo, lon0).tolist(), strict=True):
                    own = []
                    while at < len(words) and words[at]:
                        own.append((strings[words[at]], strings[words[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, y, x, own, None, None
            elif k == 1 and "node" in kinds:
                d = dict(fields(v))
                one = lambda n: int(unzigzag(np.array([d.get(n, 0)], np.uint64))[0])  # noqa: B023, E731
                yield "node", one(1), degrees(one(8), lat0), degrees(one(9), lon0), tags(d), None, None
            elif k == 3 and "way" in kinds:
                d = dict(fields(v))
                yield "way", signed(d[1]), None, None, tags(d), np.cumsum(unzigzag(varints(d.get(8, b"")))).tolist(), None
            elif k == 4 and "relation" in kinds:
                d = dict(fields(v))
                ids = np.cumsum(unzigzag(varints(d.get(9, b"")))).tolist()
                roles, types = varints(d.get(8, b"")).tolist(), varints(d.get(10, b"")).tolist()
                yield "relation", signed(d[1]), None, None, tags(d), None, [{"kind": KINDS[t], "id": i, "role": strings[r]} for t, i, r in zip(types, ids, roles, strict=True)]


@dataclass
class Blocks(InputPartition):
    places: list[tuple[int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, kinds: frozenset[str]):
        self.path, self.kinds = path, kinds

    def partitions(self) -> list[Blocks]:
        with File(self.path) as f:
            places = headers(f)
        return [Blocks(places[a:b]) for a, b in runs([n for _, n in places], BLOCKS)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        with File(self.path) as f:
            for p, n in partition.places:
                rows = list(elements(unpacked(f.at(p, n)), self.kinds))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Extract(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], frozenset((self.options.get("kinds") or ",".join(KINDS)).split(",")))


def read(spark: SparkSession, path: str, kinds: str | None = None) -> DataFrame:
    spark.dataSource.register(Extract)
    found = spark.read.format("map_extract")
    return (found.option("kinds", kinds) if kinds else found).load(path)


def lines(elements: DataFrame, keep=None) -> DataFrame:
    """(way, class, refs, uses, magnitude, name, reference) of ways that are lines and no street furniture; keep: a predicate on the class."""
    w = elements.where("kind = 'way'").where(~K.furniture(F.col("tags"))).withColumn("class", K.way_class(F.col("tags"))).where("class IS NOT NULL")
    w = w if keep is None else w.where(keep(F.col("class")))
    w = w.withColumn("n", K.feature_names(F.col("tags")))
    return w.select(F.col("id").alias("way"), "class", "refs", K.uses(F.col("class"), F.col("tags")).alias("uses"), K.magnitude(F.col("class"), F.col("tags")).alias("magnitude"), "n.name", "n.reference")


def areas(elements: DataFrame, keep=None) -> DataFrame:
    """(id, idx, class, refs, name): closed ways that are no relation's members, and the members of multipolygons (idx: their order) as they are, to be joined into rings; keep: a predicate on class and whether there is a name."""
    member = elements.where("kind = 'relation'").select(F.explode("members").alias("m")).where("m.kind = 'way'").select(F.col("m.id").alias("id")).distinct()
    elements = elements.where("kind <> 'node'").withColumn("n", K.feature_names(F.col("tags")))
    ways = elements.where("kind = 'way'").select("id", "tags", "refs", "n")
    cls, name = K.area_class(F.col("tags")), F.col("n.name")
    own = ways.where(K.closed(F.col("refs"))).join(member, "id", "left_anti").select(F.col("id"), F.lit(0).alias("idx"), cls.alias("class"), "refs", name.alias("name"))
    rel = elements.where("kind = 'relation'").where(F.try_element_at("tags", F.lit("type")) == "multipolygon").select(F.col("id"), F.posexplode("members").alias("idx", "m"), cls.alias("class"), name.alias("name")).where("m.kind = 'way'")
    parts = rel.join(ways.where(~K.seaward(F.col("tags"))).select(F.col("id").alias("_w"), "refs"), F.col("m.id") == F.col("_w")).select("id", "idx", "class", "refs", "name")
    out = own.withColumn("relation", F.lit(False)).unionByName(parts.withColumn("relation", F.lit(True))).where("class IS NOT NULL")
    return out if keep is None else out.where(keep(F.col("class"), F.col("name") != ""))


def places(elements: DataFrame) -> DataFrame:
    """(id, kind, rank, name, reference, lat, lon) of the nodes that a map marks."""
    p = elements.where("kind = 'node'").withColumn("p", K.point_kind(F.col("tags"))).where("p.kind IS NOT NULL").withColumn("n", K.feature_names(F.col("tags")))
    p = p.withColumn("l", K.point_label(F.col("p.kind"), F.col("n.name"), F.col("n.reference"))).where("l IS NOT NULL")
    return p.select("id", F.col("p.kind").alias("kind"), F.col("p.rank").alias("rank"), "l.name", "l.reference", "lat", "lon")


def addresses(elements: DataFrame) -> DataFrame:
    """(id, number, street, zip, lat, lon) of nodes and ways with a house number and a street; a way stands where its first node does."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    told = elements.where(t("addr:housenumber").isNotNull() & t("addr:street").isNotNull())
    cols = [t("addr:housenumber").alias("number"), t("addr:street").alias("street"), F.regexp_extract(F.coalesce(t("addr:postcode"), F.lit("")), r"^\d{5}", 0).try_cast("int").alias("zip")]
    nodes = told.where("kind = 'node'").select("id", *cols, "lat", "lon")
    ways = told.where("kind = 'way' AND size(refs) > 0").select("id", *cols, F.get("refs", F.lit(0)).alias("_n"))
    at = elements.where("kind = 'node'").select(F.col("id").alias("_n"), "lat", "lon")
    return nodes.unionByName(ways.join(at, "_n").drop("_n"))
