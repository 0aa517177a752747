"""Readers on files made here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltagrid.sources import extract, raster, shapes


def vint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zig(n):
    return vint(n << 1 ^ n >> 63)


def msg(*fields):
    out = b""
    for k, v in fields:
        out += vint(k << 3) + vint(v) if isinstance(v, int) else vint(k << 3 | 2) + vint(len(v)) + v
    return out


def deltas(xs):
    return b"".join(zig(b - a) for a, b in zip([0, *xs], xs, strict=False))


def packed(xs):
    return b"".join(map(vint, xs))


def block(strings, *groups, squeeze=True):
    data = msg((1, msg(*((1, s.encode()) for s in strings))), *((2, g) for g in groups))
    blob = msg((2, len(data)), (3, zlib.compress(data))) if squeeze else msg((1, data))
    head = msg((1, b"OSMData"), (3, len(blob)))
    return struct.pack(">I", len(head)) + head + blob


@pytest.fixture
def extract_file(tmp_path):
    words = ["", "highway", "primary", "name", "Oak", "addr:housenumber", "12", "addr:street", "Elm", "type", "multipolygon", "natural", "water", "outer", "peak", "footway", "sidewalk", "addr:postcode", "98101-2"]
    dense = msg((1, deltas([10, 11, 14, 20])), (8, deltas([475000000, 475010000, -10, 476000000])), (9, deltas([-1215000000, -1215000500, 1800000000, 5])), (10, packed([11, 14, 3, 4, 0, 0, 5, 6, 7, 8, 17, 18, 0, 0])))
    plain = msg((1, 2 * 30), (2, packed([3])), (3, packed([4])), (8, 2 * 470000000), (9, (1220000000 << 1) - 1))
    way = lambda i, keys, vals, refs: msg((1, i), (2, packed(keys)), (3, packed(vals)), (8, deltas(refs)))
    relation = msg((1, 7), (2, packed([9, 11])), (3, packed([10, 12])), (8, packed([13, 13, 13])), (9, deltas([102, 103, 20])), (10, packed([1, 1, 0])))
    head = msg((1, b"OSMHeader"), (3, 3))
    path = tmp_path / "x.pbf"
    path.write_bytes(
        struct.pack(">I", len(head)) + head + b"abc" + block(words, msg((2, dense)), msg((1, plain)))
        + block(words, msg((3, way(100, [1, 3], [2, 4], [10, 11, 14])), (3, way(101, [1, 15], [2, 16], [10, 11])), (3, way(102, [], [], [10, 11])), (3, way(103, [], [], [11, 20, 10])), (3, way(104, [5, 7], [6, 8], [11, 20])), (3, way(105, [11], [12], [10, 11, 20, 10]))), msg((4, relation)), squeeze=False)
    )
    return str(path)


def test_map_extracts(spark, extract_file):
    e = extract.read(spark, extract_file)
    rows = {(r["kind"], r["id"]): r for r in e.collect()}
    assert len(rows) == 12 and rows["node", 14]["lat"] == pytest.approx(-1e-6) and rows["node", 14]["lon"] == pytest.approx(180.0)
    assert rows["node", 10]["tags"] == {"natural": "peak", "name": "Oak"} and rows["node", 11]["tags"] == {} and rows["node", 30]["lon"] == pytest.approx(-122.0)
    assert rows["way", 100]["refs"] == [10, 11, 14] and [(m["kind"], m["id"], m["role"]) for m in rows["relation", 7]["members"]] == [("way", 102, "outer"), ("way", 103, "outer"), ("node", 20, "outer")]
    assert {r["kind"] for r in extract.read(spark, extract_file, "way").collect()} == {"way"}
    assert e.where("kind = 'way' AND id > 103").select("id").count() == 2


def test_what_is_read_from_extracts(spark, extract_file):
    e = extract.read(spark, extract_file)
    assert [(r["way"], r["class"], r["name"]) for r in extract.lines(e).collect()] == [(100, 3, "Oak")]
    assert extract.lines(e, lambda c: c > 3).count() == 0
    assert sorted((r["id"], r["idx"], r["class"], r["relation"], tuple(r["refs"])) for r in extract.areas(e).collect()) == [(7, 0, 13, True, (10, 11)), (7, 1, 13, True, (11, 20, 10)), (105, 0, 13, False, (10, 11, 20, 10))]
    assert [(r["id"], r["kind"], r["name"]) for r in extract.places(e).collect()] == [(10, 68, "Oak")]
    assert sorted((r["id"], r["number"], r["street"], r["zip"], round(r["lat"], 4)) for r in extract.addresses(e).collect()) == [(14, "12", "Elm", 98101, 0.0), (104, "12", "Elm", None, 47.501)]


def shape_file(path, kind, records, columns):
    body, index = b"", b""
    for k, (parts, _) in enumerate(records):
        pts = [p for part in parts for p in part]
        ys, xs = [p[0] for p in pts] or [0], [p[1] for p in pts] or [0]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        g = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", x, y) for y, x in pts)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(g) // 2)
        body += struct.pack(">2i", k + 1, len(g) // 2) + g
    (path / "x.shp").write_bytes(b"\0" * 100 + body)
    (path / "x.shx").write_bytes(b"\0" * 100 + index)
    width = 1 + sum(w for _, w in columns)
    head = struct.pack("<4sIHH20x", b"\3\0\0\0", len(records), 32 * len(columns) + 33, width) + b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in columns) + b"\r"
    (path / "x.dbf").write_bytes(head + b"".join(b" " + b"".join(a.get(n, "").encode().ljust(w) for n, w in columns) for _, a in records))
    return str(path / "x.shp")


def test_address_ranges(spark, tmp_path):
    spark.dataSource.register(shapes.Shapes)
    columns = [(n, 12) for n in ("FULLNAME", "LFROMHN", "LTOHN", "PARITYL", "ZIPL", "RFROMHN", "RTOHN", "PARITYR", "ZIPR")]
    line = [[(47.0, -122.0), (47.1, -122.2)]]
    records = [
        (line, {"FULLNAME": "Oak St", "LFROMHN": "1", "LTOHN": "99", "PARITYL": "O", "ZIPL": "98101", "RFROMHN": "12-34", "RTOHN": "50", "PARITYR": "E"}),
        (line, {"FULLNAME": "", "LFROMHN": "1", "LTOHN": "9"}), (line, {"FULLNAME": "A", "LFROMHN": "1a", "LTOHN": "9"}), ([[(47.0, -122.0)]], {"FULLNAME": "B", "LFROMHN": "1", "LTOHN": "9"}), (line + line, {"FULLNAME": "C", "RFROMHN": "8", "RTOHN": "2", "PARITYR": "B"}),
    ]
    got = shapes.address_ranges(spark.read.format("shapes").load(shape_file(tmp_path, 3, records, columns))).orderBy("number").collect()
    assert [(r["street"], r["left"] and tuple(r["left"]), r["right"] and tuple(r["right"]), len(r["points"])) for r in got] == [("Oak St", (1, 99, 1, 98101), None, 2), ("C", None, (8, 2, 3, 0), 4)]
    assert (got[0]["points"][1]["lat"], got[0]["points"][1]["lon"]) == (47.1, -122.2)


def test_rivers_and_motor_use(spark, tmp_path):
    spark.dataSource.register(shapes.Shapes)
    two = [[(47.0, -122.0), (47.1, -122.2)], [(1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]]
    path = shape_file(tmp_path, 13, [(two, {"DIS_AV_CMS": "12.5", "SYMBOL_NAME": "Roads open to all vehicles", "SEASONAL": "Seasonal"}), (two, {"DIS_AV_CMS": "x", "SYMBOL_NAME": "Trails open to motorcycles only"})], [("DIS_AV_CMS", 8), ("SYMBOL_NAME", 40), ("SEASONAL", 10)])
    s = spark.read.format("shapes").load(path)
    assert [(r["number"], r["part"], len(r["points"])) for r in shapes.river_reaches(s, 1.0).orderBy("part").collect()] == [(0, 0, 2), (0, 2, 3)]
    assert sorted((r["number"], r["part"], r["class"]) for r in shapes.motor_use(s, "trail").collect()) == [(0, 0, 4), (0, 2, 4), (1, 0, 9), (1, 2, 9)]


def test_polygons_of_owners_and_the_sea(spark, tmp_path):
    spark.dataSource.register(shapes.Shapes)
    ring = lambda y, x: [[(y, x), (y, x + 1), (y + 1, x + 1), (y, x)]]
    path = shape_file(tmp_path, 5, [(ring(47, -122), {"MANAGER": "Forest Service"}), (ring(10, 10), {"OWNERTYPE": "Tribal"}), ([], {"OWNERTYPE": "State"}), (ring(48.5, -121.5), {})], [("MANAGER", 20), ("OWNERTYPE", 20)])
    s = spark.read.format("shapes").load(path)
    own = {r["number"]: r for r in shapes.ownership(s).collect()}
    assert {k: r["class"] for k, r in own.items()} == {0: 1, 1: 9, 3: 12} and own[1]["paint"] < own[0]["paint"] < own[3]["paint"]
    assert shapes.wilderness(s).count() == 3 and sorted(r["number"] for r in shapes.sea(s, 47.5, -122.5, 48.6, -121.2).collect()) == [0, 3]


def lzw(data):
    """As the format asks: a clear code first, longer codes once an entry needs them, a new table when 4,094 is used."""
    bits, out, n = 9, 0, 0

    def put(code):
        nonlocal out, n
        out, n = out << bits | code, n + bits

    put(256)
    table, word = {bytes([i]): i for i in range(256)}, b""
    free = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c], free, word = free, free + 1, c
        if free > (1 << bits) - 1 and bits < 12:
            bits += 1
        if free == 4095:
            put(256)
            table, bits, free = {bytes([i]): i for i in range(256)}, 9, 258
    if word:
        put(table[word])
    put(257)
    return (out << -n % 8).to_bytes((n + 7) // 8, "big")


@pytest.mark.parametrize("size", [0, 1, 300, 40_000])
def test_strings_of_a_growing_table(size):
    rng = np.random.default_rng(size)
    for high in (2, 5, 256):
        data = rng.integers(0, high, size).astype(np.uint8).tobytes()
        assert raster.unpacked_lzw(lzw(data)) == data
    with pytest.raises(ValueError):
        raster.unpacked_lzw(bytes([0x80, 0x7F, 0xFF]))


def tiff(path, a, scale, tie, geo, tile=None, deflate=False, predictor=1, bits=None, strings=False):
    h, w, bands = a.shape
    th, tw = tile or (2, w)
    blocks = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            part = a[y : y + th, x : x + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(a.dtype)
            data = part.astype(a.dtype.newbyteorder("<")).tobytes()
            if predictor == 3:
                b = np.frombuffer(part.astype(">f4").tobytes(), np.uint8).reshape(part.shape[0], -1, 4).transpose(0, 2, 1).reshape(part.shape[0], -1)
                data = np.concatenate([b[:, :1], np.diff(b.astype(np.int16), axis=1).astype(np.uint8)], 1).tobytes()
            if bits == 15:
                data = b"".join(np.packbits(np.unpackbits(row.astype(">u2").tobytes() and np.frombuffer(row.astype(">u2").tobytes(), np.uint8)).reshape(-1, 16)[:, 1:].ravel()).tobytes() for row in part)
            blocks.append(zlib.compress(data) if deflate else lzw(data) if strings else data)
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    entries = {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [bits or a.dtype.itemsize * 8] * bands), 259: ("H", [8 if deflate else 5 if strings else 1]), 277: ("H", [bands]), 339: ("H", [form] * bands), 317: ("H", [predictor]), 33550: ("d", [*scale, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, *tie, 0.0]), 34735: ("H", geo)}
    at, size = (324, 325) if tile else (273, 279)
    entries |= {322: ("H", [tw]), 323: ("H", [th])} if tile else {278: ("H", [th])}
    entries |= {at: ("I", [0] * len(blocks)), size: ("I", [len(b) for b in blocks])}
    kinds, start = {"H": 3, "I": 4, "d": 12}, 8 + 2 + 12 * len(entries) + 4
    extra = start + sum(len(v) * struct.calcsize(k) for k, v in entries.values())
    entries[at] = ("I", [extra + sum(map(len, blocks[:i])) for i in range(len(blocks))])
    head, tail = struct.pack("<H", len(entries)), b""
    for tag in sorted(entries):
        k, v = entries[tag]
        raw = struct.pack(f"<{len(v)}{k}", *v)
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kinds[k], len(v)) + raw.ljust(4, b"\0")
            tail += b"\0" * len(raw)
        else:
            head += struct.pack("<HHII", tag, kinds[k], len(v), start + len(tail))
            tail += raw
    path.write_bytes(b"II*\0\x08\0\0\0" + head + b"\0" * 4 + tail + b"".join(blocks))
    return str(path)


DEGREES, UTM = [1, 1, 0, 1, 1024, 0, 1, 2], [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32610]


@pytest.mark.parametrize("kind, options", [("f4", {}), ("f4", {"deflate": True, "predictor": 3}), ("i2", {"deflate": True, "predictor": 2}), ("u1", {"tile": (4, 4)}), ("u2", {"tile": (4, 4), "deflate": True, "predictor": 2}), ("i4", {}), ("u2", {"bits": 15}), ("i2", {"strings": True}), ("u2", {"tile": (4, 4), "strings": True, "predictor": 2})])
def test_rasters(spark, tmp_path, kind, options):
    spark.dataSource.register(raster.Raster)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 120, (7, 9, 2 if kind == "u1" else 1)).astype(kind)
    r = spark.read.format("raster").load(tiff(tmp_path / "x.tif", a, (0.5, 0.25), (10.0, 50.0), DEGREES, **options))
    got = np.zeros(a.shape)
    rows = r.collect()
    for x in rows:
        got[x["py"], x["px"], x["band"]] = x["v"]
    assert len(rows) == a.size and (got == a).all()
    first = r.where("px = 2 AND py = 3").first()
    assert (first["x"], first["y"]) == (11.25, 49.125)


def test_coordinate_systems():
    assert raster.zone(tuple(DEGREES)) == 0 and raster.zone(tuple(UTM)) == 10 and raster.zone(()) == 0
    assert [raster.zone((*UTM[:-1], k)) for k in (32660, 26923, 6329, 6348)] == [60, 23, 1, 20]
    for k in (32661, 26924, 6349, 3857):
        with pytest.raises(ValueError):
            raster.zone((*UTM[:-1], k))


@pytest.mark.parametrize("kind, size", [(1, 28), (6, 30)])
def test_point_clouds(spark, tmp_path, kind, size):
    spark.dataSource.register(raster.Points)
    points = [(100, 200, 300, 40, 1, 2), (-5, 6, 7, 65535, 3, 31)]
    body = b""
    for x, y, z, i, r, c in points:
        p = struct.pack("<3iH", x, y, z, i) + (bytes([r | 16, 0, c]) if kind >= 6 else bytes([r | 8, c | 32]))
        body += p.ljust(size, b"\0")
    head = bytearray(375)
    head[:4], head[25] = b"LASF", 4
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<BHI", head, 104, kind, size, 0 if kind >= 6 else 2)
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.1, 1000.0, 2000.0, 0.0)
    struct.pack_into("<Q", head, 247, 2)
    (tmp_path / "x.las").write_bytes(bytes(head) + body)
    got = [tuple(r) for r in spark.read.format("points").load(str(tmp_path / "x.las")).orderBy(F.desc("x")).collect()]
    assert [pytest.approx(g) for g in got] == [(1001.0, 2002.0, 30.0, 40, 1, 2), (999.95, 2000.06, 0.7, 65535, 3, 31)]
    head[104] |= 128
    (tmp_path / "y.las").write_bytes(bytes(head) + body)
    with pytest.raises(Exception, match="compressed"):
        spark.read.format("points").load(str(tmp_path / "y.las")).count()
