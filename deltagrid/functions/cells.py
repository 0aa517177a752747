"""The icosahedral grid as Columns.

Twelve vertices make ten diamonds of two faces each. A place is (diamond, u, v), u and v in 30 bits; a cell of depth d is
(depth, prefix), where prefix is the diamond followed by the first d bits of u and v interleaved, u first. The raw 64-bit
form is never stored: diamonds 8 and 9 would set the sign bit; prefixes fit BIGINT down to depth 29.

A place is encoded by one Arrow function, so that its last bit is the C library's. Everything else is built-in expressions: vertices are literal
arrays, bits are interleaved by reading digits in another base. Nothing shuffles.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The solid's vertices and each diamond's [origin, u end, v end, far corner].
VERTICES = [
    (0.0, 0.0, 1.0),
    (0.8944271909999159, 0.0, 0.4472135954999579),
    (0.27639320225002106, 0.8506508083520399, 0.4472135954999579),
    (-0.7236067977499788, 0.5257311121191337, 0.4472135954999579),
    (-0.723606797749979, -0.5257311121191335, 0.4472135954999579),
    (0.27639320225002084, -0.85065080835204, 0.4472135954999579),
    (0.7236067977499789, 0.5257311121191336, -0.4472135954999579),
    (-0.27639320225002095, 0.85065080835204, -0.4472135954999579),
    (-0.8944271909999159, 0.0, -0.4472135954999579),
    (-0.2763932022500211, -0.8506508083520399, -0.4472135954999579),
    (0.7236067977499788, -0.5257311121191338, -0.4472135954999579),
    (0.0, 0.0, -1.0),
]
DIAMONDS = [(0, 1, 2, 6), (0, 2, 3, 7), (0, 3, 4, 8), (0, 4, 5, 9), (0, 1, 5, 10), (11, 6, 7, 2), (11, 7, 8, 3), (11, 8, 9, 4), (11, 9, 10, 5), (11, 6, 10, 1)]
EARTH_RADIUS_M, EDGE_ARC, TEXEL_BASE_M = 6_371_000.0, 1.1071487177940905, 7_054_000.0
STEPS, TEX, TEX_BITS = 1 << 30, 256, 8


def faces() -> list[tuple]:
    """(centroid, inverse of the matrix of corners, diamond, upper) of the 20 faces; the inverse gives a direction's weights on the three corners."""
    out = []
    for d, (a, q, r, b) in enumerate(DIAMONDS):
        for upper, apex in ((0, a), (1, b)):
            corners = np.array([VERTICES[apex], VERTICES[q], VERTICES[r]])
            c = corners.sum(0) / 3  # all of one length, so they are compared as they are, and faces that meet at a pole tie
            out.append((tuple(c.tolist()), tuple(np.linalg.inv(corners.T).ravel().tolist()), d, upper))
    return out


FACES = faces()


def spread(x: Column) -> Column:
    """Bits moved to the even places: the binary digits read in base 4. x is named once, so a filter on a cell stays small when it is pushed down to the place it comes from."""
    return F.conv(F.bin(x), 4, 10).cast("bigint")


def compact(m: Column) -> Column:
    """The even bits gathered: the digits of m in base 4, odd or even, read in base 2."""
    return F.conv(F.translate(F.conv(m.cast("string"), 10, 4), "0123", "0101"), 2, 10).cast("bigint")


def morton(u: Column, v: Column) -> Column:
    return F.shiftleft(spread(u), 1).bitwiseOR(spread(v))


def directions(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """df with _x, _y, _z: the unit vector of geodetic degrees taken as spherical."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    return df.withColumns({"_x": F.cos(phi) * F.cos(lam), "_y": F.cos(phi) * F.sin(lam), "_z": F.sin(phi)})


def encode(df: DataFrame, lat: str = "lat", lon: str = "lon", within: list[int] | None = None) -> DataFrame:
    """df with diamond, u, v: the face whose centroid is nearest (the first on ties), its gnomonic coordinates cut to 30 bits. within: only these diamonds. Null places, and those that are no numbers, give nulls.

    One Arrow function: its sines are the C library's and its sums are in the SQL's order, as the last bit decides which of two cells has a place on their edge.
    """
    faces = [f for f in FACES if within is None or f[2] in within]
    centres, weights = np.array([f[0] for f in faces]), np.array([f[1] for f in faces])
    diamonds, uppers, steps = np.array([f[2] for f in faces], "int32"), np.array([f[3] == 1 for f in faces]), STEPS

    def coded(phi: pa.Array, lam: pa.Array) -> pa.Array:
        flat = pc.cos(phi)
        x, y, z = (a.to_numpy(zero_copy_only=False) for a in (pc.multiply(flat, pc.cos(lam)), pc.multiply(flat, pc.sin(lam)), pc.sin(phi)))
        bad = ~(np.isfinite(x) & np.isfinite(z))
        x, y, z = (np.where(bad, 1.0, a) for a in (x, y, z))
        best, face = np.full(len(x), -2.0), np.zeros(len(x), "int64")
        for i, (cx, cy, cz) in enumerate(centres):
            dot = cx * x + cy * y + cz * z
            nearer = dot > best
            best, face = np.where(nearer, dot, best), np.where(nearer, i, face)
        m = weights[face]
        a, s, t = (m[:, k] * x + m[:, k + 1] * y + m[:, k + 2] * z for k in (0, 3, 6))
        total, upper = a + s + t, uppers[face]
        cut = lambda w: pa.array(np.clip((w * steps).astype("int64"), 0, steps - 1), mask=bad)
        parts = [pa.array(diamonds[face], mask=bad), cut(np.where(upper, 1 - t / total, s / total)), cut(np.where(upper, 1 - s / total, t / total))]
        return pa.StructArray.from_arrays(parts, ["diamond", "u", "v"])

    at = F.arrow_udf(coded, "diamond int, u bigint, v bigint")(F.radians(lat), F.radians(lon))
    return df.withColumn("_at", at).withColumns({c: F.col("_at")[c] for c in ("diamond", "u", "v")}).drop("_at")


def locate(df: DataFrame, diamond: str, u: str, v: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with lat and lon of continuous diamond coordinates (0 to 1)."""
    # a lambda over the axes is evaluated outside whole-stage code, which keeps a chain of grid functions below the JVM compiler's limit for one method
    corners = F.array(*[F.array(*[F.struct(*[F.lit(float(VERTICES[k][a])).alias(n) for k, n in zip(d, "aqrb", strict=True)]) for a in range(3)]) for d in DIAMONDS])
    cu, cv = F.col(u), F.col(v)
    lower = cu + cv <= 1
    out = df.withColumns({"_wa": F.when(lower, 1 - cu - cv).otherwise(0.0), "_wq": F.when(lower, cu).otherwise(1 - cv), "_wr": F.when(lower, cv).otherwise(1 - cu), "_wb": F.when(lower, 0.0).otherwise(cu + cv - 1)})
    out = out.withColumn("_c", F.transform(F.get(corners, F.col(diamond).cast("int")), lambda c: c["a"] * F.col("_wa") + c["q"] * F.col("_wq") + c["r"] * F.col("_wr") + c["b"] * F.col("_wb")))
    out = out.withColumns({"_px": F.get("_c", F.lit(0)), "_py": F.get("_c", F.lit(1)), "_pz": F.get("_c", F.lit(2))})
    norm = F.sqrt(F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py") + F.col("_pz") * F.col("_pz"))
    return out.withColumns({lat: F.degrees(F.asin(F.col("_pz") / norm)), lon: F.degrees(F.atan2("_py", "_px"))}).drop("_c", "_wa", "_wq", "_wr", "_wb", "_px", "_py", "_pz")


def decode(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the place in the middle of the finest cell (diamond, u, v)."""
    out = df.withColumns({"_u": (F.col("u") + 0.5) / STEPS, "_v": (F.col("v") + 0.5) / STEPS})
    return locate(out, "diamond", "_u", "_v", lat, lon).drop("_u", "_v")


def prefix(depth: int, diamond: Column | None = None, u: Column | None = None, v: Column | None = None) -> Column:
    """The cell of a depth (29 at most) that holds diamond, u, v."""
    d, u, v = F.col("diamond") if diamond is None else diamond, F.col("u") if u is None else u, F.col("v") if v is None else v
    return F.shiftleft(d.cast("bigint"), 2 * depth).bitwiseOR(morton(F.shiftright(u, 30 - depth), F.shiftright(v, 30 - depth)))


def ancestor(prefix: Column, levels: int | Column) -> Column:
    return F.shiftright(prefix, 2 * levels) if isinstance(levels, int) else F.call_function("shiftright", prefix, (2 * levels).cast("int"))


def child(prefix: Column, i: int | Column) -> Column:
    return F.shiftleft(prefix, 2).bitwiseOR(F.lit(i) if isinstance(i, int) else i)


def contains(depth: Column, prefix: Column, other_depth: Column, other: Column) -> Column:
    """Whether the second cell is the first or lies in it."""
    return (other_depth >= depth) & (ancestor(other, F.greatest(other_depth - depth, F.lit(0))) == prefix)


def cell_diamond(depth: int | Column, prefix: Column) -> Column:
    return ancestor(prefix, depth)


def grid(depth: int, prefix: Column) -> tuple[Column, Column]:
    """A cell's column and row in its diamond."""
    m = prefix.bitwiseAND((1 << (2 * depth)) - 1)
    return compact(F.shiftright(m, 1)), compact(m)


def cell_edge_m(depth: Column) -> Column:
    return F.lit(EDGE_ARC * EARTH_RADIUS_M) / F.pow(F.lit(2.0), depth)


def texel_m(depth: Column) -> Column:
    return F.lit(TEXEL_BASE_M) / F.pow(F.lit(2.0), depth) / TEX


def texel_index(tx: Column, ty: Column, half: Column) -> Column:
    return F.shiftleft(F.shiftleft(ty, TEX_BITS).bitwiseOR(tx), 1).bitwiseOR(half)


def texel(depth: int) -> Column:
    """The triangle texel, within its cell, of (diamond, u, v): the square, and the side of its diagonal."""
    shift = 30 - depth - TEX_BITS
    low = (1 << shift) - 1
    at = lambda c: F.shiftright(F.col(c), shift).bitwiseAND(TEX - 1)
    half = ((F.col("u").bitwiseAND(low) + F.col("v").bitwiseAND(low)) >= (1 << shift)).cast("bigint")
    return texel_index(at("u"), at("v"), half)


def texel_parts(t: Column) -> tuple[Column, Column, Column]:
    """(tx, ty, half) of an index."""
    return F.shiftright(t, 1).bitwiseAND(TEX - 1), F.shiftright(t, 1 + TEX_BITS), t.bitwiseAND(1)


def texel_parent(prefix: Column, t: Column) -> tuple[Column, Column]:
    """The cell and texel one depth coarser."""
    tx, ty, half = texel_parts(t)
    up = F.when((tx % 2 == 1) & (ty % 2 == 1), 1).when((tx % 2 == 0) & (ty % 2 == 0), 0).otherwise(half)
    quarter = lambda bit: F.shiftleft(F.shiftright(prefix, bit).bitwiseAND(1), TEX_BITS - 1)
    return F.shiftright(prefix, 2), texel_index(quarter(1) + F.shiftright(tx, 1), quarter(0) + F.shiftright(ty, 1), up.cast("bigint"))


def texel_children(t: Column) -> Column:
    """The four texels one depth finer, as array of (quarter of the cell, index), in the order apex, +v, +u, middle."""
    tx, ty, half = texel_parts(t)
    x, y = 2 * tx, 2 * ty

    def one(dx: Column | int, dy: Column | int, h: Column) -> Column:
        cx, cy = x + dx, y + dy
        quarter = F.shiftleft(F.shiftright(cx, TEX_BITS), 1).bitwiseOR(F.shiftright(cy, TEX_BITS))
        return F.struct(quarter.alias("quarter"), texel_index(cx.bitwiseAND(TEX - 1), cy.bitwiseAND(TEX - 1), h).alias("texel"))

    return F.array(one(half, half, half), one(0, 1, half), one(1, 0, half), one(half, half, 1 - half))


def texel_neighbours(t: Column) -> Column:
    """The texels across the three edges, within the cell."""
    tx, ty, half = texel_parts(t)
    step = F.when(half == 0, -1).otherwise(1)
    near = F.array(F.struct(tx.alias("x"), ty.alias("y")), F.struct((tx + step).alias("x"), ty.alias("y")), F.struct(tx.alias("x"), (ty + step).alias("y")))
    inside = F.filter(near, lambda n: (n["x"] >= 0) & (n["x"] < TEX) & (n["y"] >= 0) & (n["y"] < TEX))
    return F.transform(inside, lambda n: texel_index(n["x"], n["y"], 1 - half))


def triangle_code() -> Column:
    """Of (diamond, u, v): diamond, face, and 29 digits that name the sub-triangle at each level. A digit is the pair of bits unless they are equal, then 3 where the half changes and 0 where it stays; the half at a level is the carry of u + v there.

    All levels are formed at once, as the digits' high and low bits: spelled level by level, the code is too large for the JVM's compiler.
    """
    u, v = F.col("u"), F.col("v")
    carries = (u + v).bitwiseXOR(u).bitwiseXOR(v)
    differ, turns = u.bitwiseXOR(v), carries.bitwiseXOR(F.shiftright(carries, 1))
    bits = lambda w: F.shiftright(differ.bitwiseAND(w).bitwiseOR(F.bitwise_not(differ).bitwiseAND(turns)), 1).bitwiseAND((1 << 29) - 1)
    top = F.shiftleft(F.col("diamond").cast("bigint"), 59).bitwiseOR(F.shiftleft(F.shiftright(carries, 30).bitwiseAND(1), 58))
    return top.bitwiseOR(morton(bits(u), bits(v)))


def cover(df: DataFrame, depth: int, lat0: str = "lat0", lon0: str = "lon0", lat1: str = "lat1", lon1: str = "lon1") -> DataFrame:
    """df with prefix, a row for each cell of a depth met by a grid of samples over a box: half a cell apart, an eighth of the box at most, and 0.0001 degrees at least."""
    half = EDGE_ARC * EARTH_RADIUS_M / (1 << depth) / 2 / 111_320
    step = lambda a, b: F.greatest(F.least(F.lit(half), (F.col(b) - F.col(a)) / 8), F.lit(1e-4))
    out = df.withColumns({"_ds": step(lat0, lat1), "_dl": step(lon0, lon1)})
    n = lambda a, b, s: F.ceil((F.col(b) - F.col(a)) / F.col(s)).cast("int")
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), n(lat0, lat1, "_ds")))).withColumn("_j", F.explode(F.sequence(F.lit(0), n(lon0, lon1, "_dl"))))
    out = out.withColumns({"_lat": F.least(F.col(lat0) + F.col("_i") * F.col("_ds"), F.col(lat1)), "_lon": F.least(F.col(lon0) + F.col("_j") * F.col("_dl"), F.col(lon1))})
    return encode(out, "_lat", "_lon").withColumn("prefix", prefix(depth)).select(*df.columns, "prefix").distinct()


def from_grid(depth: int, diamond: Column, cu: Column, cv: Column) -> Column:
    """The cell at a column and row of a diamond."""
    return F.shiftleft(diamond.cast("bigint"), 2 * depth).bitwiseOR(morton(cu, cv))


def texel_place(df: DataFrame, depth: int, cell: str = "prefix", texel: str = "texel", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the place of a texel's centroid."""
    gu, gv = grid(depth, F.col(cell))
    tx, ty, half = texel_parts(F.col(texel))
    off = F.when(half == 0, F.lit(1.0) / 3).otherwise(F.lit(2.0) / 3)
    out = df.withColumns({"_d": cell_diamond(depth, F.col(cell)).cast("int"), "_tu": (gu * TEX + tx + off) / (TEX << depth), "_tv": (gv * TEX + ty + off) / (TEX << depth)})
    return locate(out, "_d", "_tu", "_tv", lat, lon).drop("_d", "_tu", "_tv")


def texels_around(t: Column) -> Column:
    """Both halves of the 3 x 3 squares around a texel, without it, within the cell: 17 at most."""
    tx, ty, _ = texel_parts(t)
    near = F.array(*[F.struct((tx + dx).alias("x"), (ty + dy).alias("y"), F.lit(h).cast("bigint").alias("h")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for h in (0, 1)])
    inside = F.filter(near, lambda n: n["x"].between(0, TEX - 1) & n["y"].between(0, TEX - 1))
    return F.filter(F.transform(inside, lambda n: texel_index(n["x"], n["y"], n["h"])), lambda j: j != t)


def from_triangle_code(code: Column) -> Column:
    """(diamond, u, v) in the triangle that a code names: where a digit's two bits differ they are those of u and v, elsewhere both are the half there, which turns after each digit 3 from the coarsest on."""
    digits, face = code.bitwiseAND((1 << 58) - 1), F.shiftright(code, 58).bitwiseAND(1)
    bits = F.struct(F.shiftleft(compact(F.shiftright(digits, 1)), 1).alias("u"), F.shiftleft(compact(digits), 1).alias("v"), (face * (STEPS - 1)).alias("half"))

    def read(b: Column) -> Column:
        differ, threes = b["u"].bitwiseXOR(b["v"]), F.shiftright(b["u"].bitwiseAND(b["v"]), 1)
        # at each level whether the number of 3s above it is odd
        odd = F.aggregate(F.array(*[F.lit(1 << k) for k in range(5)]), threes, lambda t, k: t.bitwiseXOR(F.call_function("shiftright", t, k)))
        same = F.bitwise_not(differ).bitwiseAND(odd.bitwiseXOR(b["half"]))
        return F.struct(differ.alias("differ"), same.alias("same"), b["u"].alias("u"), b["v"].alias("v"))

    at = lambda b, w: b["differ"].bitwiseAND(b[w]).bitwiseOR(b["same"])
    place = lambda b: F.struct(F.shiftrightunsigned(code, 59).cast("int").alias("diamond"), at(b, "u").alias("u"), at(b, "v").alias("v"))
    # a lambda over one element names what is used more than once
    return F.get(F.transform(F.transform(F.array(bits), read), place), F.lit(0))


def disk_order(t: Column) -> Column:
    """A texel's place in the order of the triangle hierarchy of its cell: the half of the whole cell, then for each of 8 levels which of four children, in the order of `texel_children`."""
    tx, ty, half = texel_parts(t)
    # from the texel up: the parent's half, and which child this is
    begin = F.struct(tx.alias("x"), ty.alias("y"), half.alias("h"), F.lit(0).cast("bigint").alias("path"))

    def step(s: Column, k: Column) -> Column:
        x1, y1 = s["x"] % 2, s["y"] % 2
        up = F.when((x1 == 1) & (y1 == 1), 1).when((x1 == 0) & (y1 == 0), 0).otherwise(s["h"])
        child = F.when(up != s["h"], 3).when(x1 == y1, 0).when(y1 == 1, 1).otherwise(2)
        return F.struct(F.shiftright(s["x"], 1).alias("x"), F.shiftright(s["y"], 1).alias("y"), up.cast("bigint").alias("h"), (s["path"] + F.call_function("shiftleft", child.cast("bigint"), (2 * k).cast("int"))).alias("path"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TEX_BITS - 1)), begin, step, lambda s: F.shiftleft(s["h"], 2 * TEX_BITS) + s["path"])


def file_name(depth: Column, prefix: Column) -> Column:
    """Two digits of the depth and sixteen of the cell, moved up to the finest depth, in lower-case hexadecimal."""
    raw = F.call_function("shiftleft", prefix, (60 - 2 * depth).cast("int"))
    return F.concat(F.lpad(depth.cast("string"), 2, "0"), F.lpad(F.lower(F.hex(raw)), 16, "0"))


def from_file_name(name: Column) -> Column:
    """(depth, prefix) of a file name, whatever follows its 18 characters; null for another form."""
    depth, raw = F.substring(name, 1, 2).try_cast("int"), F.conv(F.substring(name, 3, 16), 16, -10).cast("bigint")
    good = F.substring(name, 1, 18).rlike("^[0-9]{2}[0-9a-fA-F]{16}$") & (depth <= 30)
    return F.when(good, F.struct(depth.alias("depth"), F.call_function("shiftrightunsigned", raw, (60 - 2 * depth).cast("int")).alias("prefix")))


def base64url(data: Column) -> Column:
    """Bytes spelled as a name: base 64 with - and _, without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/=", "-_ "))


def _samples(regions: DataFrame, depth: int, n: int, margin: float) -> DataFrame:
    """regions (prefix) with places of an (n + 1) x (n + 1) grid that reaches a share `margin` of the cell past its edges."""
    gu, gv = grid(depth, F.col("prefix"))
    at = lambda c: F.lit(-margin) + F.lit(1 + 2 * margin) * c / n
    out = regions.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n))))
    out = out.withColumns({"_d": cell_diamond(depth, F.col("prefix")).cast("int"), "_su": (gu + at(F.col("_i"))) / (1 << depth), "_sv": (gv + at(F.col("_j"))) / (1 << depth)})
    out = locate(out, "_d", "_su", "_sv", "_lat", "_lon").drop("_d", "_su", "_sv", "_i", "_j")
    return out.withColumn("_lon", F.pmod(F.col("_lon") + 180, F.lit(360.0)) - 180)


def degree_squares(regions: DataFrame, depth: int) -> DataFrame:
    """(prefix, lat, lon): the one-degree squares (south-west corners) that regions touch, by samples two per cent past their edges."""
    return _samples(regions, depth, 96, 0.02).select("prefix", F.floor(F.col("_lat") + 1e-9).cast("int").alias("lat"), F.floor(F.col("_lon") + 1e-9).cast("int").alias("lon")).distinct()


def region_boxes(regions: DataFrame, depth: int) -> DataFrame:
    """(prefix, part, lat0, lon0, lat1, lon1): boxes of regions, samples three per cent past the edges and 0.05 degrees more; the whole width at a pole, two boxes (a, b) across the date line."""
    s = _samples(regions, depth, 48, 0.03)
    lon = F.col("_lon")
    g = s.groupBy("prefix").agg(F.min("_lat").alias("s"), F.max("_lat").alias("n"), F.max((F.abs("_lat") > 89.5).cast("int")).alias("pole"), F.min("_lon").alias("w"), F.max("_lon").alias("e"), F.min(F.when(lon > 0, lon)).alias("east"), F.max(F.when(lon < 0, lon)).alias("west"))
    box = lambda part, w, e: F.struct(F.lit(part).alias("part"), w.alias("lon0"), e.alias("lon1"))
    less, more = lambda c: F.greatest(F.col(c) - 0.05, F.lit(-180.0)), lambda c: F.least(F.col(c) + 0.05, F.lit(180.0))
    boxes = F.when(F.col("pole") == 1, F.array(box("", F.lit(-180.0), F.lit(180.0)))).when(F.col("e") - F.col("w") > 180, F.array(box("a", less("east"), F.lit(180.0)), box("b", F.lit(-180.0), more("west")))).otherwise(F.array(box("", less("w"), more("e"))))
    g = g.withColumn("b", F.explode(boxes))
    return g.select("prefix", "b.part", F.greatest(F.col("s") - 0.05, F.lit(-90.0)).alias("lat0"), "b.lon0", F.least(F.col("n") + 0.05, F.lit(90.0)).alias("lat1"), "b.lon1")
