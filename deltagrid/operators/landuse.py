"""Preparing land-use layers: places out of the equal-area conic projection that they come in, polygons and lines cut to many boxes at once, fields as text.

An edge goes to the boxes it meets and is clipped there by expressions; what a box's own sides add to a cut polygon follows
from where the edges cross them and from whether its lower left corner lies inside. No polygon travels whole, and one that
covers a box without crossing it costs four edges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import areas, search

_BOX = ("lat0", "lon0", "lat1", "lon1")
_EDGE = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Conic:
    """An equal-area conic projection of the ellipsoid; as it stands, the one for the conterminous states."""

    # The ellipsoid's axis and flattening, the standard parallels, the origin.
    a: float = 6_378_137.0
    f: float = 1 / 298.257222101
    parallel1: float = 29.5
    parallel2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def _q(self, sin: float) -> float:
        e = self.e
        return (1 - e * e) * (sin / (1 - e * e * sin * sin) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))

    @cached_property
    def cone(self) -> tuple[float, float, float]:
        """(n, c, rho0)."""
        s1, s2, s0 = (math.sin(math.radians(p)) for p in (self.parallel1, self.parallel2, self.lat0))
        m = lambda s: (1 - s * s) / (1 - self.e**2 * s * s)
        n = (m(s1) - m(s2)) / (self._q(s2) - self._q(s1))
        c = m(s1) + n * self._q(s1)
        return n, c, self.a * math.sqrt(c - n * self._q(s0)) / n

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) in metres."""
        n, c, rho0 = self.cone
        e, s = self.e, F.sin(F.radians(lat))
        q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = self.a * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) in degrees: the latitude of equal area by its series, then one step of Newton's, which leaves no error that a double shows."""
        n, c, rho0 = self.cone
        e2 = self.e**2
        rho2 = x * x + (rho0 - y) * (rho0 - y)
        q = (c - rho2 * (n / self.a) ** 2) / n
        beta = F.asin(F.least(F.greatest(q / self._q(1.0), F.lit(-1.0)), F.lit(1.0)))
        series = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)

        def better(phi: Column) -> Column:
            s = F.sin(phi)
            k, step = 1 - e2 * s * s, F.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e)
            return phi + k * k / (2 * F.cos(phi)) * (q / (1 - e2) - s / k + step)

        lat = F.get(F.transform(F.array(series), better), F.lit(0))
        return F.degrees(lat), self.lon0 + F.degrees(F.atan2(x, rho0 - y)) / n


def widened(boxes: DataFrame, pad: float = 0.02) -> DataFrame:
    """boxes (box, lat0, lon0, lat1, lon1) a little past their sides, so that what lies there reaches the cells at the edge whole."""
    return boxes.select("box", *((F.col(c) + (-pad if c.endswith("0") else pad)).alias(c) for c in _BOX))


def clipped(edges: DataFrame, boxes: DataFrame, keep: tuple[str, ...], closed: bool = True) -> DataFrame:
    """(keep, box, x0, y0, x1, y1): the part of each edge (x: longitude, y: latitude) inside each box that it meets. closed=False leaves out what lies on a box's lower or left side, so that of two boxes side by side one has it."""
    spans = edges.select(*keep, *_EDGE, F.least("y0", "y1").alias("lat0"), F.least("x0", "x1").alias("lon0"), F.greatest("y0", "y1").alias("lat1"), F.greatest("x0", "x1").alias("lon1"))
    j = search.meeting_squares(spans, boxes, 8.0).select(*(F.col(f"a.{c}").alias(c) for c in (*keep, *_EDGE)), "b.*")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # the share of the edge between the two lines of each pair of sides; an edge along them is inside, as its box meets
    share = lambda d, p, lo, hi: (F.when(d == 0, 0.0).otherwise(F.least((F.col(lo) - F.col(p)) / d, (F.col(hi) - F.col(p)) / d)), F.when(d == 0, 1.0).otherwise(F.greatest((F.col(lo) - F.col(p)) / d, (F.col(hi) - F.col(p)) / d)))
    (ax, bx), (ay, by) = share(dx, "x0", "lon0", "lon1"), share(dy, "y0", "lat0", "lat1")
    j = j.withColumns({"_s": F.greatest(F.lit(0.0), ax, ay), "_t": F.least(F.lit(1.0), bx, by)}).where("_s < _t")
    if not closed:
        j = j.where(~((dy == 0) & (F.col("y0") == F.col("lat0"))) & ~((dx == 0) & (F.col("x0") == F.col("lon0"))))
    # ends that are not cut stay as they are
    end = lambda p, d, t, whole, other: F.when(t == whole, F.col(other)).otherwise(F.col(p) + d * t)
    s, t = F.col("_s"), F.col("_t")
    return j.select(*keep, "box", end("x0", dx, s, 0.0, "x0").alias("x0"), end("y0", dy, s, 0.0, "y0").alias("y0"), end("x0", dx, t, 1.0, "x1").alias("x1"), end("y0", dy, t, 1.0, "y1").alias("y1"))


def _sides(edges: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, box, s): where edges cross a box's sides, from 0 at its lower left corner round to 4, against the clock."""
    spans = edges.select(key, *_EDGE, F.least("y0", "y1").alias("lat0"), F.least("x0", "x1").alias("lon0"), F.greatest("y0", "y1").alias("lat1"), F.greatest("x0", "x1").alias("lon1"))
    j = search.meeting_squares(spans, boxes, 8.0).select(*(F.col(f"a.{c}").alias(c) for c in (key, *_EDGE)), "b.*")
    wide, high = F.col("lon1") - F.col("lon0"), F.col("lat1") - F.col("lat0")

    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    left, above = lambda x, y: areas._left(F.col(x), F.col(y)), lambda x, y: areas._above(F.col(x), F.col(y))

    def across(line: str) -> Column:
        """Of a lower or upper side: which corners the crossing lies between is told by the same product as for points."""
        x = F.col("x0") + (F.col(line) - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
        on = ((F.col("y0") <= F.col(line)) != (F.col("y1") <= F.col(line))) & ~left("lon0", line) & left("lon1", line)
        return F.when(on, inside((x - F.col("lon0")) / wide))

    def up(line: str) -> Column:
        y = F.col("y0") + (F.col(line) - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        on = ((F.col("x0") <= F.col(line)) != (F.col("x1") <= F.col(line))) & above(line, "lat0") & ~above(line, "lat1")
        return F.when(on, inside((y - F.col("lat0")) / high))

    places = F.array_compact(F.array(across("lat0"), 1 + up("lon1"), 3 - across("lat1"), 4 - up("lon0")))
    return j.select(key, "box", F.explode(places).alias("s"))


def cut(polygons: DataFrame, boxes: DataFrame, key: str, per_degree: int = 8) -> DataFrame:
    """(key, box, x0, y0, x1, y1): the edges of each polygon (key, rings; closed, holes run the other way) inside each box, with the parts of the box's sides that bound it. The edges of a piece run around it against the clock, whichever way the polygon ran."""
    edges = areas.edges_of(polygons, key)
    turned = edges.groupBy(key).agg(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("_a"))
    flip = F.col("_a") < 0
    at = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    edges = edges.join(turned, key).select(key, at("x0", "x1").alias("x0"), at("y0", "y1").alias("y0"), at("x1", "x0").alias("x1"), at("y1", "y0").alias("y1"))
    inner = clipped(edges, boxes, (key,), closed=False)
    corners = areas.points_in(boxes.select("box", F.col("lat0").alias("lat"), F.col("lon0").alias("lon")), polygons, per_degree).select(key, "box").withColumn("odd", F.lit(True))
    met = _sides(edges, boxes, key).groupBy(key, "box").agg(F.sort_array(F.collect_list("s")).alias("s"))
    both = met.join(corners, [key, "box"], "full_outer")
    # inside between every second pair of crossings, from the corner on
    stops = F.coalesce("s", F.array().cast("array<double>"))
    stops = F.when(F.coalesce("odd", F.lit(False)), F.concat(F.array(F.lit(0.0)), stops)).otherwise(stops)
    both = both.withColumn("s", stops).withColumn("s", F.when(F.size("s") % 2 == 1, F.array_append("s", F.lit(4.0))).otherwise(F.col("s"))).where("size(s) > 0")
    run = F.transform(F.sequence(F.lit(0), (F.size("s") / 2 - 1).cast("int")), lambda i: F.struct(F.get("s", 2 * i).alias("a"), F.get("s", 2 * i + 1).alias("b")))
    both = both.select(key, "box", F.explode(run).alias("r")).where("r.a < r.b")
    both = both.withColumn("k", F.explode(F.sequence(F.floor("r.a"), F.ceil("r.b") - 1))).withColumns({"a": F.greatest(F.col("r.a") - F.col("k"), F.lit(0.0)), "b": F.least(F.col("r.b") - F.col("k"), F.lit(1.0))}).join(boxes, "box")

    def place(t: str) -> tuple[Column, Column]:
        wide, high, t_ = F.col("lon1") - F.col("lon0"), F.col("lat1") - F.col("lat0"), F.col(t)
        x = F.when(F.col("k") == 0, F.col("lon0") + wide * t_).when(F.col("k") == 1, F.col("lon1")).when(F.col("k") == 2, F.col("lon1") - wide * t_).otherwise(F.col("lon0"))
        y = F.when(F.col("k") == 0, F.col("lat0")).when(F.col("k") == 1, F.col("lat0") + high * t_).when(F.col("k") == 2, F.col("lat1")).otherwise(F.col("lat1") - high * t_)
        return x, y

    (xa, ya), (xb, yb) = place("a"), place("b")
    return inner.unionByName(both.select(key, "box", xa.alias("x0"), ya.alias("y0"), xb.alias("x1"), yb.alias("y1")))


def degrees2(pieces: DataFrame, key: str) -> DataFrame:
    """(key, box, area): square degrees of each piece."""
    return pieces.groupBy(key, "box").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))


def _text(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]


def owners(fee: DataFrame, proclaimed: DataFrame) -> DataFrame:
    """(key, manager, mtype, des, access) of fee land, and of reservations, which are proclaimed bounds: theirs unless a parcel says otherwise, so they are to be painted first. fee: key, d_Mang_Name, d_Mang_Type, d_Des_Tp, d_Pub_Access. proclaimed: key, d_Mang_Type, Unit_Nm."""
    own = fee.select("key", *(c.alias(n) for c, n in zip(_text("d_Mang_Name", "d_Mang_Type", "d_Des_Tp", "d_Pub_Access"), ("manager", "mtype", "des", "access"), strict=True)))
    tribal = proclaimed.where("d_Mang_Type = 'American Indian Lands'")
    return own.unionByName(tribal.select("key", F.lit("Tribal").alias("manager"), F.lit("American Indian Lands").alias("mtype"), F.coalesce(F.nullif(F.col("Unit_Nm"), F.lit("")), F.lit("Reservation")).alias("des"), F.lit("Unknown").alias("access")))


def wilderness(designated: DataFrame) -> DataFrame:
    """(key, des, name) of wilderness and wilderness study areas. designated: key, d_Des_Tp, Unit_Nm."""
    des, name = _text("d_Des_Tp", "Unit_Nm")
    return designated.where(F.col("d_Des_Tp").isin("Wilderness Area", "Wilderness Study Area")).select("key", des.alias("des"), name.alias("name"))


def motor_use(roads: DataFrame, trails: DataFrame) -> DataFrame:
    """(key, symbol, kind, seasonal, name). roads, trails: key, MVUM_SYMBO, SEASONAL, NAME."""
    one = lambda d, kind: d.select("key", *(c.alias(n) for c, n in zip(_text("MVUM_SYMBO", "SEASONAL", "NAME"), ("symbol", "seasonal", "name"), strict=True)), F.lit(kind).alias("kind"))
    return one(roads, "road").unionByName(one(trails, "trail"))
