"""Polygons and sets of cells and texels: points in polygons, interior points, covers, selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from . import search


def _edges(rings: Column) -> Column:
    """Consecutive pairs of all rings: array of (y0, x0, y1, x1)."""
    pair = lambda a, b: F.struct(a["lat"].alias("y0"), a["lon"].alias("x0"), b["lat"].alias("y1"), b["lon"].alias("x1"))
    one = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: pair(F.get(r, i - 1), F.get(r, i)))
    return F.flatten(F.transform(rings, one))


def _crossings(rings: Column, lat: Column) -> Column:
    """Where the line of a latitude crosses the edges, in order."""
    hit = F.filter(_edges(rings), lambda e: (e["y0"] <= lat) != (e["y1"] <= lat))
    return F.array_sort(F.transform(hit, lambda e: e["x0"] + (lat - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"])))


def envelopes(polygons: DataFrame, key: str) -> DataFrame:
    """(key, lat0, lon0, lat1, lon1) of rings (array<array<struct<lat, lon>>>)."""
    lat, lon = F.transform(F.flatten("rings"), lambda p: p["lat"]), F.transform(F.flatten("rings"), lambda p: p["lon"])
    return polygons.select(key, F.array_min(lat).alias("lat0"), F.array_min(lon).alias("lon0"), F.array_max(lat).alias("lat1"), F.array_max(lon).alias("lon1"))


#: Edges that one row holds at most.
EDGES = 1000
#: Runs of squares inside a polygon are told in blocks of so many squares, aligned.
BLOCKS = (1, 16, 256)


def _side(x: Column, y: Column) -> Column:
    """On which side of an edge (x0, y0, x1, y1) a place lies that is moved a little up and still less to the right: one product for all tests, so they never contradict each other."""
    s = (F.col("x1") - F.col("x0")) * (y - F.col("y0")) - (x - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return F.when(s != 0, s).when(F.col("x1") != F.col("x0"), F.col("x1") - F.col("x0")).otherwise(F.col("y0") - F.col("y1"))


def _left(x: Column, y: Column) -> Column:
    """Whether an edge that crosses the height y does so left of x."""
    return F.when(F.col("y1") > F.col("y0"), _side(x, y) < 0).otherwise(_side(x, y) > 0)


def _above(x: Column, y: Column) -> Column:
    """Whether an edge that crosses the line at x does so above y."""
    return F.when(F.col("x1") > F.col("x0"), _side(x, y) < 0).otherwise(_side(x, y) > 0)


def edges_of(polygons: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1): the edges of all rings (closed)."""
    return polygons.select(key, F.explode(_edges(F.col("rings"))).alias("e")).select(key, *(F.col(f"e.{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x0 <> x1 OR y0 <> y1")


def in_squares(edges: DataFrame, side: float) -> DataFrame:
    """Edges with the squares (sx, sy) that each one passes or comes next to touching: about as many rows as it crosses squares. An edge on a line between squares belongs to both sides."""
    slack = side * 1e-6
    e = edges.withColumn("sx", F.explode(F.sequence(F.floor((F.least("x0", "x1") - slack) / side), F.floor((F.greatest("x0", "x1") + slack) / side))))
    left, right = F.greatest(F.least("x0", "x1"), F.col("sx") * side), F.least(F.greatest("x0", "x1"), (F.col("sx") + 1) * side)
    at = lambda x: F.when(F.col("x0") == F.col("x1"), F.col("y0")).otherwise(F.col("y0") + (x - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    ends = [F.when(F.col("x0") == F.col("x1"), F.col("y0")).otherwise(at(left)), F.when(F.col("x0") == F.col("x1"), F.col("y1")).otherwise(at(right))]
    return e.withColumn("sy", F.explode(F.sequence(F.floor((F.least(*ends) - slack) / side), F.floor((F.greatest(*ends) + slack) / side))))


def cover(edges: DataFrame, key: str, side: float) -> tuple[DataFrame, DataFrame]:
    """How polygons lie on squares. (key, sx, sy, odd): each square that an edge passes, and whether its lower left corner is inside; (key, block, bx, sy): aligned blocks of squares of a row that lie inside whole."""
    touched = in_squares(edges, side).select(key, "sx", "sy").distinct()
    # how often the lower side of each row is crossed, by column: the crossing lies right of that column's corner and left of the next one's
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = F.sequence(F.ceil(low / side) - 1, F.ceil(high / side) + 1)
    x = edges.withColumn("sy", F.explode(rows)).withColumn("_y", F.col("sy") * side).where((F.col("y0") <= F.col("_y")) != (F.col("y1") <= F.col("_y")))
    guess = F.floor((F.col("x0") + (F.col("_y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))) / side)
    x = x.withColumn("sx", guess)
    x = x.withColumn("sx", F.when(_left(F.col("sx") * side, F.col("_y")), F.col("sx") - 1).when(~_left((F.col("sx") + 1) * side, F.col("_y")), F.col("sx") + 1).otherwise(F.col("sx")))
    marks = x.groupBy(key, "sx", "sy").agg(F.count("*").alias("n")).withColumn("here", F.lit(False))
    marks = marks.unionByName(touched.withColumns({"n": F.lit(0).cast("bigint"), "here": F.lit(True)})).groupBy(key, "sx", "sy").agg(F.sum("n").alias("n"), F.max("here").alias("here"))
    w = Window.partitionBy(key, "sy").orderBy("sx")
    told = marks.withColumns({"odd": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1, "after": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1, "next": F.lead("sx").over(w)})
    border = told.where("here").select(key, "sx", "sy", "odd")
    whole = told.where("after AND next > sx + 1").select(key, "sy", (F.col("sx") + 1).alias("a"), F.col("next").alias("b"))
    runs = []
    for small, large in zip(BLOCKS, [*BLOCKS[1:], None], strict=True):
        # what fits into no larger block: before the first and after the last of those
        up, down = F.ceil(F.col("a") / small) * small, F.floor(F.col("b") / small) * small
        begin, end = (up, down) if large is None else (F.ceil(F.col("a") / large) * large, F.floor(F.col("b") / large) * large)
        span = lambda p, q: F.when(q > p, F.sequence((p / small).cast("bigint"), (q / small).cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))  # noqa: B023, E731
        blocks = span(up, down) if large is None else F.when(begin >= end, span(up, down)).otherwise(F.concat(span(up, begin), span(end, down)))
        runs.append(whole.select(key, "sy", F.explode(blocks).alias("bx"), F.lit(small).alias("block")))
    inside = runs[0]
    for r in runs[1:]:
        inside = inside.unionByName(r)
    return border, inside


def points_in(points: DataFrame, polygons: DataFrame, per_degree: int = 20) -> DataFrame:
    """Pairs of points (lat, lon) and polygons (rings, closed) that hold them by the even-odd rule.

    Edges are cut by squares and held in rows of EDGES at most; a spot looks only at the edges in its own square, which say whether it lies on the side of the square's corner, and blocks of squares inside a polygon have no edges at all. Spots are looked up once, whatever the number of points there.
    """
    (key,) = [c for c in polygons.columns if c != "rings"]
    side = 1.0 / per_degree
    edges = edges_of(polygons, key)
    border, inside = cover(edges, key, side)
    square = lambda c: F.floor(F.col(c) / side)
    spots = points.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL").distinct().withColumns({"sx": square("lon"), "sy": square("lat")})
    numbered = in_squares(edges, side).withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(key, "sx", "sy").orderBy("x0", "y0", "x1", "y1")) - 1) / EDGES))
    held = numbered.groupBy(key, "sx", "sy", "_chunk").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_edges"))
    held = held.join(border, [key, "sx", "sy"]).withColumn("_odd", (F.col("odd") & (F.col("_chunk") == 0)).cast("int")).drop("odd")
    near = spots.join(held, ["sx", "sy"]).withColumns({"_x": F.col("sx") * side, "_y": F.col("sy") * side})

    def crossed(e: Column) -> Column:
        """1 where the way from the square's corner up and then right to the spot crosses the edge, else 0 (or 2)."""
        x0, y0, x1, y1 = (e[c] for c in ("x0", "y0", "x1", "y1"))

        def side_of(x: Column, y: Column) -> Column:
            s = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
            return F.when(s != 0, s).when(x1 != x0, x1 - x0).otherwise(y0 - y1)

        turn, corner = side_of(F.col("_x"), F.col("lat")), side_of(F.col("_x"), F.col("_y"))
        above = lambda s: F.when(x1 > x0, s < 0).otherwise(s > 0)
        left = F.when(y1 > y0, turn < 0).otherwise(turn > 0)
        up = ((x0 <= F.col("_x")) != (x1 <= F.col("_x"))) & (above(turn) != above(corner))
        over = ((y0 <= F.col("lat")) != (y1 <= F.col("lat"))) & (left != (x0 + (F.col("lat") - y0) / (y1 - y0) * (x1 - x0) <= F.col("lon")))
        return F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(over, F.lit(False)).cast("int")

    count = F.aggregate("_edges", F.lit(0), lambda a, e: a + crossed(e))
    beside = near.select("lat", "lon", key, (count + F.col("_odd")).alias("n")).groupBy("lat", "lon", key).agg(F.sum("n").alias("n")).where("n % 2 = 1").select("lat", "lon", key)
    blocks = spots.withColumn("block", F.explode(F.array(*map(F.lit, BLOCKS)))).withColumn("bx", F.floor(F.col("sx") / F.col("block")))
    amid = blocks.join(inside, ["block", "bx", "sy"]).select("lat", "lon", key)
    return points.join(beside.unionByName(amid), ["lat", "lon"]).select(*points.columns, key)


def interior_point(rings: Column) -> Column:
    """(lat, lon) well inside an outline: across the latitude of the largest ring's centroid, the middle of the widest run inside, the last of equals; null without area or with under four points."""
    cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    total = lambda es, f: F.aggregate(F.transform(es, f), F.lit(0.0), lambda a, x: a + x)
    area = lambda r: F.abs(total(_edges(F.array(r)), cross)) * F.cos(F.radians(F.get(r, F.lit(0))["lat"]))
    largest = F.array_max(F.transform(rings, lambda r, i: F.struct(area(r).alias("a"), i.alias("i"), r.alias("r"))))["r"]

    def inside(r: Column) -> Column:
        es = _edges(F.array(r))
        lat = total(es, lambda e: (e["y0"] + e["y1"]) * cross(e)) / (3 * total(es, cross))
        xs = lambda y: _crossings(rings, y)
        runs = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(x) / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.round(F.get(x, 2 * k + 1) - F.get(x, 2 * k), 9).alias("w"), k.alias("k"), ((F.get(x, 2 * k) + F.get(x, 2 * k + 1)) / 2).alias("lon")))
        widest = F.array_max(F.flatten(F.transform(F.array(lat), lambda y: runs(xs(y)))))
        return F.struct(lat.alias("lat"), widest["lon"].alias("lon"))

    return F.when(F.size(largest) >= 4, F.get(F.transform(F.array(largest), inside), F.lit(0)))


def envelopes_meet(boxes: DataFrame, others: DataFrame, pad: float = 0.0, per_degree: int = 4) -> DataFrame:
    """Pairs of boxes and others whose boxes overlap, with a pad; the columns of boxes and those of others but for their box, each pair once."""
    pairs = search.meeting_squares(boxes, others, per_degree, pad)
    return pairs.select("a.*", *(F.col(f"b.{c}") for c in others.columns if c not in ("lat0", "lon0", "lat1", "lon1")))


def shape_cells(texels: DataFrame, own: int, depth: int) -> DataFrame:
    """(prefix): the cells of a depth that a shape, drawn as texels (prefix, texel) of depth `own`, covers: exact for eight levels down, below that all descendants of a covered square."""
    if depth <= own:
        return texels.select(C.ancestor(F.col("prefix"), own - depth).alias("prefix")).distinct()
    k = min(depth - own, C.TEX_BITS)
    tx, ty, _ = C.texel_parts(F.col("texel"))
    cell = F.shiftleft("prefix", 2 * k).bitwiseOR(C.morton(F.shiftright(tx, C.TEX_BITS - k), F.shiftright(ty, C.TEX_BITS - k)))
    out = texels.select(cell.alias("prefix")).distinct()
    if (extra := depth - own - k) > 0:
        out = out.select((F.shiftleft("prefix", 2 * extra) + F.explode(F.sequence(F.lit(0), F.lit((1 << 2 * extra) - 1)))).alias("prefix"))
    return out


def all_depths(cells: DataFrame, depth: int) -> DataFrame:
    """(depth, prefix): cells of a depth with all their ancestors, each once. Each level comes from the distinct cells of the one below."""
    out, level = cells.select(F.lit(depth).alias("depth"), "prefix"), cells.select("prefix")
    ups = level.withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(depth)))) if depth else None
    if ups is None:
        return out
    return out.unionByName(ups.select((F.lit(depth) - F.col("up")).alias("depth"), C.ancestor(F.col("prefix"), F.col("up")).alias("prefix")).distinct())


def select_texels(selection: DataFrame, drawn: DataFrame, add: bool) -> DataFrame:
    """(prefix, texel, cov) with drawn texels set to 255, or to 0 where they are taken away."""
    value = 255 if add else 0
    both = selection.join(drawn.select("prefix", "texel").distinct().withColumn("_d", F.lit(True)), ["prefix", "texel"], "full_outer")
    return both.select("prefix", "texel", F.when(F.col("_d"), value).otherwise(F.col("cov")).alias("cov"))


def capped(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def kept(df: DataFrame, line: Callable[[Column], Column] | None = None, area: Callable[[Column], Column] | None = None) -> DataFrame:
    """Features (kind) that predicates on lines (under 32) and areas (32 to 63) let through; without a predicate all of them."""
    k = F.col("kind")
    test = lambda f: F.lit(True) if f is None else F.coalesce(f(k), F.lit(False))
    return df.where(F.when(k < 32, test(line)).when(k < 64, test(area)).otherwise(True))
