"""Rasters as long tables (tile, px, py, v): sampling, slope, flatness, contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealt import dealt

NO_DATA = -12_000.0
#: Pixels of a block's side.
BLOCK = 256


def bilinear(points: DataFrame, raster: DataFrame) -> DataFrame:
    """Each point (id, tile, x, y in pixels) from its four pixels; those without a value lend their weight to the others. Null if none has one. Each point meets four pixels, so this is an equi-join on (tile, px, py)."""
    x0, y0 = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    corners = F.array(*[F.struct((x0 + i).cast("int").alias("px"), (y0 + j).cast("int").alias("py"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    p = points.withColumn("c", F.explode(corners)).select("id", "tile", "c.px", "c.py", "c.w")
    j = p.join(raster.where(F.col("v") > NO_DATA), ["tile", "px", "py"], "left")
    w = F.when(F.col("v").isNotNull(), F.col("w"))
    return j.groupBy("id", "tile").agg((F.sum(w * F.col("v")) / F.when(F.sum(w) > 0, F.sum(w))).alias("v"))


def profile(pairs: DataFrame, raster: DataFrame, samples: int) -> DataFrame:
    """(id, sample, v): heights at so many even places between two points of a tile (two at least). pairs: id, tile, x0, y0, x1, y1 in pixels."""
    n = max(samples, 2)
    s = pairs.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_t", F.col("_i") / (n - 1))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("_t")
    v = bilinear(s.select(F.struct("id", F.col("_i").alias("sample")).alias("id"), "tile", at("x0", "x1").alias("x"), at("y0", "y1").alias("y")), raster)
    return v.select("id.id", "id.sample", "v")


def first_with_data(samples: DataFrame, margin: float = 0.25) -> DataFrame:
    """(id, v): of a point's samples (id, priority, v, flat) the first; if that one lies on flattened water, the first later one that is lower by more than the margin, else the first."""
    held = samples.where(F.col("v").isNotNull())
    first = held.groupBy("id").agg(F.min(F.struct("priority", "v", "flat")).alias("f"))
    lower = held.join(first, "id").where(F.col("f.flat") & (F.col("priority") > F.col("f.priority")) & (F.col("v") < F.col("f.v") - margin)).groupBy("id").agg(F.min(F.struct("priority", "v")).alias("l"))
    return first.join(lower, "id", "left").select("id", F.coalesce("l.v", "f.v").alias("v"))


def around(raster: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel with its neighbours' values: rows go to blocks of BLOCK x BLOCK pixels, and to the blocks beside theirs that they are neighbours in; there they are dealt to the pixels that they neighbour, and grouped without another shuffle."""
    far = max(abs(d) for o in offsets for d in o)
    block = lambda c: F.floor(c / BLOCK)
    blocks = lambda c: F.explode(F.sequence(block(F.col(c) - far), block(F.col(c) + far)))
    rows = dealt(raster.select("tile", "px", "py", "v").withColumn("bx", blocks("px")).withColumn("by", blocks("py")), 1 << 19, "tile", "bx", "by")
    moves = F.array(*[F.struct((F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.lit(i).alias("i")) for i, (dx, dy) in enumerate(offsets)])
    m = rows.select("tile", "bx", "by", F.explode(moves).alias("m"), "v").where((block(F.col("m.px")) == F.col("bx")) & (block(F.col("m.py")) == F.col("by")))
    g = m.groupBy("tile", "bx", "by", F.col("m.px").alias("px"), F.col("m.py").alias("py"))
    return g.agg(*[F.max(F.when(F.col("m.i") == i, F.col("v"))).alias(f"n{i}") for i in range(len(offsets))]).drop("bx", "by")


def flattened(raster: DataFrame) -> DataFrame:
    """Pixels whose 3 x 3 neighbourhood is there and all equal."""
    square = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    a = around(raster, square)
    same = F.lit(True)
    for k in range(9):
        same = same & (F.col(f"n{k}") == F.col("n4"))
    return a.where(F.col("n4").isNotNull()).select("tile", "px", "py", F.coalesce(same, F.lit(False)).alias("flat"))


def slopes(raster: DataFrame, step_m: float) -> DataFrame:
    """Slope in degrees and the compass facing (0-7 from north, null if under 2 degrees): central differences, one-sided at gaps."""
    a = around(raster, [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]).where("n0 IS NOT NULL")

    def gradient(low: str, high: str) -> Column:
        span = F.when(F.col(low).isNotNull(), 1).otherwise(0) + F.when(F.col(high).isNotNull(), 1).otherwise(0)
        return F.when(span > 0, (F.coalesce(high, "n0") - F.coalesce(low, "n0")) / (span * step_m)).otherwise(0.0)

    a = a.withColumns({"gx": gradient("n1", "n2"), "gy": gradient("n3", "n4")})
    slope = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    facing = F.pmod(F.round(F.degrees(F.atan2(-F.col("gx"), -F.col("gy"))) / 45), F.lit(8)).cast("int")
    return a.select("tile", "px", "py", slope.alias("slope"), F.when(slope >= 2, facing).alias("facing"))


def slope_band(slope: Column) -> Column:
    return F.when(slope < 25, 0).when(slope < 30, 1).when(slope < 35, 2).when(slope < 45, 3).otherwise(4)


def contour_level(v: Column, interval: float) -> tuple[Column, Column]:
    """The nearest contour and whether it is an index one (every fifth)."""
    k = F.round(v / interval)
    return k * interval, F.pmod(k, F.lit(5)) == 0
