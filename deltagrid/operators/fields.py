"""Values over cells: sea beyond the published squares, heights above the sea, holes, links between layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C


def elevation_or_sea(points: DataFrame, squares: DataFrame) -> DataFrame:
    """points (lat, lon, elev) with 0 where there is no elevation and the one-degree square (lat, lon: its south-west corner) is not published."""
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    sq = squares.select(F.col("lat").alias("_y"), F.col("lon").alias("_x"), F.lit(True).alias("_land")).distinct()
    out = points.withColumns({"_y": F.floor("lat").cast("int"), "_x": F.floor(lon).cast("int")}).join(sq, ["_y", "_x"], "left")
    return out.withColumn("elev", F.coalesce("elev", F.when(F.col("_land").isNull(), F.lit(0.0)))).drop("_y", "_x", "_land")


def sea_level_heights(fixes: DataFrame, geoid: DataFrame, depth: int = 2) -> DataFrame:
    """fixes (lat, lon, height_m) with above_m: the height less the geoid's (prefix, texel, cm) at the place; null without either."""
    placed = C.encode(fixes, "lat", "lon").withColumns({"prefix": C.prefix(depth), "texel": C.texel(depth)}).drop("diamond", "u", "v")
    return placed.join(geoid.select("prefix", "texel", "cm"), ["prefix", "texel"], "left").withColumn("above_m", F.col("height_m") - F.col("cm") / 100).drop("cm")


def geoid_pyramid(t: DataFrame) -> DataFrame:
    """Metres one depth coarser: the mean of the children there are. t: depth, prefix, texel, metres."""
    cell, up = C.texel_parent(F.col("prefix"), F.col("texel"))
    return t.groupBy((F.col("depth") - 1).alias("depth"), cell.alias("prefix"), up.alias("texel")).agg(F.avg("metres").alias("metres"))


def centimetres(metres: Column) -> Column:
    return F.least(F.greatest(F.round(metres * 100), F.lit(-32767.0)), F.lit(32767.0)).cast("int")


def filled(t: DataFrame, key: list[str], levels: int = C.TEX_BITS) -> DataFrame:
    """t (key, path, value) with holes (null) filled by the mean, cut to a whole number, of the nearest ancestor in the triangle hierarchy that has any value; 0 where none has. path: a texel's place in disk order."""
    up = lambda k: F.call_function("shiftright", F.col("path"), (2 * k).cast("int"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(levels)))
    means = t.where("value IS NOT NULL").withColumn("k", steps).withColumn("node", up(F.col("k"))).groupBy(*key, "k", "node").agg(F.expr("sum(value) div count(*)").alias("mean"))
    holes = t.where("value IS NULL").withColumn("k", steps).withColumn("node", up(F.col("k"))).join(means, [*key, "k", "node"])
    found = holes.groupBy(*key, "path").agg(F.min_by("mean", "k").alias("mean"))
    return t.join(found, [*key, "path"], "left").select(*key, "path", F.coalesce("value", "mean", F.lit(0)).alias("value"))


def linked(base: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Layer documents that belong to their base: the base names their hash (want), or names none. base: keys, want (may be null); layers: keys, hash."""
    return layers.join(base.select(*keys, "want"), keys).where(F.col("want").isNull() | (F.col("want") == F.col("hash"))).drop("want")


def not_in_water(lines: DataFrame, water: DataFrame, cls: int = 12) -> DataFrame:
    """Texels of lines (prefix, texel, class) without a river's that lie in water (prefix, texel): those are not named."""
    return lines.where(F.col("class") != cls).unionByName(lines.where(F.col("class") == cls).join(water.select("prefix", "texel").distinct(), ["prefix", "texel"], "left_anti"))


def nearest_first(cells: DataFrame, depth: int, centre: int, most: int) -> DataFrame:
    """The cells of a depth (prefix) nearest to one of the same diamond, by columns and rows; of equals the lowest."""
    gu, gv = C.grid(depth, F.col("prefix"))
    cu, cv = C.grid(depth, F.lit(centre).cast("bigint"))
    far = F.greatest(F.abs(gu - cu), F.abs(gv - cv))
    same = C.cell_diamond(depth, F.col("prefix")) == C.cell_diamond(depth, F.lit(centre).cast("bigint"))
    return cells.where(same).withColumn("far", far).orderBy("far", "prefix").limit(most)


def label_order(labels: DataFrame) -> DataFrame:
    """labels (cell, id, tier, shown, rank, texels) with place: tier first, then those shown already, rank, texels; of equals the lowest id."""
    w = Window.partitionBy("cell").orderBy("tier", F.desc("shown"), F.desc("rank"), F.desc("texels"), "id")
    return labels.where("tier IS NOT NULL").withColumn("place", F.row_number().over(w))


def under_piece(cells: DataFrame, piece_depth: int, piece: int, shape: DataFrame) -> DataFrame:
    """Cells (depth, prefix) that are a piece or lie in it and belong to a shape (depth, prefix)."""
    inside = C.contains(F.lit(piece_depth), F.lit(piece).cast("bigint"), F.col("depth"), F.col("prefix"))
    return cells.where(inside).join(shape.select("depth", "prefix").distinct(), ["depth", "prefix"], "left_semi")


def pinned(areas: DataFrame) -> DataFrame:
    """The cells that any area (area, depth, prefix) holds, each once."""
    return areas.select("depth", "prefix").distinct()
