"""Names: search, merging across cells, nearest places, address boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measure as M
from ..functions.cells import texel_m
from ..functions.text import fit
from .graph import cut


def interned(names: DataFrame) -> DataFrame:
    """One row a (kind, name, reference), trimmed, with the highest rank; nothing for two empty texts."""
    t = names.withColumns({"name": F.trim("name"), "reference": F.trim("reference")}).where("name <> '' OR reference <> ''")
    return t.groupBy("kind", "name", "reference").agg(F.max("rank").alias("rank"))


def search(places: DataFrame, query: str, tier: Column, limit: int = 60) -> DataFrame:
    """Best fit first, then tier, rank, name and reference; one row a (kind, name, reference), at the deepest place that has it. The limit is what a search shows."""
    q = F.lit(query)
    best = F.least(fit(q, F.col("name")), fit(q, F.col("reference")))
    hits = places.withColumn("fit", best).where(F.col("fit").isNotNull())
    deepest = F.struct(F.col("depth"), (-F.col("prefix")).alias("p"))
    g = hits.groupBy("kind", "name", "reference").agg(F.min("fit").alias("fit"), F.max("rank").alias("rank"), F.max_by(F.struct("lat", "lon"), deepest).alias("_at"))
    return g.withColumn("tier", tier).orderBy("fit", "tier", F.desc("rank"), "kind", "name", "reference").limit(limit).select("kind", "name", "reference", "fit", "tier", "rank", "_at.lat", "_at.lon")


def on_screen(lat: Column, lon: Column, view: tuple[float, float, float, int, int]) -> tuple[Column, Column]:
    """Pixels from the upper left corner of a flat view: (latitude and longitude of its centre, pixels a degree, width, height)."""
    clat, clon, ppd, w, h = view
    return (lon - clon) * math.cos(math.radians(clat)) * ppd + w / 2, (clat - lat) * ppd + h / 2


def in_view(texels: DataFrame, query: str, view: tuple[float, float, float, int, int], tier: Column, limit: int = 60) -> DataFrame:
    """(kind, name, reference, fit, tier, rank, size_m, lat, lon): what a search shows of the names in view, best fit first, then tier, rank and size. texels: depth, prefix, kind, name, reference, rank, lat, lon.

    A name stands at its texel nearest the view's centre, of the deepest cells that have it in view; its size is that of its texels in the first of those cells. Kinds without a tier are left out, as is what lies outside the view. The limit is what a search shows.
    """
    _, _, _, w, h = view
    x, y = on_screen(F.col("lat"), F.col("lon"), view)
    q = F.lit(query.strip())
    best = F.least(fit(q, F.col("name")), fit(q, F.col("reference")))
    # names are many times fewer than texels, but stand beside each of them here: the texts are compared before anything is shuffled
    hits = texels.withColumns({"tier": tier, "fit": best, "_x": x, "_y": y}).where("fit IS NOT NULL AND tier IS NOT NULL").where(F.col("_x").between(0, w) & F.col("_y").between(0, h))
    far = F.pow(F.col("_x") - w / 2, F.lit(2)) + F.pow(F.col("_y") - h / 2, F.lit(2))
    name = ["kind", "name", "reference"]
    cells = hits.withColumn("_at", F.struct(far.alias("d"), "lat", "lon")).groupBy("depth", "prefix", *name).agg(F.min("fit").alias("fit"), F.min("tier").alias("tier"), F.max("rank").alias("rank"), F.count("*").alias("n"), F.min("_at").alias("_at"))
    down = -F.col("depth")
    found = cells.groupBy(*name).agg(F.min("fit").alias("fit"), F.min("tier").alias("tier"), F.max("rank").alias("rank"), F.min(F.struct(down.alias("k"), "_at")).alias("_p"), F.min(F.struct(down.alias("k"), "prefix", (F.col("n") * texel_m(F.col("depth"))).alias("size"))).alias("_s"))
    return found.withColumn("size_m", F.col("_s.size")).orderBy("fit", "tier", F.desc("rank"), F.desc("size_m"), *name).limit(limit).select(*name, "fit", "tier", "rank", "size_m", F.col("_p._at.lat").alias("lat"), F.col("_p._at.lon").alias("lon"))


def nearest(points: DataFrame, places: DataFrame, reach_m: float = 2000.0, per_degree: int = 50, alike: str | None = None, bring: tuple[str, ...] = ()) -> DataFrame:
    """(id, place, metres, *bring): each point's nearest place within reach, those with the point's value of the column `alike` first; the lowest place of equals. bring: columns of the place found.

    Points at one spot have one answer and of places at one spot only the lowest can be found, so both are joined once a spot (and value of `alike`). Spots of places are dealt to squares of 1 / per_degree degrees and those of points look into nine, so the join is on squares; nothing is broadcast, as an estimate of points does not count the nine.
    """
    square = lambda c: F.floor(F.col(c) * per_degree).cast("int")
    spot = ["lat", "lon", *([alike] if alike else [])]
    at = places.groupBy(*spot).agg(F.min(F.struct(F.col("id").alias("p"), *bring)).alias("_p"))
    at = at.select("_p", *(F.col(c).alias(f"p_{c}") for c in spot)).withColumns({"_a": square("p_lat"), "_o": square("p_lon")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = points.select(*spot).distinct().withColumn("_n", F.explode(steps)).withColumns({"_a": square("lat") + F.col("_n.i"), "_o": square("lon") + F.col("_n.j")}).drop("_n")
    j = near.hint("merge").join(at, ["_a", "_o"]).withColumn("metres", M.flat_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("metres") < reach_m)
    other = F.lit(0) if alike is None else F.when(F.col(alike) == F.col(f"p_{alike}"), 0).otherwise(1)
    best = j.groupBy(*spot).agg(F.min(F.struct(other.alias("s"), F.round("metres", 6).alias("m"), F.col("_p"))).alias("_b"))
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in spot]
    found = points.select("id", *spot).alias("x").join(best.alias("b"), keys).groupBy("x.id").agg(F.min("b._b").alias("_b"))
    return found.select("id", F.col("_b._p.p").alias("place"), F.col("_b.m").alias("metres"), *(F.col(f"_b._p.{c}").alias(c) for c in bring))


def boxes(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"), F.max("lat").alias("lat1"), F.max("lon").alias("lon1"))


def box_distance_m(lat: Column, lon: Column) -> Column:
    """From a place to a box (lat0 ... lon1), 0 inside."""
    y, x = F.least(F.greatest(lat, F.col("lat0")), F.col("lat1")), F.least(F.greatest(lon, F.col("lon0")), F.col("lon1"))
    return M.flat_m(lat, lon, y, x)


def boxes_near(boxes: DataFrame, key: str, lat: float, lon: float, reach_m: float = 40_000.0, limit: int = 16) -> DataFrame:
    """The boxes within reach of one place, nearest first. The limit is the feature's."""
    d = boxes.withColumn("metres", F.round(box_distance_m(F.lit(lat), F.lit(lon)), 6))
    return d.where(F.col("metres") <= reach_m).orderBy("metres", key).limit(limit).select(key, "metres")


_BOX = ("lat0", "lon0", "lat1", "lon1")


def _level(per_degree: float) -> Column:
    """How often squares must be doubled until a box meets two by two of them at most."""
    span = F.greatest(F.col("lat1") - F.col("lat0"), F.col("lon1") - F.col("lon0")) * per_degree
    return F.when(span > 1, F.ceil(F.log2(span))).otherwise(0).cast("int")


def meeting_squares(boxes: DataFrame, others: DataFrame, per_degree: float, pad: float = 0.0) -> DataFrame:
    """Candidates for pairs of boxes (a.*, b.* as structs) that overlap, by squares that fit them, each pair once. pad: degrees that the boxes are widened by.

    A box is dealt to the squares of its own size, four at most, and again to those of each larger size that boxes of the other side have; so a box of the whole world makes four rows, not one a square. Two boxes meet in squares of the larger one's size, in the one that holds their overlap's lower corner.
    """
    wide = boxes.select(F.struct(*(F.col(f"`{c}`") for c in boxes.columns)).alias("a"), *((F.col(c) + (-pad if c.endswith("0") else pad)).alias(c) for c in _BOX)).withColumn("own", _level(per_degree))
    plain = others.select(F.struct(*(F.col(f"`{c}`") for c in others.columns)).alias("b"), *_BOX).withColumn("own", _level(per_degree))
    # a few small numbers a side: the sizes that there are
    sizes = [sorted(r[0] for r in d.where("own IS NOT NULL").select("own").distinct().collect()) for d in (wide, plain)]

    def dealt(df: DataFrame, name: str, theirs: list[int], alone: int, above: int) -> DataFrame:
        """Rows by (size, role): role 0 both boxes have this size, `alone` only this side's box has it, `above` only the other side's."""
        there = F.array(*map(F.lit, theirs)).cast("array<int>")
        role = lambda level, r: F.struct(level.alias("size"), F.lit(r).alias("role"))
        own = F.when(F.array_contains(there, F.col("own")), F.array(role(F.col("own"), 0))).otherwise(F.array().cast("array<struct<size:int,role:int>>"))
        lone = F.when(F.exists(there, lambda x: x < F.col("own")), F.array(role(F.col("own"), alone))).otherwise(F.array().cast("array<struct<size:int,role:int>>"))
        up = F.transform(F.filter(there, lambda x: x > F.col("own")), lambda x: role(x, above))
        d = df.withColumn("k", F.explode(F.concat(own, lone, up)))
        side = F.pow(F.lit(2.0), F.col("k.size")) / per_degree
        s = lambda c: F.floor(F.col(c) / side)
        d = d.withColumn("y", F.explode(F.sequence(s("lat0"), s("lat1")))).withColumn("x", F.explode(F.sequence(s("lon0"), s("lon1"))))
        return d.select(name, "k", "y", "x", *(F.col(c).alias(f"_{name}_{c}") for c in _BOX))

    j = dealt(wide, "a", sizes[1], 1, 2).join(dealt(plain, "b", sizes[0], 2, 1), ["k", "y", "x"])
    low, high = lambda c: F.greatest(f"_a_{c}", f"_b_{c}"), lambda c: F.least(f"_a_{c}", f"_b_{c}")
    side = F.pow(F.lit(2.0), F.col("k.size")) / per_degree
    meet = (low("lat0") <= high("lat1")) & (low("lon0") <= high("lon1"))
    return j.where(meet & (F.floor(low("lat0") / side) == F.col("y")) & (F.floor(low("lon0") / side) == F.col("x"))).select("a", "b")


def overlapping(boxes: DataFrame, others: DataFrame, per_degree: int = 4) -> DataFrame:
    """(a, b): ids of boxes that overlap, edges included, each pair once."""
    return meeting_squares(boxes.select("id", *_BOX), others.select("id", *_BOX), per_degree).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def newest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def within_budget(df: DataFrame, part: str, order: list[str], size: str, budget: int, pinned: str | None = None) -> DataFrame:
    """What to drop, oldest first, until a part's rest fits: rows before which more than the budget was still held. Rows that are `pinned` (a boolean) count but are never dropped.

    Rows are dealt to ranges of (part, order) and written; sums of ranges, one row a part and range, say what each range begins with, so no task sees more than a range, however few parts there are.
    """
    ranged, before = "_range", "_before"
    loose = F.col(size) if pinned is None else F.when(F.coalesce(F.col(pinned), F.lit(False)), 0).otherwise(F.col(size))
    laid = cut(df.repartitionByRange(part, *order).withColumn(ranged, F.spark_partition_id()))
    sums = laid.groupBy(part, ranged).agg(F.sum(size).alias("_all"), F.sum(loose).alias("_loose"))
    w = Window.partitionBy(part)
    sums = sums.select(F.col(part).alias("_part"), F.col(ranged).alias("_r"), F.sum("_all").over(w).alias("_total"), F.coalesce(F.sum("_loose").over(w.orderBy(ranged).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = Window.partitionBy(part, ranged).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.withColumn("_gone", F.coalesce(F.sum(loose).over(inside), F.lit(0)))
    rows = rows.join(sums, F.col(part).eqNullSafe(F.col("_part")) & (F.col(ranged) == F.col("_r")))
    over = rows.where(F.col("_total") - F.col(before) - F.col("_gone") > budget)
    return (over if pinned is None else over.where(~F.coalesce(F.col(pinned), F.lit(False)))).select(*df.columns)
