"""Street addresses: finding a typed one in ZIP tables.

Tables: streets (street, zip, normal, base), points (street, number, lat, lon), ranges (street, seq, first, last, parity
1 odd, 2 even, 3 any, lat0, lon0, lat1, lon1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measure as M
from ..functions import text as T

OFFSET_M = 10.0


def matched(queries: DataFrame, streets: DataFrame) -> DataFrame:
    """(id, number, street, loose): streets of a query's ZIP named by the longest leading run of its words. A run that is a street's normal form rules over any that only shares its base, even a longer one. queries: id, number, text, zip."""
    words = F.array_remove(F.split(F.trim("text"), r"\s+"), "")
    runs = queries.withColumn("_w", words).where("size(_w) > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w"))))
    runs = runs.withColumn("_run", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ")).select("id", "number", "zip", "k", T.street_normal(F.col("_run")).alias("normal"), T.street_base(F.col("_run")).alias("base"))
    exact = runs.join(streets.select("zip", "normal", "street"), ["zip", "normal"]).select("id", "number", "street", "k", F.lit(0).alias("loose"))
    loose = runs.join(streets.select("zip", "base", "street"), ["zip", "base"]).select("id", "number", "street", "k", F.lit(1).alias("loose"))
    both = exact.unionByName(loose)
    best = both.groupBy("id").agg(F.min(F.struct("loose", (-F.col("k")).alias("k"))).alias("_b")).select("id", F.col("_b.loose").alias("loose"), (-F.col("_b.k")).alias("k"))
    return both.join(best, ["id", "loose", "k"]).select("id", "number", "street", "loose").distinct()


def found(matches: DataFrame, points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, score, street, lat, lon): exact points score 0 (2 on a loose match); without one, places along the blocks that hold the number, 10 m to the side, 1 (3); without any, the nearest block end, 4."""
    at = matches.join(points, ["street", "number"]).select("id", (2 * F.col("loose")).alias("score"), "street", "lat", "lon")
    rest = matches.join(at.select("id", "street").distinct(), ["id", "street"], "left_anti").join(ranges, "street")
    lo, hi = F.least("first", "last"), F.greatest("first", "last")
    holds = F.col("number").between(lo, hi) & ((F.col("parity") == 3) | (F.col("number") % 2 == F.col("parity") % 2))
    t = F.when(F.col("first") == F.col("last"), 0.5).otherwise((F.col("number") - F.col("first")) / (F.col("last") - F.col("first")))
    dy, dx = (F.col("lat1") - F.col("lat0")) * M.M_PER_DEGREE, (F.col("lon1") - F.col("lon0")) * M.M_PER_DEGREE * F.cos(F.radians("lat0"))
    length = F.sqrt(dx * dx + dy * dy)
    side = F.when(F.col("side") == "left", OFFSET_M).otherwise(-OFFSET_M)
    lat = F.col("lat0") + (F.col("lat1") - F.col("lat0")) * t + F.when(length > 0, side * dx / length / M.M_PER_DEGREE).otherwise(0.0)
    lon = F.col("lon0") + (F.col("lon1") - F.col("lon0")) * t - F.when(length > 0, side * dy / length / M.M_PER_DEGREE / F.cos(F.radians("lat0"))).otherwise(0.0)
    along = rest.where(holds).select("id", (1 + 2 * F.col("loose")).alias("score"), "street", lat.alias("lat"), lon.alias("lon"))
    none = rest.join(at.unionByName(along).select("id").distinct(), "id", "left_anti")
    end = F.explode(F.array(F.struct(F.col("first").alias("n"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon")), F.struct(F.col("last").alias("n"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))))
    ends = none.withColumn("e", end).withColumn("_d", F.abs(F.col("e.n") - F.col("number"))).where("_d > 0")
    near = ends.groupBy("id").agg(F.min(F.struct("_d", "street", F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"))).alias("_b")).select("id", F.lit(4).alias("score"), "_b.street", "_b.lat", "_b.lon")
    return at.unionByName(along).unionByName(near).distinct()


def geocode(typed: DataFrame, streets: DataFrame, points: DataFrame, ranges: DataFrame, near_zips: DataFrame, limit: int = 8) -> DataFrame:
    """(id, place, score, street, lat, lon): what typed texts (id, text) mean, best first. A typed ZIP rules; without one the first 16 ZIPs in near_zips (zip, seq) are tried. The limit is what a search shows."""
    from pyspark.sql import Window

    q = typed.withColumn("_a", T.typed_address(F.col("text"))).where("_a IS NOT NULL").select("id", "_a.number", F.col("_a.street").alias("text"), "_a.zip")
    known = q.where("zip IS NOT NULL").withColumn("seq", F.lit(0))
    near = [(r["zip"], r["seq"]) for r in near_zips.select("zip", "seq").orderBy("seq", "zip").limit(16).collect()]
    kinds = "array<struct<zip:" + near_zips.schema["zip"].dataType.simpleString() + ",seq:int>>"
    tried = q.where("zip IS NULL").drop("zip").withColumn("_z", F.explode(F.array(*[F.struct(F.lit(z).alias("zip"), F.lit(n).alias("seq")) for z, n in near]).cast(kinds))).select("id", "number", "text", "_z.zip", "_z.seq")
    all_ = known.unionByName(tried).withColumn("_q", F.struct("id", "seq"))
    hits = found(matched(all_.select(F.col("_q").alias("id"), "number", "text", "zip"), streets), points, ranges)
    w = Window.partitionBy("id.id").orderBy("score", "id.seq", "street", "lat", "lon")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("id.id", "place", "score", "street", "lat", "lon")
