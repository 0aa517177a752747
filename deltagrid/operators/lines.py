"""Lines: assembling, measuring, resampling, junctions, nearest places, upstream networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measure as M


def placed(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, pos, node, lat, lon): references with their nodes' places; missing nodes drop out, order and repeats stay."""
    return refs.join(nodes.select("node", "lat", "lon"), "node").select("way", "pos", "node", "lat", "lon")


def segments(points: DataFrame) -> DataFrame:
    """Consecutive pairs along each way, with flat metres."""
    w = Window.partitionBy("way").orderBy("pos")
    s = points.withColumns({"lat1": F.lead("lat").over(w), "lon1": F.lead("lon").over(w), "to": F.lead("node").over(w)}).where("lat1 IS NOT NULL")
    return s.withColumn("metres", M.flat_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")))


def along(points: DataFrame) -> DataFrame:
    """points with metres from the way's start."""
    w = Window.partitionBy("way").orderBy("pos")
    step = M.flat_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("at_m", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def resample(points: DataFrame, stations: int) -> DataFrame:
    """(way, station, pos): at each of so many even stations the last point that is not beyond it."""
    a = along(points)
    w = Window.partitionBy("way")
    a = a.withColumns({"total": F.max("at_m").over(w), "next": F.lead("at_m").over(w.orderBy("pos"))})
    first = F.ceil(F.when(F.col("total") > 0, F.col("at_m") / F.col("total") * (stations - 1)).otherwise(0.0) - 1e-9)
    last = F.when(F.col("next").isNull(), F.lit(stations - 1)).otherwise(F.ceil(F.col("next") / F.col("total") * (stations - 1) - 1e-9) - 1)
    return a.where("total > 0").withColumn("_r", F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))).select("way", F.explode("_r").alias("station"), "pos")


def moving_mean(df: DataFrame, part: str, order: str, value: str, half: int) -> DataFrame:
    """The mean of a row and half rows each way; nulls do not count, ends are short."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(-half, half)))


def runs(df: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Runs of equal values in order: (part, value, first, last, n)."""
    w = Window.partitionBy(part).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(order).over(w).isNull()
    run = df.withColumn("_run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(part, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def junctions(refs: DataFrame) -> DataFrame:
    """Nodes on two ways or more."""
    return refs.select("node", "way").distinct().groupBy("node").agg(F.count("*").alias("ways")).where("ways >= 2")


def ring_area_m2(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with area: of array<struct<lat, lon>> by the shoelace rule at the first latitude."""
    r = F.col(ring)
    k = M.M_PER_DEGREE * M.M_PER_DEGREE
    following = F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, F.lit(1), F.lit(1)))
    terms = F.zip_with(r, following, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("area", F.abs(total) / 2 * k * F.cos(F.radians(F.get(r, F.lit(0))["lat"])))


def project(points: DataFrame, segs: DataFrame, key: str) -> DataFrame:
    """Each point (id, lat, lon, key) on its key's polyline: metres along and metres off, the first best segment. segs: key, seq, lat, lon, lat1, lon1, start_m."""
    s = segs.select(F.col(key), "seq", "start_m", *(F.col(c).alias(f"s_{c}") for c in ("lat", "lon", "lat1", "lon1")))
    j = points.join(s, key)
    kx = F.cos(F.radians(F.col("s_lat"))) * M.M_PER_DEGREE
    j = j.withColumns({"_dx": (F.col("s_lon1") - F.col("s_lon")) * kx, "_dy": (F.col("s_lat1") - F.col("s_lat")) * M.M_PER_DEGREE, "_px": (F.col("lon") - F.col("s_lon")) * kx, "_py": (F.col("lat") - F.col("s_lat")) * M.M_PER_DEGREE})
    j = j.withColumn("_len2", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    j = j.withColumn("_t", F.when(F.col("_len2") > 0, F.least(F.greatest((F.col("_px") * F.col("_dx") + F.col("_py") * F.col("_dy")) / F.col("_len2"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    off = F.sqrt(F.pow(F.col("_px") - F.col("_t") * F.col("_dx"), 2) + F.pow(F.col("_py") - F.col("_t") * F.col("_dy"), 2))
    best = F.min(F.struct(F.round(off, 6).alias("off_m"), F.col("seq").alias("seq"), (F.col("start_m") + F.col("_t") * F.sqrt("_len2")).alias("along_m")))
    return j.groupBy("id").agg(best.alias("_b")).select("id", "_b.off_m", "_b.along_m", "_b.seq")


def upstream(edges: DataFrame, own: DataFrame, cut, most: int = 64) -> DataFrame:
    """(way, km): a way's own length and all that flows into it, directly or not. edges: (src, dst) tributary to host, acyclic. Each round moves what has arrived one step down; `cut` writes a round's table so that lineage stays short. A network deeper than `most` is an error, not a cut-off."""
    total = wave = own.select(F.col("way"), F.col("km"))
    for _ in range(most):
        wave = cut(wave.join(edges, wave["way"] == edges["src"]).groupBy(F.col("dst").alias("way")).agg(F.sum("km").alias("km")))
        if wave.isEmpty():
            return total.groupBy("way").agg(F.sum("km").alias("km"))
        total = total.unionByName(wave)
    raise ValueError(f"the network is deeper than {most}, or has a cycle")
