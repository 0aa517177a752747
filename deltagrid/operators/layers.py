"""Cells and their neighbours, ancestors and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C


def ancestors(cells: DataFrame, levels: int) -> DataFrame:
    """cells with up (0 is the cell itself) and aprefix, one row an ancestor."""
    return cells.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("aprefix", C.ancestor(F.col("prefix"), F.col("up")))


def nearest_resident(cells: DataFrame, resident: DataFrame, levels: int) -> DataFrame:
    """Each cell (prefix) with the value of its nearest ancestor that has one, itself included, and how far up it is. resident: (up, prefix, value)."""
    j = ancestors(cells, levels).join(resident.select("up", F.col("prefix").alias("aprefix"), "value"), ["up", "aprefix"])
    return j.groupBy("prefix").agg(F.min(F.struct("up", "value")).alias("_n")).select("prefix", "_n.up", "_n.value")


def without_absent_ancestors(cells: DataFrame, absent: DataFrame, levels: int) -> DataFrame:
    """Cells of which no ancestor is absent. absent: (up, prefix)."""
    bad = ancestors(cells, levels).join(absent.select("up", F.col("prefix").alias("aprefix")), ["up", "aprefix"], "left_semi").select("prefix").distinct()
    return cells.join(bad, "prefix", "left_anti")


def apron(cells: DataFrame, depth: int, value: str) -> DataFrame:
    """cells with the value of the cell on each side, null beyond the diamond: each row is dealt to the cells that it neighbours, then one group-by."""
    cu, cv = C.grid(depth, F.col("prefix"))
    g = cells.withColumns({"_d": C.cell_diamond(depth, F.col("prefix")), "_u": cu, "_v": cv})
    steps = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
    dealt = g.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("_u") - a).alias("u"), (F.col("_v") - b).alias("v")) for i, (a, b) in enumerate(steps)])))
    out = dealt.groupBy("_d", F.col("_s.u").alias("_u"), F.col("_s.v").alias("_v")).agg(F.max(F.when(F.col("_s.i") == 0, F.col("prefix"))).alias("prefix"), *[F.max(F.when(F.col("_s.i") == i, F.col(value))).alias(n) for i, n in enumerate((value, "west", "east", "south", "north"))])
    return out.where("prefix IS NOT NULL").select("prefix", value, "west", "east", "south", "north")


def together(layers: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row a key with each layer's value column named for the layer: a union and one group-by instead of a chain of full joins."""
    rows = None
    for name, df in layers.items():
        part = df.select(*key, *(F.col("value").alias(n) if n == name else F.lit(None).cast(df.schema["value"].dataType).alias(n) for n in layers))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*key).agg(*[F.max(n).alias(n) for n in layers])


def sampled_classes(samples: DataFrame, per_texel: int = 16, classes: DataFrame | None = None) -> DataFrame:
    """(prefix, texel, class, cov): the most frequent class of a texel's samples, the highest of equals; coverage n * 255 div per_texel. classes (value, class): what a sample's own value, in its column `value`, counts as; values without a class do not count."""
    if classes is not None:
        samples = samples.drop("class").join(classes.select("value", "class"), "value")
    n = samples.groupBy("prefix", "texel", "class").agg(F.count("*").alias("n"))
    return n.groupBy("prefix", "texel").agg(F.max(F.struct("n", "class")).alias("_b")).select("prefix", "texel", "_b.class", F.floor(F.col("_b.n") * 255 / per_texel).alias("cov"))


def water_share(samples: DataFrame, water: Column, per_texel: int = 16) -> DataFrame:
    """(prefix, texel, cov): how much of each texel's samples is water, 0 to 255, whatever class rules the texel."""
    n = samples.groupBy("prefix", "texel").agg(F.count_if(water).alias("n"))
    return n.where("n > 0").select("prefix", "texel", F.floor(F.col("n") * 255 / per_texel).alias("cov"))


def resampled(profile: DataFrame, key: str, n: int) -> DataFrame:
    """(key, station, v): a profile of any length at n even stations: between two rows the straight line, beside a missing height the row on the left. profile: key, pos (in order), v. A profile's rows stay where they are: each knows the stations up to the next one."""
    o = Window.partitionBy(key).orderBy("pos")
    p = profile.withColumns({"_k": F.row_number().over(o) - 1, "_n": F.count("*").over(Window.partitionBy(key)), "_next": F.lead("v").over(o)})
    # station s stands at s * (rows - 1) / (n - 1) rows from the first
    at = lambda k: F.ceil(k * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).cast("int")
    first, end = at(F.col("_k")), F.when(F.col("_k") == F.col("_n") - 1, n).otherwise(at(F.col("_k") + 1))
    first = F.when((F.col("_n") == 1), 0).otherwise(first)
    p = p.withColumn("station", F.explode(F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))))
    share = F.col("station") * (F.col("_n") - 1) / (n - 1) - F.col("_k")
    v = F.when(F.col("_next").isNull() | F.col("v").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("_next") - F.col("v")) * share)
    return p.select(key, "station", v.alias("v"))


def in_cells(points: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """points (diamond, u, v) with the columns of the cell (prefix of this depth) that holds each; points in no cell drop out. An equality join on the cell."""
    return points.withColumn("prefix", C.prefix(depth)).join(cells, "prefix")


def lidar_grid(points: DataFrame) -> DataFrame:
    """By 1 m cell (cx, cy): intensity mean of first returns (whole division), their number and top, the ground (class 2), and canopy: top less the lowest ground of the 3 x 3 cells, 0 to 255."""
    first = F.col("return_number") == 1
    g = points.groupBy("cx", "cy").agg(F.sum(F.when(first, F.col("intensity"))).alias("_i"), F.sum(first.cast("bigint")).alias("n"), F.max(F.when(first, F.col("z"))).alias("top"), F.min(F.when(F.col("class") == 2, F.col("z"))).alias("ground"))
    near = g.where("ground IS NOT NULL").select(F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c"), "ground").groupBy("c").agg(F.min("ground").alias("low")).select("c.cx", "c.cy", "low")
    canopy = F.least(F.greatest(F.floor(F.col("top") - F.col("low")), F.lit(0)), F.lit(255))
    return g.join(near, ["cx", "cy"], "left").where("n > 0").select("cx", "cy", F.floor(F.col("_i") / F.col("n")).alias("intensity"), "n", "top", canopy.alias("canopy"))


def at_ranks(df: DataFrame, value: str, ranks: list[Column], buckets: int = 4096, most: int = 1 << 20) -> DataFrame:
    """One row (v0, v1, ...): the values at ranks (from 0, of the number of rows n) in order of value; null where there are no rows.

    Values are counted in equal intervals; the interval in which a rank falls is cut again between the least and largest value in it until it holds `most` rows or one value, so a value far off the others costs another count and no large sort. The driver holds a few numbers a rank.
    """
    held = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    span = held.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    lo, hi, n, *wanted = span.select("lo", "hi", "n", *(r.cast("bigint").alias(f"r{i}") for i, r in enumerate(ranks))).first()
    found: dict[int, float | None] = {}
    spots = {i: (lo, hi, n, r) for i, r in enumerate(wanted)}  # of each rank: its interval, the rows there, its place among them
    while spots:
        for i, (a, b, count, _) in list(spots.items()):
            if not count or a == b:
                found[i] = a if count else None
                del spots[i]
        cutting = {i: s for i, s in spots.items() if s[2] > most}
        if not cutting:
            break
        parts = sorted({(a, b) for a, b, *_ in cutting.values()})
        # halves of the span, as the whole may be too wide for a number
        at = [F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * buckets), F.lit(buckets - 1)).cast("int").alias("bucket"))) for k, (a, b) in enumerate(parts)]
        rows = held.withColumn("at", F.explode(F.array_compact(F.array(*at)))).groupBy("at").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c")).select("at.k", "at.bucket", "lo", "hi", "c").collect()  # `buckets` rows an interval at most
        for i, (a, b, _, rank) in cutting.items():
            for r in sorted((r for r in rows if r["k"] == parts.index((a, b))), key=lambda r: r["bucket"]):
                if rank < r["c"]:
                    spots[i] = (r["lo"], r["hi"], r["c"], rank)
                    break
                rank -= r["c"]
    if spots:
        # at most `most` rows of an interval are sorted
        parts = sorted({s[:2] for s in spots.values()})
        at = F.array_compact(F.array(*[F.when(F.col("v").between(a, b), F.lit(k)) for k, (a, b) in enumerate(parts)]))
        placed = held.withColumn("k", F.explode(at)).withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1)
        asked = {(parts.index(s[:2]), s[3]) for s in spots.values()}
        rows = {(r["k"], r["at"]): r["v"] for r in placed.where(F.struct("k", "at").isin([F.struct(F.lit(k).alias("k"), F.lit(r).cast("int").alias("at")) for k, r in asked])).collect()}
        found |= {i: rows[parts.index(s[:2]), s[3]] for i, s in spots.items()}
    return df.sparkSession.range(1).select(*[F.lit(found[i]).cast("double").alias(f"v{i}") for i in range(len(ranks))])


def stretched(df: DataFrame, value: str) -> DataFrame:
    """df with a byte 1-255 between the values at n div 100 and 99 n div 100, counted from 0 in order."""
    n = F.col("n")
    q = at_ranks(df, value, [F.floor(n / 100), F.floor(n * 99 / 100)])
    share = (F.col(value) - F.col("v0")) / F.greatest(F.col("v1") - F.col("v0"), F.lit(1))
    return df.join(F.broadcast(q)).withColumn("byte", 1 + F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 254)).drop("v0", "v1")


def centre(df: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon): the mean direction of places."""
    d = C.directions(df, "lat", "lon").groupBy(key).agg(*[F.avg(a).alias(a) for a in ("_x", "_y", "_z")])
    n = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    return d.select(key, F.degrees(F.asin(F.col("_z") / n)).alias("lat"), F.degrees(F.atan2("_y", "_x")).alias("lon"))


def rank_steps(df: DataFrame, part: str, rank: str, steps: int = 5) -> DataFrame:
    """df with step: where a rank's logarithm stands between its group's least and largest."""
    w = Window.partitionBy(part)
    x = F.log10(F.greatest(F.col(rank), F.lit(1)))
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn("step", F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * steps), F.lit(steps - 1))).otherwise(0))


def interpolated(df: DataFrame, part: str, order: str, value: str, share: Column) -> DataFrame:
    """df with the value a share of the way to the next row; a side without a value gives the left one."""
    following = F.lead(value).over(Window.partitionBy(part).orderBy(order))
    return df.withColumn("between", F.when(F.col(value).isNotNull() & following.isNotNull(), F.col(value) + (following - F.col(value)) * share).otherwise(F.col(value)))


def selection_edge(t: DataFrame, side: int = 128) -> DataFrame:
    """(prefix, texel) of all texels on one side of `side` with a neighbour across an edge on the other. A texel without a row has cov 0."""
    inside = t.where(F.col("cov") >= side).select("prefix", "texel")
    pairs = inside.withColumn("other", F.explode(C.texel_neighbours(F.col("texel"))))
    across = pairs.join(inside.withColumnRenamed("texel", "other"), ["prefix", "other"], "left_anti")
    return across.select("prefix", F.explode(F.array("texel", "other")).alias("texel")).distinct()


def class_edge(t: DataFrame) -> DataFrame:
    """(prefix, texel) of texels with a class (not 0) beside one of another class across an edge, within the cell. A texel without a row has class 0."""
    own = t.where("class <> 0").select("prefix", "texel", "class")
    pairs = own.withColumn("other", F.explode(C.texel_neighbours(F.col("texel"))))
    across = pairs.join(own.select("prefix", F.col("texel").alias("other"), F.col("class").alias("_c")), ["prefix", "other"], "left")
    return across.where(F.coalesce(F.col("_c"), F.lit(0)) != F.col("class")).select("prefix", "texel").distinct()


def outliers(df: DataFrame, cell: list[str], value: str, floor: float, most: int = 10) -> DataFrame:
    """The cells with most values below a floor: how many (n) and the lowest; of equals the first cells."""
    low = df.where((F.col(value) < floor) & ~F.isnan(value)).groupBy(*cell).agg(F.count("*").alias("n"), F.min(value).alias("lowest"))
    return low.orderBy(F.desc("n"), *cell).limit(most)
