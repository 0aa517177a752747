"""One step up the resolution pyramid, over long tables (depth, prefix, texel, ...). A parent is one group-by: its key is computed from the child's, so no join is needed and map-side aggregation does most of the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import tone as L


def with_parent(df: DataFrame) -> DataFrame:
    """df with pprefix and ptexel, and child: the texel's place (0-3) among its parent's children."""
    cell, up = C.texel_parent(F.col("prefix"), F.col("texel"))
    tx, ty, half = C.texel_parts(F.col("texel"))
    middle = half != up.bitwiseAND(1)
    odd_x, odd_y, flip = tx % 2, ty % 2, up.bitwiseAND(1)
    child = F.when(middle, 3).when(odd_x == odd_y, 0).when(odd_y == 1, 1).otherwise(2)
    return df.withColumns({"pprefix": cell, "ptexel": up, "child": child + 0 * flip.cast("int")})


def lines(df: DataFrame) -> DataFrame:
    """Coverage adds up to 255 at most, the lowest class that shows wins, magnitude is the largest, uses are or-ed."""
    g = with_parent(df).groupBy((F.col("depth") - 1).alias("depth"), F.col("pprefix").alias("prefix"), F.col("ptexel").alias("texel"))
    shown = F.when((F.col("class") != 0) & (F.col("cov") > 0), F.col("class"))
    return g.agg(F.coalesce(F.min(shown), F.lit(0)).alias("class"), F.least(F.sum("cov"), F.lit(255)).alias("cov"), F.max("mag").alias("mag"), F.bit_or("uses").alias("uses"))


def areas(df: DataFrame) -> DataFrame:
    """A quarter of the summed coverage; the class with most of it, of equals the one that got there at the lower child."""
    p = with_parent(df)
    key = [(F.col("depth") - 1).alias("depth"), F.col("pprefix").alias("prefix"), F.col("ptexel").alias("texel")]
    by_class = p.groupBy(*key, "class").agg(F.sum("cov").alias("cov"), F.max(F.when((F.col("class") != 0) & (F.col("cov") > 0), F.col("child"))).alias("last"))
    votes = F.when(F.col("last").isNotNull(), F.struct(F.col("cov").alias("c"), (-F.col("last")).alias("l"), (-F.col("class")).alias("k")))
    g = by_class.groupBy("depth", "prefix", "texel").agg(F.sum("cov").alias("total"), F.max(votes).alias("best"))
    return g.select("depth", "prefix", "texel", F.coalesce(-F.col("best.k"), F.lit(0)).alias("class"), F.floor(F.col("total") / 4).alias("cov"))


def coverage(df: DataFrame) -> DataFrame:
    return with_parent(df).groupBy((F.col("depth") - 1).alias("depth"), F.col("pprefix").alias("prefix"), F.col("ptexel").alias("texel")).agg(F.floor(F.sum("cov") / 4).alias("cov"))


def means(df: DataFrame, value: str) -> DataFrame:
    """The mean of the children that have a value."""
    return with_parent(df).groupBy((F.col("depth") - 1).alias("depth"), F.col("pprefix").alias("prefix"), F.col("ptexel").alias("texel")).agg(F.avg(value).alias(value))


def names(df: DataFrame, point_kind: int = 64) -> DataFrame:
    """One name a parent texel: the highest-ranked point, else the line name with most coverage (of equals the first child's)."""
    order: Column = F.struct((F.col("kind") >= point_kind).cast("int").alias("p"), F.when(F.col("kind") >= point_kind, F.col("rank")).otherwise(F.col("cov")).alias("r"), (-F.col("child")).alias("c"), (-F.col("seq")).alias("s"))
    return with_parent(df).groupBy((F.col("depth") - 1).alias("depth"), F.col("pprefix").alias("prefix"), F.col("ptexel").alias("texel")).agg(F.max_by("name", order).alias("name"), F.max_by("kind", order).alias("kind"))


def pyramid(df: DataFrame, step, to_depth: int, from_depth: int) -> DataFrame:
    """All levels from from_depth to to_depth by repeated steps; each level is the previous one's group-by, so only the base is scanned."""
    out = level = df
    for _ in range(from_depth - to_depth):
        level = step(level)
        out = out.unionByName(level.select(*out.columns)) if set(out.columns) <= set(level.columns) else level
    return out


def running_total(df: DataFrame, part: list[str], order: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def images(t: DataFrame, bands: list[str]) -> DataFrame:
    """Imagery one depth coarser, in the tone of imagery: each band the mean of its lit children (not 0) as scene light. t: depth, prefix, texel, tone, bands."""
    cell, up = C.texel_parent(F.col("prefix"), F.col("texel"))
    mean = lambda b: F.avg(F.when(F.col(b) > 0, L.unroll(F.col("tone"), F.col(b))))
    held = t.select((F.col("depth") - 1).alias("depth"), cell.alias("prefix"), up.alias("texel"), "tone", *bands)
    g = held.groupBy("depth", "prefix", "texel").agg(*(mean(b).alias(b) for b in bands))
    return g.select("depth", "prefix", "texel", *(F.when(F.col(b).isNull(), 0).otherwise(L.roll(F.lit(L.IMAGERY), F.col(b))).alias(b) for b in bands))
