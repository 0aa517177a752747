"""New data over old: full outer joins by texel, with each layer's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["depth", "prefix", "texel"]


def over(new: DataFrame, old: DataFrame, columns: list[str], footprint: DataFrame | None = None, take_new=None) -> DataFrame:
    """Coverage layers. With a footprint (KEY) the new data rule inside it, even where they are empty; without, they rule where they cover anything, or where take_new(new, old), a predicate on both texels as structs, says so."""
    n = new.select(*KEY, F.struct(*columns).alias("_n"))
    o = old.select(*KEY, F.struct(*columns).alias("_o"))
    both = n.join(o, KEY, "full_outer")
    if take_new is not None:
        pick = F.when(F.coalesce(take_new(F.col("_n"), F.col("_o")), F.lit(False)), F.col("_n")).otherwise(F.coalesce("_o", "_n"))
    elif footprint is None:
        pick = F.when(F.col("_n.cov") > 0, F.col("_n")).otherwise(F.coalesce("_o", "_n"))
    else:
        both = both.join(footprint.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left")
        pick = F.when(F.col("_in"), F.col("_n")).otherwise(F.col("_o"))
    return both.withColumn("_p", pick).where("_p IS NOT NULL").select(*KEY, *(F.col(f"_p.{c}").alias(c) for c in columns))


def values(new: DataFrame, old: DataFrame, column: str) -> DataFrame:
    """Terrain: new where it has a value, else old."""
    return new.select(*KEY, F.col(column).alias("_n")).join(old.select(*KEY, F.col(column).alias("_o")), KEY, "full_outer").select(*KEY, F.coalesce("_n", "_o").alias(column))


def names(new: DataFrame, old: DataFrame, take_new, column: str = "name") -> DataFrame:
    """Names by texel: the new one where a predicate on it says so, else the old one; texels that get none drop out."""
    both = new.select(*KEY, F.col(column).alias("_n")).join(old.select(*KEY, F.col(column).alias("_o")), KEY, "full_outer")
    return both.select(*KEY, F.when(F.coalesce(take_new(F.col("_n")), F.lit(False)), F.col("_n")).otherwise(F.col("_o")).alias(column)).where(F.col(column).isNotNull())


def highest(new: DataFrame, old: DataFrame, column: str = "cov") -> DataFrame:
    return new.select(*KEY, F.col(column)).unionByName(old.select(*KEY, F.col(column))).groupBy(*KEY).agg(F.max(column).alias(column))


def seabed(new: DataFrame, old: DataFrame, flat: float = 0.75) -> DataFrame:
    """Where the old elevation is about sea level and the new is below it: the new one, and water."""
    both = old.select(*KEY, F.col("elev").alias("_o")).join(new.select(*KEY, F.col("elev").alias("_n")), KEY, "left")
    wet = (F.abs("_o") <= flat) & (F.col("_n") < 0)
    return both.select(*KEY, F.when(wet, F.col("_n")).otherwise(F.col("_o")).alias("elev"), F.when(wet, 255).otherwise(0).alias("water"))


def painted(polygons: DataFrame, wilderness: DataFrame) -> DataFrame:
    """Owners by paint order (the last wins), then wilderness adds 16, also where there is no owner."""
    own = polygons.groupBy(*KEY).agg(F.max_by("class", "paint").alias("class"))
    wild = wilderness.select(*KEY).distinct().withColumn("_w", F.lit(16))
    return own.join(wild, KEY, "full_outer").select(*KEY, (F.coalesce("class", F.lit(0)) + F.coalesce("_w", F.lit(0))).alias("class"))


def minus_finer(coarse: DataFrame, finer: DataFrame, levels: int) -> DataFrame:
    """Cells (depth, prefix) without those that have a descendant `levels` deeper in finer."""
    blocked = finer.select(F.shiftright("prefix", 2 * levels).alias("prefix")).distinct()
    return coarse.join(blocked, "prefix", "left_anti")


def without_class(df: DataFrame, cls: int) -> DataFrame:
    return df.where(F.col("class") != cls)


def changed(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose content hash differs from what old has under the key, with the hash: what a publish has to write."""
    digest = lambda df: df.select(*keys, F.xxhash64(*[c for c in sorted(df.columns) if c not in keys]).alias("hash"))
    return digest(new).join(digest(old).withColumnRenamed("hash", "_h"), keys, "left").where("_h IS NULL OR _h <> hash").drop("_h")
