"""Stamping lines and points into triangle texels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from .dealt import dealt


def metric(du: Column, dv: Column) -> Column:
    """Distance in texels between places of a diamond, whose axes stand at 60 degrees."""
    return F.sqrt(du * du + dv * dv + du * dv)


def segments(lines: DataFrame, depth: int) -> DataFrame:
    """(prefix, texel, class, cov, mag, uses, name): segments as bands of radius r around half-texel steps, feathered over the last texel. lines: seq, diamond, class, cov_max, mag, uses, name (0: none), r, and the ends au, av, bu, bv in texels of the depth.

    A texel goes to the most coverage, of equals to the lowest class and then the first line, whose name and magnitude it takes; its uses are those of all lines that touch it. Each line is reduced to one row a texel before the shuffle; steps and reach bound what one segment makes.
    """
    extent = C.TEX << depth
    du, dv = F.col("bu") - F.col("au"), F.col("bv") - F.col("av")
    s = dealt(lines, 500).withColumn("steps", F.greatest(F.ceil(metric(du, dv) * 2), F.lit(1)).cast("int")).withColumn("reach", F.ceil(F.col("r") * 1.16 + 1).cast("int"))
    s = s.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("t", F.col("t") / F.col("steps"))
    s = s.withColumns({"px": F.col("au") + du * F.col("t"), "py": F.col("av") + dv * F.col("t")})
    around = F.sequence(-F.col("reach"), F.col("reach"))
    s = s.withColumn("tx", F.explode(around)).withColumn("ty", F.explode(around)).withColumns({"tx": F.floor("px") + F.col("tx"), "ty": F.floor("py") + F.col("ty")})
    s = s.where(F.col("tx").between(0, extent - 1) & F.col("ty").between(0, extent - 1)).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    off = F.when(F.col("half") == 0, F.lit(1.0) / 3).otherwise(F.lit(2.0) / 3)
    d = metric(F.col("tx") + off - F.col("px"), F.col("ty") + off - F.col("py"))
    cov = (F.col("cov_max") * F.least(F.greatest(F.col("r") + 0.5 - d, F.lit(0.0)), F.lit(1.0))).cast("int")
    s = s.withColumn("cov", cov).where("cov > 0")
    best = F.max_by(F.struct("class", "cov", "mag", "name"), F.struct("cov", -F.col("class"), -F.col("seq")))
    g = s.groupBy("diamond", "tx", "ty", "half").agg(best.alias("b"), F.bit_or("uses").alias("uses"))
    cell = C.from_grid(depth, F.col("diamond"), F.shiftright("tx", C.TEX_BITS), F.shiftright("ty", C.TEX_BITS))
    low = lambda c: F.col(c).bitwiseAND(C.TEX - 1)
    return g.select(cell.alias("prefix"), C.texel_index(low("tx"), low("ty"), F.col("half").cast("bigint")).alias("texel"), "b.class", "b.cov", "b.mag", "uses", "b.name")


def points(marks: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """What each texel (key) holds after marks (kind 64 and up, rank, seq) came to it in order of seq over lines (kind; 0: empty).

    An empty texel takes any mark; a place takes a texel from a line or a business, and businesses (95 and up) never do; of two places or two businesses the higher rank stays, of equals the first. So the result is the first of the highest rank among places, or, where none came and no line was, among businesses: one aggregation.
    """
    first = lambda cond: F.max_by(F.when(cond, F.struct("kind", "rank", "seq")), F.when(cond, F.struct("rank", -F.col("seq"))))
    found = marks.groupBy(*key).agg(first(F.col("kind") < 95).alias("_p"), first(F.col("kind") >= 95).alias("_b"))
    both = lines.select(*key, F.col("kind").alias("_k")).join(found, key, "full_outer")
    held = F.struct(F.col("_k").alias("kind"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("seq"))
    won = F.when(F.col("_p").isNotNull(), F.col("_p")).when((F.coalesce("_k", F.lit(0)) == 0) & F.col("_b").isNotNull(), F.col("_b"))
    out = both.withColumn("_r", won)
    return out.select(*key, *(F.coalesce(F.col(f"_r.{c}"), held[c]).alias(c) for c in ("kind", "rank", "seq")))


def first_stamps(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Of rows with one key the first one."""
    w = Window.partitionBy(*key).orderBy(seq)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
