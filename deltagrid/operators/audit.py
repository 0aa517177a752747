"""Counts and shares over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_depth(cells: DataFrame) -> DataFrame:
    """Cells, whole mean and total bytes by depth."""
    return cells.groupBy("depth").agg(F.count("*").alias("cells"), F.floor(F.avg("bytes")).alias("mean"), F.sum("bytes").alias("total"))


def shares(df: DataFrame, section: str, size: str) -> DataFrame:
    """Bytes by section and percent of all; the total is one row joined to the few sections."""
    by = df.groupBy(F.col(section).alias("section")).agg(F.sum(size).alias("bytes"))
    total = by.agg(F.sum("bytes").alias("_t"))
    return by.join(F.broadcast(total)).select("section", "bytes", (100.0 * F.col("bytes") / F.col("_t")).alias("share"))


def gaps(texels: DataFrame, missing: Column, levels: int, limit: float) -> DataFrame:
    """By the ancestor so many levels up: cells, those with more than the limit missing, and the worst share."""
    cells = texels.groupBy("prefix").agg(F.round(F.avg(F.when(missing, 1.0).otherwise(0.0)), 6).alias("missing"))
    return cells.groupBy(F.shiftright("prefix", 2 * levels).alias("area")).agg(F.count("*").alias("cells"), F.sum((F.col("missing") > limit).cast("bigint")).alias("bad"), F.max("missing").alias("worst"))


def biggest_gaps(texels: DataFrame, missing: Column, wet: Column, levels: int, limit: float = 0.01, most: int = 10) -> DataFrame:
    """(area, cells, bad, missing, wet): of the areas with cells that miss more than the limit, those with most such cells first: their texels missing in per cent, and how many per cent of these are water. `most` areas are shown, which is the report."""
    cells = texels.groupBy("prefix").agg(F.count("*").alias("n"), F.count_if(missing).alias("gone"), F.count_if(missing & wet).alias("sea"))
    a = cells.groupBy(F.shiftright("prefix", 2 * levels).alias("area")).agg(F.count("*").alias("cells"), F.count_if(F.col("gone") > limit * F.col("n")).alias("bad"), F.sum("n").alias("n"), F.sum("gone").alias("gone"), F.sum("sea").alias("sea")).where("bad > 0")
    share = lambda part, whole: F.round(100.0 * F.col(part) / F.col(whole), 6)
    return a.orderBy(F.desc("bad"), F.desc("gone"), "area").limit(most).select("area", "cells", "bad", share("gone", "n").alias("missing"), share("sea", "gone").alias("wet"))


def letters(df: DataFrame, text: Column) -> DataFrame:
    return df.select(F.explode(F.split(text, "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
