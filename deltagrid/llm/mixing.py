"""Mixing sources to target weights by capped water-filling.

A source's size is the sum of its rows' sizes (words). All sources together get the size of the whole corpus, dealt by
weight; no source's target exceeds `epochs` times its size, and what is above is dealt again by weight until none is.
The level at which this ends is found in closed form: with sources in order of cap / weight, those before some place are
full and the rest share what remains.

A source whose target is e times its size gives every row floor(e) times, and rows of a seeded order once more until
the rest of the target is met. Around the place where the rest ends, the FRINGE rows before and after it are dealt anew,
the largest first, each if it still fits, and at last the least row left over if that comes nearer than leaving it; so a
source of up to FRINGE rows ends within its least row left over, and larger ones much nearer. The order is cut into
1,024 buckets per source, so that a source with a third of all rows spreads over as many tasks; only the buckets around the
place in which the rest ends are looked at row by row before the last pass.

Null and empty texts have size 0 and are taken floor(e) times or once more like others (0 words either way). A null
source is a source of its own, last in order. Repeated rows are rows of their own. Rows of equal key come in order of size
and then of a hash of their columns (maps aside). An empty table gives an empty table, sources of size 0 get target 0.
Reruns agree: the order depends on rows and seed only. Other columns pass through, whatever their names; an input column
with an output's name, in whatever case, is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, others
from .rules import BLANK

WEIGHTS = (5.0, 2.0, 1.0)
OUT = ("size", "source_size", "target", "copies")
#: Rows on either side of the place where a source's rest ends that are dealt anew.
FRINGE = 128


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = 3.0) -> DataFrame:
    """(source, source_size) with target. One row a source: these windows see sources, never rows of the corpus."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", epochs * F.col("source_size"))
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that is not filled to its cap sets the level of all that are not
    s = s.withColumn("level", F.min(F.struct(F.when(F.col("cap") > F.col("level") * F.col("weight"), 0).otherwise(1), F.col("cap") / F.col("weight"), "level")).over(everything)["level"])
    return s.select(*sizes.columns, F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _fringe(narrow: DataFrame, cells: DataFrame, inside) -> DataFrame:
    """For each source with a rest: which rank its fringe begins at, and the ranks in it that are taken once more."""
    whole = Window.partitionBy("of")
    spot = F.max(F.when(F.col("start") <= F.col("rest"), F.struct("bucket", "rank0", "n"))).over(whole)
    near = cells.where("rest > 0").withColumn("spot", spot).where((F.col("rank0") < F.col("spot.rank0") + F.col("spot.n") + FRINGE) & (F.col("rank0") + F.col("n") > F.col("spot.rank0") - FRINGE))
    rows = narrow.withColumn("rank", F.row_number().over(inside) - 1).withColumn("begun", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(near.select("of", "bucket", "start", "rank0", "rest"), ["of", "bucket"])
    rows = rows.withColumn("rank", F.col("rank0") + F.col("rank")).withColumn("begun", F.col("start") + F.col("begun"))
    ends = F.coalesce(F.max(F.when(F.col("begun") + F.col("size") <= F.col("rest"), F.col("rank") + 1)).over(whole), F.lit(0))
    rows = rows.withColumn("ends", ends).where((F.col("rank") >= F.col("ends") - FRINGE) & (F.col("rank") < F.col("ends") + FRINGE))
    # at most 2 * FRINGE rows a source come together here
    found = rows.groupBy("of").agg(F.min("rank").alias("first"), (F.first("rest") - F.min("begun")).alias("gap"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "ord", "tie", "rank"))).alias("rows"))
    begin = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("taken"), F.lit(None).cast("struct<size:bigint,rank:bigint>").alias("spare"))

    def step(s, x):
        fits, of = -x["less"] <= s["gap"], F.struct((-x["less"]).alias("size"), x["rank"].alias("rank"))
        return F.struct(F.when(fits, s["gap"] + x["less"]).otherwise(s["gap"]).alias("gap"), F.when(fits, F.array_append(s["taken"], x["rank"])).otherwise(s["taken"]).alias("taken"), F.when(fits, s["spare"]).otherwise(of).alias("spare"))

    last = lambda s: F.when(s["spare"]["size"] - s["gap"] < s["gap"], F.array_append(s["taken"], s["spare"]["rank"])).otherwise(s["taken"])
    return found.select("of", "first", F.aggregate("rows", begin, step, last).alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: float = 3.0, seed: int = 11) -> DataFrame:
    """df with size, source_size, target (its source's) and copies (how often the mix takes the row). size: of a row, by default the words of its text."""
    size = words(F.col("text")) if size is None else size
    # 60 bits of a digest that any engine has; their first ten are the bucket, so buckets follow the order
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    # a source's name as a key that is never null
    of = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = df.select(F.struct(*others(df, *OUT)).alias("row"), F.col(source).alias("source"), of.alias("of"), size.alias("size"), order.alias("ord"), F.xxhash64(*hashed).alias("tie")).withColumn("bucket", F.shiftright("ord", 50).cast("int"))
    inside = Window.partitionBy("of", "bucket").orderBy("ord", "size", "tie")
    cells = cut(rows.groupBy("of", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("cell_size"), F.count("*").alias("n")), "cells")
    plan = targets(cells.groupBy("of").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size")), weights, epochs)
    plan = plan.withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.least(F.floor("e"), F.lit(int(epochs))).cast("int")).withColumn("rest", F.when(F.col("whole") < epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).withColumn("rank0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cut(cells.drop("source").join(plan.drop("source", "e"), "of"), "cells")
    fringe = _fringe(rows.select("of", "bucket", "ord", "size", "tie"), cells, inside)
    here = (F.col("rank0") < F.col("first") + 2 * FRINGE) & (F.col("rank0") + F.col("n") > F.col("first"))
    cells = cells.join(fringe, "of", "left").select("of", "bucket", "source_size", "target", "whole", "rank0", "first", F.when(here, F.col("taken")).alias("taken"))
    held = rows.withColumn("rank", F.row_number().over(inside) - 1).join(cells, ["of", "bucket"]).withColumn("rank", F.col("rank0") + F.col("rank"))
    more = (F.col("rank") < F.coalesce("first", F.lit(0))) | F.coalesce(F.array_contains("taken", F.col("rank")), F.lit(False))
    return held.select("row.*", "size", "source_size", "target", (F.col("whole") + more.cast("int")).alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as copies says."""
    rows = mixed.where("copies > 0").select(F.struct(*(F.col(f"`{c}`") for c in mixed.columns)).alias("row"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return rows.select("row.*")
