"""Which labels stand in a view: the choice that goes through labels in order and keeps each one that meets none kept before, without going through them one by one.

Labels are dealt to small squares. A label that comes first in every square it touches meets no open label before it, so it
stands; what it meets goes, and the rest is looked at again. Two labels that meet share a square, so this ends with the
labels of the sequential choice. A round works on all views at once; no pairs of labels are formed, and a crowded square
counts by its least order, which is aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, forget


def boxes_meet(a: str, b: str) -> Column:
    """Whether two boxes share an inner point."""
    lo, hi = lambda c: F.greatest(f"{a}.{c}", f"{b}.{c}"), lambda c: F.least(f"{a}.{c}", f"{b}.{c}")
    return (lo("x0") < hi("x1")) & (lo("y0") < hi("y1"))


def chosen(labels: DataFrame, view: str, key: str, order: list[Column], side: float, meet=boxes_meet) -> DataFrame:
    """The labels (with box x0, y0, x1, y1) that stand, view by view, going by `order` and then by key. side: of the squares, about the height of a label. meet: whether two labels, named by aliases, exclude each other; labels that do must have boxes that touch. Labels whose box is null have no place and do not stand."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(key).alias("key"))
    cell = lambda c: F.floor(F.col(c) / side)
    todo = labels.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").select(F.col(view).alias("view"), place.alias("place"), *(F.least(f"{a}0", f"{a}1").alias(f"{a}0") for a in "xy"), *(F.greatest(f"{a}0", f"{a}1").alias(f"{a}1") for a in "xy"))
    # labels of one box exclude each other, if they have an inside, and meet the same others: only the first of them can stand
    box = ["view", "x0", "y0", "x1", "y1"]
    itself = todo.withColumns({c: F.struct("place", *box[1:]) for c in "ab"}).withColumn("_self", F.coalesce(meet("a", "b"), F.lit(False)))
    firsts = itself.where("_self").groupBy(*box).agg(F.min("place").alias("place"))
    todo = cut(firsts.unionByName(itself.where("NOT _self").select(*firsts.columns)))
    stand = None
    while not todo.isEmpty():
        spread = todo.withColumn("sx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("sy", F.explode(F.sequence(cell("y0"), cell("y1"))))
        first = spread.groupBy("view", "sx", "sy").agg(F.min("place").alias("least"))
        wins = spread.join(first, ["view", "sx", "sy"]).groupBy("view", "place").agg(F.min((F.col("least") == F.col("place")).cast("int")).alias("all")).where("all = 1").select("view", "place")
        won = cut(todo.join(wins, ["view", "place"], "left_semi"))
        taken = won.withColumn("sx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("sy", F.explode(F.sequence(cell("y0"), cell("y1"))))
        gone = spread.alias("a").join(taken.alias("b"), ["view", "sx", "sy"]).where((F.col("a.place") == F.col("b.place")) | meet("a", "b")).select("view", F.col("a.place").alias("place")).distinct()
        rest = cut(todo.join(gone, ["view", "place"], "left_anti"))
        forget(todo)
        todo, stand = rest, won if stand is None else stand.unionByName(won)
    forget(todo)
    if stand is None:
        return labels.limit(0)
    return labels.join(stand.select(F.col("view").alias(view), F.col("place.key").alias(key)), [view, key], "left_semi").select(*labels.columns)


def merged_points(points: DataFrame, view: str, key: str, identity: list[str], within: float = 96.0) -> DataFrame:
    """Points (x, y) without those that lie closer than `within` to an earlier one of the same identity, by key: a place that two cells name is lettered once."""
    name = F.struct(F.col(view).alias("view"), *identity)
    near = lambda a, b: (F.col(f"{a}.x0") - F.col(f"{b}.x0")) ** 2 + (F.col(f"{a}.y0") - F.col(f"{b}.y0")) ** 2 < within * within
    p = points.withColumns({"_of": name, "x0": F.col("x") - within / 2, "x1": F.col("x") + within / 2, "y0": F.col("y") - within / 2, "y1": F.col("y") + within / 2})
    return chosen(p, "_of", key, [], within, near).drop("_of", "x0", "x1", "y0", "y1")


def gathered(texels: DataFrame, river: int = 12, lake: int = 44) -> DataFrame:
    """(view, kind, name, reference, rank, size, x0, y0, x1, y1): each name of a view once, with how many texels it has there and their box. texels: view, kind, name, reference, rank, x, y (on the screen), area_kind (of the area there, or null). A river's texels inside a lake do not count."""
    t = texels.where((F.col("kind") != river) | ~F.col("area_kind").eqNullSafe(F.lit(lake)))
    return t.groupBy("view", "kind", "name", "reference").agg(F.max("rank").alias("rank"), F.count("*").alias("size"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
