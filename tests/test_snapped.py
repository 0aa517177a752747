"""Snapping with many ways in a texel and many points at a spot."""

from pyspark.sql import functions as F

from deltagrid.functions import cells as C
from deltagrid.operators import routes


def test_ways_and_points_come_in_after_the_rings(spark):
    points = C.encode(spark.range(50).selectExpr("id", "46.5D AS lat", "-121.5D AS lon"))
    ways = points.select(C.prefix(6).alias("prefix"), C.texel(6).alias("texel")).distinct().crossJoin(spark.range(40).select(F.col("id").alias("way")))
    got = routes.snapped(points, ways, 6, 8)
    assert got.count() == 2000 and got.select("id", "way").distinct().count() == 2000
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Window [" in line)
    depth = lines[at].index("Window")
    below = []
    for line in lines[at:]:
        if below and len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert not any("way#" in line or "id#" in line.split("Range")[0] for line in below[:3])


def test_only_ways_within_reach_are_stamped_and_what_is_snapped_is_the_same(spark):
    """A lattice of short ways, and a long one whose points are all far from the places that it passes."""
    from deltagrid.operators import journeys

    far = spark.range(400).selectExpr("id AS way", "47 + id DIV 20 * 0.01D AS lat", "-122 + id % 20 * 0.01D AS lon").crossJoin(spark.range(3).selectExpr("id AS pos")).selectExpr("way", "pos", "lat", "lon + pos * 0.002D AS lon")
    long = spark.createDataFrame([(1000, 0, 46.95, -121.9), (1000, 1, 47.25, -121.9)], "way bigint, pos bigint, lat double, lon double")
    ways = C.encode(far.unionByName(long)).selectExpr("*", "0 AS oneway")
    points = C.encode(spark.createDataFrame([(1, 47.1, -121.902), (2, 47.021, -121.958), (3, None, 0.0)], "id bigint, lat double, lon double"))
    near = routes.within(points, ways, journeys.rings(12, 11, 60, 800.0))
    assert 2 < near.select("way").distinct().count() < 40 and near.where("way = 1000").count() == 2

    def found(of):
        fine = routes.passed(of, 12).selectExpr("12 AS depth", "prefix", "texel", "way")
        coarse = fine.select(F.lit(11).alias("depth"), *(c.alias(n) for c, n in zip(C.texel_parent(F.col("prefix"), F.col("texel")), ("prefix", "texel"), strict=True)), "way").distinct()
        going = of.select("way").distinct()
        return sorted(journeys.snapped(points, fine.unionByName(coarse), going, 12, 11, 60, 800.0).collect())

    whole = found(ways)
    assert whole == found(near) and {r["id"] for r in whole} == {1, 2} and 1000 in {r["way"] for r in whole}


def test_many_points_and_ways_at_one_spot_are_dealt_to_tasks_by_their_rows(spark):
    points = C.encode(spark.range(300).selectExpr("id", "46.5D + id % 2 * 0.003D AS lat", "-121.5D AS lon"))
    ways = points.select(C.prefix(6).alias("prefix"), C.texel(6).alias("texel")).distinct().crossJoin(spark.range(40).select(F.col("id").alias("way")))
    plain = routes.snapped(points, ways, 6, 8).withColumn("metres", F.round("metres", 3))
    got = routes.snapped(points, ways, 6, 8, digits=3, task_rows=1000)
    per = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == plain.count() >= 12_000 and max(per) < sum(per) / 2
    assert sorted(got.collect()) == sorted(plain.collect())
    none = routes.snapped(points.where("id < 0"), ways, 6, 8, digits=3, task_rows=1000)
    assert none.columns == plain.columns and none.isEmpty()
