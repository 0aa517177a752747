"""Nearest places where points and places share spots."""

from pyspark.sql import functions as F

from deltagrid.operators import search


def tables(spark):
    points = spark.range(600).selectExpr("id", "46 + CAST(id % 2 AS DOUBLE) / 100 AS lat", "-122D AS lon", "id % 3 AS part")
    places = spark.range(3000).selectExpr("id", "46.001 + CAST(id % 2 AS DOUBLE) / 100 AS lat", "-122D AS lon", "id % 3 AS part", "id * 10 AS zip")
    return points, places


def test_lowest_alike_place_of_a_spot(spark):
    points, places = tables(spark)
    got = search.nearest(points.unionByName(points.where("id < 5")), places, alike="part", bring=("zip",)).collect()
    assert len(got) == 600
    for r in got:
        best = min(range(6), key=lambda p: (p % 3 != r["id"] % 3, (p - r["id"]) % 2, p))
        assert (r["place"], r["zip"]) == (best, best * 10)


def test_explode_is_not_broadcast(spark):
    points, places = tables(spark)
    text = search.nearest(points.where(F.col("id") > 0), places)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_a" in text
