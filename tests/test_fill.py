"""The fill as a table function against the fill as expressions."""

import math

import pytest
from pyspark.sql import functions as F

from deltagrid.operators import fill, polygons


@pytest.fixture(scope="module")
def shapes(spark):
    fill.register(spark)
    star = lambda n, r, x, y, turn: [(x + r * (1 if k % 2 else 0.4) * math.cos(turn + math.pi * k / n), y + r * (1 if k % 2 else 0.4) * math.sin(turn + math.pi * k / n)) for k in range(2 * n)]
    rows = [(k, [star(3 + k, 5 + 3 * k, 40.3, 30.7, k / 7), star(4, 1 + k, 40.1, 30.2, k)]) for k in range(8)]
    rows += [(8, [[(1.0, 1.0), (1.0, 5.0), (4.0, 5.0), (4.0, 1.0), (1.0, 1.0)]]), (9, None), (10, []), (11, [[(3.0, 3.0)]]), (12, [[(0.0, 2.0), (9.0, 2.0)]])]
    told = [(i, None if r is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in r]) for i, r in rows]
    return spark.createDataFrame(told, "id int, rings array<array<struct<x:double,y:double>>>")


def edges(shapes):
    ring = shapes.select("id", F.explode("rings").alias("r")).where("size(r) > 0")
    pairs = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", (i + 1) % F.size("r")).alias("b")))
    return ring.withColumn("e", F.explode(pairs)).selectExpr("id", "e.a.x AS x0", "e.a.y AS y0", "e.b.x AS x1", "e.b.y AS y1")


def rows(df):
    return sorted((r["id"], r["tx"], r["ty"], r["half"]) for r in df.collect())


@pytest.mark.parametrize("batch", [5, 1 << 16])
def test_the_table_function_equals_the_expressions(spark, shapes, monkeypatch, batch):
    shapes.createOrReplaceTempView("shapes_to_fill")
    got = spark.sql("SELECT id, f.tx, f.ty, f.half FROM shapes_to_fill, LATERAL fill_polygon(rings, CAST(NULL AS STRUCT<tx0: DOUBLE, ty0: DOUBLE, tx1: DOUBLE, ty1: DOUBLE>)) f")
    want = rows(polygons.fill(edges(shapes)))
    assert rows(got) == want and len({w[0] for w in want}) == 9
    monkeypatch.setattr(fill, "BATCH", batch)
    edges(shapes).selectExpr("CAST(id AS BIGINT) AS id", "x0", "y0", "x1", "y1").createOrReplaceTempView("edges_to_fill")
    assert rows(spark.sql("SELECT * FROM fill_edges(TABLE(edges_to_fill) PARTITION BY id)")) == want
    one = shapes.where("id = 7").first()
    direct = [(7, *t) for part in fill.texels([fill.edges_of([(p["x"], p["y"]) for p in r]) for r in one["rings"]]) for t in zip(*(a.tolist() for a in part), strict=True)]
    assert sorted(direct) == [w for w in want if w[0] == 7]


def test_a_window_is_the_part_of_the_whole_that_it_holds(spark, shapes):
    shapes.createOrReplaceTempView("shapes_to_fill")
    got = rows(spark.sql("SELECT id, f.* FROM shapes_to_fill, LATERAL fill_polygon(rings, named_struct('tx0', 35D, 'ty0', 28D, 'tx1', 44D, 'ty1', 33D)) f"))
    want = [w for w in rows(polygons.fill(edges(shapes))) if 35 <= w[1] < 44 and 28 <= w[2] < 33]
    assert got == want and want
