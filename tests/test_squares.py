"""Points in polygons by squares against the plain even-odd rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from deltagrid.operators import areas


def inside(rings, lat, lon):
    n = 0
    for r in rings:
        for (y0, x0), (y1, x1) in zip(r, r[1:], strict=False):
            if (y0 <= lat) != (y1 <= lat) and x0 + (lat - y0) / (y1 - y0) * (x1 - x0) > lon:
                n += 1
    return n % 2 == 1


def star(rng, y, x, r, n):
    pts = [(y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n), x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    return [*pts, pts[0]]


def square(y0, x0, y1, x1):
    return [(y0, x0), (y0, x1), (y1, x1), (y1, x0), (y0, x0)]


POLYGON = "id int, rings array<array<struct<lat:double,lon:double>>>"


def frames(spark, polygons, points):
    told = [(i, [[{"lat": float(a), "lon": float(b)} for a, b in r] for r in rings] if rings is not None else None) for i, rings in polygons]
    return spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(told, POLYGON)


@pytest.mark.parametrize(("per_degree", "held"), [(20, 1000), (4, 3), (1, 1000)])
def test_points_in_polygons_of_all_sizes(spark, monkeypatch, per_degree, held):
    monkeypatch.setattr(areas, "EDGES", held)
    rng = random.Random(11)
    polygons = [(k, [star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice((0.04, 0.6, 3.0)), rng.choice((5, 40, 300)))]) for k in range(14)]
    polygons += [
        (20, [square(-2.0, -2.0, 2.0, 2.0), square(-1.0, -1.0, 1.0, 1.0)]),  # a hole, all corners on lines of the squares
        (21, [square(-0.5, -0.5, 0.5, 0.5), [(0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.25, 0.25)]]),
        (22, [[(-1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0)]]),  # edges through corners of squares
        (23, None), (24, []), (25, [[]]), (26, [[(1.0, 1.0)]]), (27, [square(-30.0, -40.0, 30.0, 40.0)]),
    ]
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(700)]
    points += [(1000 + 100 * i + j, i / 20 - 1.0, j / 20 - 1.0) for i in range(41) for j in range(41)]  # on lines and corners of the squares
    points += [(9000, None, 1.0), (9001, 0.1, 0.1), (9002, 0.1, 0.1)]
    a, b = frames(spark, polygons, points)
    got = sorted((r["p"], r["id"]) for r in areas.points_in(a, b, per_degree).collect())
    generic = lambda i: i in range(14)
    want = sorted((p, i) for p, y, x in points for i, rings in polygons if rings and y is not None and inside(rings, y, x))
    assert got == want and {i for _, i in got} >= {20, 21, 22, 27} and any(generic(i) for _, i in got)


def test_a_ring_of_many_points_stays_small_rows(spark):
    n = 60_000
    ring = spark.range(n + 1).select((F.col("id") % n).alias("k"), "id").select("id", (47 + 0.02 * F.sin(F.col("k") * 2 * math.pi / n) * (1 + 0.3 * F.sin(F.col("k") * 0.37))).alias("lat"), (-122 + 0.02 * F.cos(F.col("k") * 2 * math.pi / n)).alias("lon"))
    polygon = ring.groupBy(F.lit(1).alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "lat", "lon"))).alias("r")).select("id", F.array(F.transform("r", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))).alias("rings"))
    rows = polygon.first()["rings"][0]
    rng = random.Random(2)
    points = [(i, 47 + rng.uniform(-0.03, 0.03), -122 + rng.uniform(-0.03, 0.03)) for i in range(60)]
    got = {r["p"] for r in areas.points_in(spark.createDataFrame(points, "p int, lat double, lon double"), polygon, 200).collect()}
    told = [[(p["lat"], p["lon"]) for p in rows]]
    assert got == {i for i, y, x in points if inside(told, y, x)}
    border, _ = areas.cover(areas.edges_of(polygon, "id"), "id", 1 / 200)
    assert border.count() < 400


def test_a_large_polygon_is_told_in_few_blocks(spark):
    _, b = frames(spark, [(1, [square(-60.0, -170.0, 60.0, 170.0)])], [(0, 0.0, 0.0)])
    border, whole = areas.cover(areas.edges_of(b, "id"), "id", 1.0)
    assert whole.count() < 120 * 60 and whole.agg(F.sum("block")).first()[0] + border.count() >= 120 * 340
    assert border.where("odd").count() > 0
