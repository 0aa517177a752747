"""The conic projection, polygons cut to boxes, and the fields of the layers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from deltagrid.operators import landuse

from .test_squares import POLYGON, inside, square, star


def plain_inverse(c, x, y):
    """By halving: the latitude whose forward distance fits."""
    n, k, rho0 = c.cone
    rho = math.hypot(x, rho0 - y)
    low, high = -89.0, 89.0
    for _ in range(80):
        mid = (low + high) / 2
        if c.a * math.sqrt(k - n * c._q(math.sin(math.radians(mid)))) / n > rho:
            low = mid
        else:
            high = mid
    return low, c.lon0 + math.degrees(math.atan2(x, rho0 - y)) / n


def test_the_projection_goes_there_and_back(spark):
    c, rng = landuse.Conic(), random.Random(1)
    rows = [(i, rng.uniform(18, 60), rng.uniform(-170, -60)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, lat double, lon double")
    x, y = c.forward(F.col("lat"), F.col("lon"))
    df = df.withColumns({"x": x, "y": y})
    lat, lon = c.inverse(F.col("x"), F.col("y"))
    for r in df.withColumns({"lat2": lat, "lon2": lon}).collect():
        assert abs(r["lat2"] - r["lat"]) * 111_320 < 1e-3 and abs(r["lon2"] - r["lon"]) * 111_320 < 1e-3
        p = plain_inverse(c, r["x"], r["y"])
        assert abs(p[0] - r["lat2"]) < 1e-9 and abs(p[1] - r["lon2"]) < 1e-9
    # a value of the published worked example for the same formulas (another ellipsoid, the same parallels)
    clarke = landuse.Conic(a=6_378_206.4, f=1 - math.sqrt(1 - 0.00676866))
    one = spark.createDataFrame([(35.0, -75.0)], "lat double, lon double").select(*(v.alias(n) for v, n in zip(clarke.forward(F.col("lat"), F.col("lon")), "xy", strict=True))).first()
    assert abs(one["x"] - 1885472.7) < 0.1 and abs(one["y"] - 1535925.0) < 0.1


@pytest.fixture(scope="module")
def pieces(spark):
    rng = random.Random(21)
    polygons = [(k, [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice((0.2, 1.5)), rng.choice((4, 25, 120)))]) for k in range(12)]
    polygons += [(20, [square(-1.9, -1.9, 1.7, 1.7), square(-1.1, -1.1, 0.9, 0.9)[::-1]]), (21, [square(-9.0, -9.0, 9.0, 9.0)]), (22, [square(0.1, 0.1, 0.2, 0.2)[::-1]])]
    told = [(i, [[{"lat": float(a), "lon": float(b)} for a, b in r] for r in rings]) for i, rings in polygons]
    boxes = [(10 * i + j, -4 + 1.003 * i, -4 + 0.997 * j, -4 + 1.003 * (i + 1), -4 + 0.997 * (j + 1)) for i in range(8) for j in range(8)]
    made = landuse.cut(spark.createDataFrame(told, POLYGON), spark.createDataFrame(boxes, "box int, lat0 double, lon0 double, lat1 double, lon1 double"), "id").cache()
    return polygons, boxes, made


def ring_area(rings):
    one = lambda r: sum(x0 * y1 - x1 * y0 for (y0, x0), (y1, x1) in zip(r, r[1:], strict=False)) / 2
    return abs(sum(one(r) for r in rings))


def test_cut_areas_add_up_to_the_whole(pieces):
    polygons, boxes, made = pieces
    whole = {r["id"]: r["area"] for r in landuse.degrees2(made, "id").groupBy("id").agg(F.sum("area").alias("area")).collect()}
    for i, rings in polygons:
        assert abs(whole[i] - (8 * 1.003 * 8 * 0.997 if i == 21 else ring_area(rings))) < 1e-9, i
    assert all(r["area"] > -1e-12 for r in landuse.degrees2(made, "id").where("id >= 20").collect())  # the stars cross themselves


def test_pieces_hold_what_both_polygon_and_box_hold(pieces):
    polygons, boxes, made = pieces
    rng, edges = random.Random(5), {}
    for r in made.collect():
        edges.setdefault((r["id"], r["box"]), []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    for _ in range(3000):
        y, x = rng.uniform(-3.9, 3.9), rng.uniform(-3.9, 3.9)
        (box,) = [b[0] for b in boxes if b[1] <= y < b[3] and b[2] <= x < b[4]]
        for i, rings in polygons:
            n = sum((y0 <= y) != (y1 <= y) and x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x for x0, y0, x1, y1 in edges.get((i, box), ()))
            assert (n % 2 == 1) == inside(rings, y, x)
    assert len(edges[21, 33]) == 4  # a box amid a polygon costs its own four sides


def test_sides_on_sides_count_once(spark):
    """Polygons whose sides lie on those of the boxes, inside and outside."""
    rings = lambda *r: [[{"lat": y, "lon": x} for y, x in ring] for ring in r]
    told = [(1, rings(square(0.0, 0.0, 2.0, 2.0))), (2, rings(square(0.0, 0.0, 1.0, 1.0))), (3, rings(square(0.5, 0.0, 1.5, 2.0), square(0.75, 1.0, 1.0, 1.5)[::-1]))]
    boxes = [(10 * i + j, float(i), float(j), i + 1.0, j + 1.0) for i in range(-1, 3) for j in range(-1, 3)]
    made = landuse.cut(spark.createDataFrame(told, POLYGON), spark.createDataFrame(boxes, "box int, lat0 double, lon0 double, lat1 double, lon1 double"), "id")
    got = {(r["id"], r["box"]): r["area"] for r in landuse.degrees2(made, "id").collect() if abs(r["area"]) > 1e-12}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (1, 10): 1.0, (1, 11): 1.0, (2, 0): 1.0, (3, 0): 0.5, (3, 1): 0.375, (3, 10): 0.5, (3, 11): 0.5}


def test_lines_are_clipped(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 1.5), (2, 0.5, -1.0, 0.5, 5.0), (3, 9.0, 9.0, 9.5, 9.5), (4, 0.2, 0.2, 0.4, 0.3)], "id int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0), (8, 0.0, 1.0, 1.0, 2.0)], "box int, lat0 double, lon0 double, lat1 double, lon1 double")
    got = sorted(tuple(r) for r in landuse.clipped(lines, boxes, ("id",)).collect())
    assert got == [(1, 7, 0.0, 0.0, 1.0, 0.5), (1, 8, 1.0, 0.5, 2.0, 1.0), (2, 7, 0.5, 0.0, 0.5, 1.0), (4, 7, 0.2, 0.2, 0.4, 0.3)]
    assert landuse.widened(boxes).where("box = 7").first()["lat1"] == 1.02


def test_fields_stay_text(spark):
    fee = spark.createDataFrame([(1, "USFS", None, 5, "OA")], "key int, d_Mang_Name string, d_Mang_Type string, d_Des_Tp int, d_Pub_Access string")
    told = spark.createDataFrame([(2, "American Indian Lands", "Yakama"), (3, "American Indian Lands", None), (4, "State", "x"), (5, None, "y")], "key int, d_Mang_Type string, Unit_Nm string")
    assert sorted(tuple(r) for r in landuse.owners(fee, told).collect()) == [(1, "USFS", "", "5", "OA"), (2, "Tribal", "American Indian Lands", "Yakama", "Unknown"), (3, "Tribal", "American Indian Lands", "Reservation", "Unknown")]
    des = spark.createDataFrame([(1, "Wilderness Area", None), (2, "Park", "p"), (3, "Wilderness Study Area", "w")], "key int, d_Des_Tp string, Unit_Nm string")
    assert sorted(tuple(r) for r in landuse.wilderness(des).collect()) == [(1, "Wilderness Area", ""), (3, "Wilderness Study Area", "w")]
    mv = spark.createDataFrame([(1, 4, None, "a")], "key int, MVUM_SYMBO int, SEASONAL string, NAME string")
    assert sorted((r["symbol"], r["kind"], r["seasonal"], r["name"]) for r in landuse.motor_use(mv, mv).collect()) == [("4", "road", "", "a"), ("4", "trail", "", "a")]
