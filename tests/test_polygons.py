"""Rings and typed places."""

from pyspark.sql import functions as F

from deltagrid.functions.place import typed_place
from deltagrid.operators import polygons


def test_rings(spark):
    rows = [(1, 0, [1, 2, 3]), (1, 1, [4, 3]), (1, 2, [4, 1]), (2, 0, [7, 8]), (2, 1, [9, 8])]
    got = polygons.rings(spark.createDataFrame(rows, "rel bigint, idx int, refs array<bigint>")).collect()
    assert [(r["rel"], r["refs"]) for r in got] == [(1, [1, 2, 3, 4, 1])]


def test_clip(spark):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, square), (2, [(9.0, 9.0), (9.0, 10.0), (10.0, 9.0)]), (3, None)], f"id int, ring {polygons.RING}")
    got = {r["id"]: [(p["lat"], p["lon"]) for p in r["ring"]] for r in polygons.clipped(df, "ring", (1.0, 1.0, 3.0, 3.0)).collect()}
    assert got[2] == got[3] == [] and set(got[1]) == {(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)} and got[1][0] == got[1][-1]


def test_fill_is_even_odd_at_centroids(spark):
    outer, hole = [(2.2, 3.1), (40.5, 5.0), (35.0, 44.4), (5.0, 30.0)], [(15.0, 15.0), (25.0, 16.0), (20.0, 25.0)]
    edges = [(1, *a, *b) for ring in (outer, hole) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {tuple(r) for r in polygons.fill(spark.createDataFrame(edges, "id int, x0 double, y0 double, x1 double, y1 double")).select("tx", "ty", "half").collect()}

    def inside(x, y):
        return sum((y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for _, x0, y0, x1, y1 in edges) % 2 == 1

    want = {(x, y, h) for x in range(50) for y in range(50) for h in (0, 1) if inside(x + (h + 1) / 3, y + (h + 1) / 3)}
    assert got == want


# Spellings of one place, and texts that are none or others.
SPELLINGS = [
    "47.4455, -121.4235", "47.4455 -121.4235", "47.4455/-121.4235", "N47.4455 W121.4235", "N 47.4455, W 121.4235", "47.4455N 121.4235W", "47.4455N, 121.4235W", "47.4455 N, 121.4235 W",
    "W121.4235 N47.4455", "W121.4235, N47.4455", "121.4235 W 47.4455 N", "47°26′43.8″ N  121°25′24.6″ W", "47°26'43.8\"N 121°25'24.6\"W", "N47°26'43.8\" W121°25'24.6\"", "47d26m43.8s n 121d25m24.6s w", "47 26 43.8 N 121 25 24.6 W",
    "47 26 43.8 N, 121 25 24.6 W", "47 26 43.8, -121 25 24.6", "47 26 43.8 -121 25 24.6", "47°26.73' N 121°25.41' W", "47 26.73 N 121 25.41 W", "-47.4455 S 121.4235 W", "47.4455° N, 121.4235° W", "  47.4455 ,  -121.4235  ",
    "47 26m 43.8s N 121 25m 24.6s W", "47 26 43.8sN 121 25 24.6sW", "47deg26min43.8sec N 121deg25min24.6sec W", "north 47.4455 west 121.4235", "47.4455 north; 121.4235 west", "+47.4455 -121.4235",
]
OTHERS = {"N23.6, W48.14": (23.6, -48.14), "s23.6 e48.14": (-23.6, 48.14), "1.5 30 N 2 E": (2.0, 2.0), "47 26 43.8 121 25 24.6": (47 + 26 / 60 + 43.8 / 3600, 121 + 25 / 60 + 24.6 / 3600), "-.5 .5": (-0.5, 0.5), "90 -180": (90.0, -180.0)}
NONE = [None, "", "  ", "Snow Lake", "47.4455", "91 0", "91, 0", "0 181", "12", "47 61 0 N 121 0 0 W", "47 61 N, 121 W", "12 34 56 78 90", "1.2.3 4", "47? 121", "1,2,3", ",", "n s", "5 -6 7 8"]


def test_typed_places(spark):
    told = [(t, 47.4455, -121.4235) for t in SPELLINGS] + [(t, *p) for t, p in OTHERS.items()]
    df = spark.createDataFrame([*told, *((t, None, None) for t in NONE)], "t string, lat double, lon double").select("*", typed_place(F.col("t")).alias("p"))
    for r in df.collect():
        if r["lat"] is None:
            assert r["p"] is None, r
        else:
            assert r["p"] and abs(r["p"]["lat"] - r["lat"]) < 1e-4 and abs(r["p"]["lon"] - r["lon"]) < 1e-4, r
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
