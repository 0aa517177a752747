"""Expected values of single functions."""

import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from deltagrid.functions import cells as C
from deltagrid.functions import measure as M
from deltagrid.functions import text as T
from deltagrid.operators import graph, lines
from deltagrid.plans import views


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_round_trip_is_within_two_centimetres(spark):
    lat = spark.range(62).select((F.col("id") * 2.9 - 89.5).alias("lat"))
    lon = spark.range(98).select((F.col("id") * 3.7 - 180).alias("lon"))
    p = C.decode(C.encode(lat.crossJoin(lon)), "lat2", "lon2")
    assert p.select(F.max(M.haversine_km(*map(F.col, ("lat", "lon", "lat2", "lon2")))) * 1000).first()[0] < 0.02


def test_all_diamonds_and_poles(spark):
    lat = spark.range(19).select((F.col("id") * 10.0 - 90).alias("lat"))
    lon = spark.range(36).select((F.col("id") * 10.0 - 180).alias("lon"))
    assert C.encode(lat.crossJoin(lon)).select("diamond").distinct().count() == 10
    poles = C.encode(spark.createDataFrame([(90.0, 0.0), (-90.0, 0.0), (None, 0.0)], "lat double, lon double")).collect()
    assert [r["diamond"] for r in poles] == [0, 5, None]


@pytest.mark.parametrize(("text", "kmh"), [("50", 50), ("35 mph", 56), ("none", 0), ("80;60", 80), ("", 0)])
def test_speed(spark, text, kmh):
    assert one(spark, T.speed_kmh(F.lit(text))) == kmh


@pytest.mark.parametrize(("text", "normal", "base"), [("North 9th Street", "N 9TH ST", "9TH"), ("N. 9th St.", "N 9TH ST", "9TH"), ("Talon Trail", "TALON TRL", "TALON"), ("North Bend Way", "N BEND WAY", "BEND"), ("Southeast Sedgwick Road", "SE SEDGWICK RD", "SEDGWICK"), ("Way", "WAY", "WAY"), ("", "", "")])
def test_street(spark, text, normal, base):
    assert one(spark, T.street_normal(F.lit(text))) == normal
    assert one(spark, T.street_base(F.lit(text))) == base


@pytest.mark.parametrize(("text", "expected"), [("647 Talon Trail, 59912", (647, "Talon Trail", 59912)), ("647 Talon Ln Columbia Falls MT 59912-1234", (647, "Talon Ln Columbia Falls MT", 59912)), ("12B 9th St", (12, "9th St", None)), ("Snow Lake", None), ("47.4455, -121.4235", None), ("98366", None)])
def test_typed_address(spark, text, expected):
    found = one(spark, T.typed_address(F.lit(text)))
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize(("query", "text", "expected"), [("harper", "Harper", 0), ("harp", "Harper", 1), ("colby", "South Colby", 2), ("olby", "South Colby", 3), ("seattle", "Harper", None), ("", "Harper", None)])
def test_fit(spark, query, text, expected):
    assert one(spark, T.fit(F.lit(query), F.lit(text))) == expected


@pytest.mark.parametrize(("lat", "lon", "east", "north"), [(47.5404, -122.6363, 527370.459, 5265283.737), (46.2024, -121.4909, 616425.756, 5117642.733)])
def test_utm(spark, lat, lon, east, north):
    e, n = M.utm(F.lit(lat), F.lit(lon), F.lit(10))
    assert abs(one(spark, e) - east) < 0.01 and abs(one(spark, n) - north) < 0.01


def test_sun_is_a_little_west_of_south(spark):
    azimuth, altitude = M.sun(F.lit(46.2), F.lit(-122.18), F.lit(1791316800))  # 2026-10-06 20:00 UTC
    assert 180 < one(spark, azimuth) < 200 and abs(one(spark, altitude) - 38) < 1.5


def test_quantum_truncates_and_marks_none(spark):
    assert one(spark, M.quantize_elevation(F.lit(0.74))) == 22001
    assert one(spark, M.quantize_elevation(F.lit(None).cast("double"))) == 65535


def test_upstream_refuses_cycles(spark):
    own = spark.createDataFrame([(1, 1.0), (2, 1.0)], "way bigint, km double")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    with pytest.raises(ValueError):
        lines.upstream(edges, own, graph.cut, most=4).count()


@pytest.mark.parametrize("m, expected", [(4.9, "0 m"), (95, "100 m"), (99, "100 m"), (124, "100 m"), (130, "150 m"), (999, "1000 m"), (1000, "1.0 km"), (1150, "1.1 km"), (1250, "1.2 km"), (1350, "1.4 km"), (1750, "1.8 km"), (12_340, "12.3 km"), (1_234_560, "1234.6 km")])
def test_lengths(spark, m, expected):
    assert one(spark, T.rounded_length(F.lit(float(m)))) == expected


@pytest.mark.parametrize("s, expected", [(0, "0 min"), (89, "1 min"), (90, "2 min"), (3600, "1 h 00 min"), (3900, "1 h 05 min"), (90_000, "25 h 00 min")])
def test_durations(spark, s, expected):
    assert one(spark, T.duration(F.lit(float(s)))) == expected


@pytest.mark.parametrize("text, expected", [("0.2.7", (0, 2, 7)), ("0.216.1+457980b", (0, 216, 1)), ("1.2", None), ("1.2.3.4", None), ("v1.2.3", None), ("", None), ("1.2.x", None)])
def test_versions(spark, text, expected):
    got = one(spark, T.version(F.lit(text)))
    assert (got if got is None else tuple(got)) == expected


@pytest.mark.parametrize("kind, name, reference, expected", [(68, "Baker", "8611", "Baker"), (68, "", "8611", "8611"), (77, "Seneca St", "165A", "165A Seneca St"), (77, "", "2", "2"), (3, "Oak", "SR 20", "Oak (SR 20)"), (3, "SR 20 North", "SR 20", "SR 20 North"), (3, "", "", "")])
def test_labels(spark, kind, name, reference, expected):
    assert one(spark, T.label(F.lit(kind), F.lit(name), F.lit(reference))) == expected


def test_places_on_edges_fall_as_the_sql_says(spark):
    """Places of sf0.1 x 60 where the last bit of a sine or of a sum decides on the cell."""
    places = [(-52.12, -180.0), (-76.3, -36.0), (72.0, 90.0), (-67.84, -36.0), (-14.060000000000002, -118.5), (6.8700000000000045, 77.43), (-54.49, 86.57)]
    expected = duckdb.sql(f"WITH {views.coded('(VALUES ' + ', '.join(f'({a!r}::DOUBLE, {o!r}::DOUBLE)' for a, o in places) + ') p(lat, lon)')} SELECT lat, lon, diamond, u, v FROM coded").fetchall()
    got = C.encode(spark.createDataFrame(places, "lat double, lon double")).select("lat", "lon", "diamond", "u", "v").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_least_costs_over_long_paths(spark):
    """A path of 3,000 edges through 12 blocks, in fewer rounds than it has edges, with ways back and islands."""
    n = spark.range(3000)
    edges = n.selectExpr("id AS src", "id + 1 AS dst", "1D AS cost").unionByName(n.selectExpr("id AS src", "id - 700 AS dst", "2D AS cost")).unionByName(spark.range(9000, 9010).selectExpr("id AS src", "id + 1 AS dst", "1D AS cost"))
    starts = spark.createDataFrame([(1500, 0.0), (1500, 5.0)], "node bigint, cost double")
    got = {r["node"]: r["cost"] for r in graph.shortest(edges, starts, most=40, block_edges=500).collect()}
    best, queue = {1500: 0.0}, [(0.0, 1500)]
    while queue:
        g, at = heapq.heappop(queue)
        for to, c in ((at + 1, 1.0), (at - 700, 2.0)) if 0 <= at < 3000 else ():
            if g + c < best.get(to, 1e9):
                best[to] = g + c
                heapq.heappush(queue, (g + c, to))
    assert got == best
    near = {r["node"]: r["cost"] for r in graph.shortest(edges, starts, most=40, target=F.col("node") == 2100, block_edges=500).collect()}
    assert near[2100] == 600


def test_triangle_codes_level_by_level(spark):
    """Codes against a walk down the 29 levels, and read again; the expressions stay small, as 29 copies of a step do not fit one compiled method."""
    rng = random.Random(7)
    places = [(rng.randrange(10), rng.randrange(1 << 30), rng.randrange(1 << 30)) for _ in range(300)]
    edges = (0, 1, 2, (1 << 29) - 1, 1 << 29, (1 << 30) - 2, (1 << 30) - 1)
    places += [(d, u, v) for d in (0, 9) for u in edges for v in edges]

    def walk(d, u, v):
        half = lambda k: ((u & ((1 << k) - 1)) + (v & ((1 << k) - 1))) >> k
        code = d << 1 | half(30)
        for k in range(29, 0, -1):
            a, b = u >> k & 1, v >> k & 1
            code = code << 2 | (2 * a + b if a != b else 3 * (half(k) ^ half(k + 1)))
        return code - (1 << 64) if code >> 63 else code

    df = spark.createDataFrame(places, "diamond int, u bigint, v bigint").withColumn("code", C.triangle_code())
    rows = df.withColumn("p", C.from_triangle_code(F.col("code"))).collect()
    assert [r["code"] for r in rows] == [walk(*p) for p in places]
    assert all((r["p"]["diamond"], r["p"]["u"] >> 1, r["p"]["v"] >> 1) == (r["diamond"], r["u"] >> 1, r["v"] >> 1) for r in rows)
    assert all((r["p"]["u"] & 1) == (r["p"]["v"] & 1) for r in rows)
    assert len(str(C.triangle_code())) < 2000
