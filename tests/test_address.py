"""Addresses in ZIP tables, and following a route."""

import pytest

from deltagrid.functions import text as T
from deltagrid.operators import address
from deltagrid.streaming import routes


@pytest.fixture(scope="module")
def tables(spark):
    from pyspark.sql import functions as F

    names = spark.createDataFrame([(1, 59912, "Talon Trail"), (2, 59912, "Talon Lane"), (3, 59912, "North Bend Way"), (4, 98366, "Talon Trail")], "street int, zip int, name string")
    streets = names.select("street", "zip", T.street_normal(F.col("name")).alias("normal"), T.street_base(F.col("name")).alias("base"))
    points = spark.createDataFrame([(1, 647, 48.0, -114.0)], "street int, number int, lat double, lon double")
    ranges = spark.createDataFrame([(1, 1, 600, 698, 2, "right", 48.0, -114.0, 48.1, -114.0), (3, 1, 1, 99, 1, "left", 47.0, -121.0, 47.0, -120.9), (4, 1, 10, 20, 3, "left", 46.0, -120.0, 46.1, -120.0)], "street int, seq int, first int, last int, parity int, side string, lat0 double, lon0 double, lat1 double, lon1 double")
    return streets, points, ranges, spark.createDataFrame([(98366, 1), (59912, 2)], "zip int, seq int")


def test_geocode(spark, tables):
    typed = ["647 Talon Trl, 59912", "650 Talon Trail 59912", "650 Talon Road 59912", "49 North Bend Way, Fall City 59912", "100 North Bend Way 59912", "15 Talon Trail", "Snow Lake", None, ""]
    df = spark.createDataFrame(list(enumerate(typed)), "id int, text string")
    got = {(r["id"], r["place"]): r for r in address.geocode(df, *tables).collect()}
    assert (got[0, 1]["score"], got[0, 1]["street"], got[0, 1]["lat"]) == (0, 1, 48.0)
    assert got[1, 1]["score"] == 1 and abs(got[1, 1]["lat"] - (48 + 0.1 * 50 / 98)) < 1e-9 and got[1, 1]["lon"] > -114.0
    assert got[2, 1]["score"] == 3 and got[2, 1]["street"] == 1
    assert got[3, 1]["score"] == 1 and got[3, 1]["street"] == 3 and got[3, 1]["lat"] > 47.0
    assert got[4, 1]["score"] == 4 and got[4, 1]["lon"] == -120.9
    assert got[5, 1]["street"] == 4
    assert {i for i, _ in got} == {0, 1, 2, 3, 4, 5}


FIXES = [(1, 0.0, None, 5.0, None), (1, 3.0, None, 5.0, "route"), (1, 10.0, 20.0, 5.0, None), (1, 12.0, 60.0, 5.0, None), (1, 14.0, 70.0, 5.0, "error"), (1, 20.0, 50.0, 80.0, None), (1, 21.0, 90.0, 80.0, None), (2, 0.0, None, 5.0, None), (2, 6.0, None, 5.0, "error"), (2, 29.0, None, 5.0, None), (2, 31.0, None, 5.0, None)]
ASKED = [(1, 0.0), (1, 12.0), (1, 21.0), (2, 0.0), (2, 31.0)]
SCHEMA = "track bigint, t double, off_m double, accuracy double, answer string"


def test_route_is_asked_for(spark):
    assert sorted(tuple(r) for r in routes.asks(spark.createDataFrame(FIXES, SCHEMA)).collect()) == ASKED


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame(FIXES, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "f"))
    q = routes.stream_asks(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "f"))).writeStream.outputMode("append").format("memory").queryName("asked").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("asked").collect()) == ASKED


def test_without_zips_near_nothing_is_found(spark, tables):
    streets, points, ranges, near = tables
    typed = spark.createDataFrame([(1, "647 Talon Trail"), (2, "647 Talon Trail 59912")], "id int, text string")
    got = {r["id"] for r in address.geocode(typed, streets, points, ranges, near.limit(0)).collect()}
    assert got == {2}
