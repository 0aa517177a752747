"""Registered queries that take every row of their operator's input."""

import heapq

import pytest

from deltagrid import plans
from deltagrid.operators import layers

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key, step", [("w7_stations", "event_id", 3), ("r13_single_nodes", "node", 5), ("a22_boxes", "zip", 2), ("j16_t3_boxes_near", "zip", 2)])
def test_no_key_is_left_out(spark, name, key, step):
    keys = {r[key] % step for r in plans.QUERIES[name](spark, DIR).select(key).collect()}
    assert len(keys) == step


def test_least_costs_over_all_parts(spark):
    n = spark.read.parquet(f"{DIR}/part.parquet").agg({"p_partkey": "max"}).first()[0]
    best, queue = {1: 0.0}, [(0.0, 1)]
    while queue:
        g, at = heapq.heappop(queue)
        for k in (1, 3, 25, 200):
            cost = g + 1.0 + at * k % 7
            if at + k <= n and cost < best.get(at + k, 1e9):
                best[at + k] = cost
                heapq.heappush(queue, (cost, at + k))
    assert {r["node"]: r["cost"] for r in plans.QUERIES["r7_shortest"](spark, DIR).collect()} == best


def test_edges_of_both_halves_and_towards_all_neighbours(spark):
    index = lambda x, y, h: y * 512 + x * 2 + h
    t = spark.createDataFrame([(7, index(5, 5, 0), 200), (7, index(5, 5, 1), 127), (7, index(0, 0, 0), 128)], "prefix bigint, texel bigint, cov bigint")
    got = {r["texel"] for r in layers.selection_edge(t).collect()}
    assert got == {index(5, 5, 0), index(5, 5, 1), index(5, 4, 1), index(4, 5, 1), index(0, 0, 0), index(0, 0, 1)}


def test_outliers_lie_below_the_floor(spark):
    df = spark.createDataFrame([(c, -501.0 - k) for c in range(12) for k in range(c)] + [(99, -500.0), (98, None), (97, float("nan"))], "cell int, v double")
    got = [tuple(r) for r in layers.outliers(df, ["cell"], "v", -500.0).collect()]
    assert got == [(c, c, -500.0 - c) for c in range(11, 1, -1)]


def test_a_turn_looks_for_each_of_its_ends_once(spark):
    from pyspark.sql import functions as F

    from deltagrid.operators import ways

    chain = [(46.0, -122.0), (46.0, -121.999), (46.001, -121.999), (46.001, -122.0)]
    c = spark.createDataFrame([(chain, n) for n in range(4)], "chain array<struct<lat double, lon double>>, n int").withColumn("turn", ways.turn(F.col("chain"), F.col("n")))
    assert [r["turn"] for r in c.orderBy("n").collect()] == ["straight", "left", "left", "straight"]
    plan = c._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(sequence(") == 2


def test_nations_are_not_paired_supplier_by_part(spark, tmp_path):
    """Suppliers of one nation at few depths are that many depths, not a pair with each part."""
    n = 30_000
    spark.range(n).selectExpr("id AS s_suppkey", "CAST(3 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(n).selectExpr("id AS p_partkey", "CAST(3 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1000).selectExpr("id AS l_orderkey", "id % 500 * 100 AS l_partkey", "id AS l_suppkey", "CAST(1 AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = plans.QUERIES["a27_cached_bytes"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [s_nationkey" in plan
    assert df.collect()[0][:] == (499_500, sum(k for k in range(1000) if k % 500 * 100 < n))


def test_tasks_grow_with_the_rows(spark):
    from deltagrid.operators import terrain
    from deltagrid.operators.dealt import dealt

    assert dealt(spark.range(1000), 10, "id").rdd.getNumPartitions() == 100
    assert dealt(spark.range(1000), 10_000).rdd.getNumPartitions() == 4
    r = spark.range(600).selectExpr("CAST(id DIV 10000 AS INT) AS tile", "CAST(id AS INT) AS px", "CAST(255 + id % 2 AS INT) AS py", "CAST(id AS DOUBLE) AS v")
    a = terrain.around(r, [(0, 0), (-1, 0), (1, 1)])
    got = {(x["px"], x["py"]): x["n2"] for x in a.where("n0 IS NOT NULL").collect()}
    assert len(got) == 600 and got[255, 256] is None and got[254, 255] == 255.0 and got[256, 255] == 257.0
    # neighbours meet in one shuffle, by blocks, and not as rows of every pixel's own
    shuffles = [x for x in a._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in x]
    assert len(shuffles) == 1 and "bx#" in shuffles[0], shuffles
