"""Passes that are stopped, and two at a time."""

import pytest
from pyspark.sql import functions as F

from deltagrid.operators import passes
from deltagrid.plans import views

DIR = "/root/testdata/sf0.001"


def table(spark):
    return views.view(spark, DIR, "g_place").withColumn("region", F.concat(F.lit("r/"), (F.col("id") % 7).cast("string")))


def work(df):
    return df.groupBy("region", "kind").agg(F.count("*").alias("n"), F.sum("rank").alias("rank"))


def rows(df):
    return sorted(tuple(r[c] for c in ("region", "kind", "n", "rank")) for r in df.collect())


def test_a_pass_that_is_killed_goes_on(spark, tmp_path):
    t, path = table(spark), str(tmp_path / "pass")
    seen = []

    def dies(df):
        seen.append(sorted(r[0] for r in df.select("region").distinct().collect()))
        if len(seen) == 3:
            raise RuntimeError("killed")
        return work(df)

    schema = work(t).schema
    with pytest.raises(RuntimeError):
        passes.run(t, "region", dies, path, at_once=2)
    half = passes.result(spark, path, schema)
    assert {r["region"] for r in half.collect()} == {"r/0", "r/1", "r/2", "r/3"}
    again = []
    assert passes.run(t, "region", lambda df: (again.extend(r[0] for r in df.select("region").distinct().collect()), work(df))[1], path, at_once=2) == 3
    assert sorted(again) == ["r/4", "r/5", "r/6"] and rows(passes.result(spark, path, schema)) == rows(work(t))
    assert passes.run(t, "region", dies, path) == 0


def test_claimed_parts_are_left_alone_until_they_are_stale(spark, tmp_path):
    t, path = table(spark), str(tmp_path / "pass")
    log = passes.Log(spark, path)
    assert log.claim("r/3", 3600) and not log.claim("r/3", 3600)
    assert passes.run(t, "region", work, path) == 6 and "r/3" not in log.done()
    assert passes.run(t, "region", work, path, stale=-1) == 1
    assert rows(passes.result(spark, path, work(t).schema)) == rows(work(t))


def test_parts_without_rows_are_done_and_the_first_result_stands(spark, tmp_path):
    t, path = table(spark), str(tmp_path / "pass")
    assert passes.run(t, "region", lambda df: work(df).where("region <> 'r/5'"), path) == 7
    assert passes.run(t, "region", work, path) == 0
    assert {r["region"] for r in passes.result(spark, path, work(t).schema).collect()} == {f"r/{k}" for k in range(7) if k != 5}
    assert passes.result(spark, str(tmp_path / "none"), work(t).schema).count() == 0
    assert passes.run(t.limit(0), "region", work, path) == 0
