"""Stores, routes and captures: nulls, empty tables, rows of no length, documents written and read again."""

from pyspark.sql import functions as F

from deltagrid.operators import capture, routes, store
from deltagrid.sources import tables


def test_fetches_tell_absent_from_failed(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 5, 6)], "key int")
    cache = spark.createDataFrame([(1, None), (2, b"b")], "key int, payload binary")
    missing = spark.createDataFrame([(2,), (3,), (3,)], "key int")
    answers = spark.createDataFrame([(2, "changed", b"n"), (3, "changed", b"n"), (4, "gone", None), (5, "changed", b"e")], "key int, status string, payload binary")
    got = {r["key"]: (r["status"], r["payload"], r["check"]) for r in store.fetched(keys, cache, missing, answers).collect()}
    assert got == {1: ("bytes", None, True), 2: ("bytes", bytearray(b"b"), True), 3: ("absent", None, False), 4: ("absent", None, False), 5: ("bytes", bytearray(b"e"), False), 6: ("failed", None, False)}
    assert store.fetched(keys.limit(0), cache, missing, answers).count() == 0


def test_layers_replace_planes_also_by_nothing(spark):
    image = "struct<red:int,green:int,blue:int,nir:int>"
    base = spark.createDataFrame([(1, 5.0, (1, 1, 1, 9)), (2, 6.0, None)], f"prefix int, dem double, img {image}")
    dem = spark.createDataFrame([(1, None), (3, 7.0)], "prefix int, dem double")
    none = spark.createDataFrame([], f"prefix int, img {image}")
    nir = spark.createDataFrame([(1, (0, 0, 0, 4)), (2, (3, 0, 0, 8))], f"prefix int, img {image}")
    got = {r["prefix"]: (r["dem"], tuple(r["img"]) if r["img"] else None) for r in store.layered(base, dem, none, nir).collect()}
    assert got == {1: (None, (1, 1, 1, 4)), 2: (6.0, (3, 0, 0, 8)), 3: (7.0, None)}


def test_quantised_planes_hold_their_values_within_half_a_step(spark):
    t = spark.createDataFrame([(1, k, float(k * k)) for k in range(300)] + [(1, 300, None), (2, 0, None)], "prefix int, texel int, v double")
    q = store.quantised(t, "v")
    assert q.where("v IS NOT NULL AND abs(base + q * step - v) > step * 0.5 + 1e-9").count() == 0
    assert q.where("v IS NULL AND q IS NOT NULL").count() == 0 and q.count() == 302
    code = spark.range(1).select(*(store.apron_code(F.lit(x).cast("double"), F.lit(0.0), F.lit(0.5)).alias(n) for n, x in (("low", -3.0), ("high", 1e9), ("none", None))))
    assert tuple(code.first()) == (0, 65534, 65535)


def test_quantiser_steps_halve_to_one(spark):
    steps = spark.range(1, 9).select(store.tapered(F.lit(20), F.col("id")).alias("s"))
    assert [r["s"] for r in steps.collect()] == [1, 1, 1, 1, 2, 5, 10, 20]
    d = spark.createDataFrame([(d,) for d in (-7, -2, -1, 0, 1, 2, 7)], "d int").select(store.dead_zone(F.col("d"), F.lit(3)).alias("q"))
    assert [r["q"] for r in d.collect()] == [-2, -1, 0, 0, 0, 1, 2]


def test_steps_fold_short_ones_and_places_along_lines_of_no_length(spark):
    chain = spark.createDataFrame([(1, 1, "A", 10.0), (1, 2, "B", 10.0), (1, 3, "A", 10.0), (1, 4, None, 100.0), (1, 5, "", 300.0), (2, 1, None, 0.0)], "route int, n int, name string, metres double")
    assert sorted((r["route"], r["n"], r["name"]) for r in routes.steps(chain).collect()) == [(1, 1, "A"), (1, 4, ""), (2, 1, "")]
    points = spark.createDataFrame([(1, 1, 10.0, 20.0), (1, 2, 10.0, 20.0), (2, 1, 0.0, 0.0), (2, 2, 0.0, 1.0)], "way int, pos int, lat double, lon double")
    marks = spark.createDataFrame([(7, 1, 0.5, 10.0), (8, 2, 0.25, 111.32)], "id int, way int, t double, side double")
    got = {r["id"]: (round(r["lat"], 9), round(r["lon"], 9)) for r in routes.place_at(points, marks).collect()}
    assert got == {7: (10.0, 20.0), 8: (0.001, 0.25)}


def test_profiles_of_chains_of_no_length_and_ferries(spark):
    chain = spark.createDataFrame([(1, 1, 0.0, 5.0, False), (2, 1, 1.0, 5.0, False), (2, 2, 9.0, -80.0, True)], "route int, n int, metres double, elev double, ferry boolean")
    got = sorted((r["route"], r["sample"], r["elev"]) for r in routes.profile(chain, 3).collect())
    assert got == [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 5.0), (2, 0, 5.0), (2, 1, 5.0), (2, 2, 0.0)]


def test_clusters_touch_over_corners(spark):
    index = lambda x, y, h: (y * 256 + x) * 2 + h
    nodes = spark.createDataFrame([(1, index(0, 0, 0)), (1, index(1, 1, 1)), (1, index(2, 0, 0)), (1, index(255, 0, 0)), (2, index(0, 1, 0)), (1, index(1, 1, 1))], "prefix bigint, texel bigint")
    got = {(r["prefix"], r["texel"]): r["cluster"] for r in routes.clusters(nodes).collect()}
    assert got == {(1, 0): 0, (1, index(1, 1, 1)): 0, (1, index(2, 0, 0)): 0, (1, index(255, 0, 0)): index(255, 0, 0), (2, index(0, 1, 0)): index(0, 1, 0)}
    assert routes.clusters(nodes.limit(0)).count() == 0


def test_area_documents_drop_the_record_of_the_device_when_shared(spark):
    areas = spark.createDataFrame([(1, "a", 5, 30, 9, 100), (2, "b", 6, 9, None, None)], "area int, name string, created bigint, depth int, fetched bigint, bytes bigint")
    cells = spark.createDataFrame([(1, 3, 17, b"\x01\x02"), (1, 0, 9, b"")], "area int, depth int, prefix bigint, cov binary")
    assert "fetched" in capture.documents(areas, cells, share=False).columns
    shared = capture.documents(areas, cells, share=True)
    assert not {"fetched", "bytes"} & set(shared.columns) and shared.count() == 2
    got = sorted((r["area"], r["depth"], r["cell_depth"], r["prefix"], bytes(r["cov"])) for r in capture.from_documents(shared).collect())
    assert got == [(1, 14, 0, 9, b""), (1, 14, 3, 17, b"\x01\x02")]


def test_sun_is_followed_in_steps(spark):
    s = spark.createDataFrame([([(0.0, 0.0), (0.04, 0.0), (0.06, 0.0), (0.06, 0.2), (None, 0.2), (0.06, 0.2)],), ([],)], "s array<struct<az:double,alt:double>>")
    got = [[tuple(x) for x in r["t"]] for r in s.select(capture.followed(F.col("s")).alias("t")).collect()]
    assert got == [[(0.0, 0.0), (0.06, 0.0), (0.06, 0.2), (None, 0.2), (0.06, 0.2)], []]


def test_layer_tables_prune_by_depth_merge_into_versions_and_publish_changes(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "depth int, prefix bigint, texel bigint, class int, cov int")
    tables.write_layer(rows((3, 1, 0, 1, 10), (3, 1, 1, 2, 20), (4, 9, 0, 3, 30)), root, "line")
    one = tables.read_layer(spark, root, "line", 3)
    assert one.count() == 2 and "depth" in one.columns
    assert "PartitionFilters: [isnotnull(depth" in one._jdf.queryExecution().toString()
    name = tables.merge_layer(rows((3, 1, 1, 7, 5), (3, 2, 0, 8, 6), (4, 9, 0, 9, 0)), root, "line", ["class", "cov"])
    merged = {(r["depth"], r["prefix"], r["texel"]): (r["class"], r["cov"]) for r in tables.read_layer(spark, root, name).collect()}
    assert name == "line@1" and merged == {(3, 1, 0): (1, 10), (3, 1, 1): (7, 5), (3, 2, 0): (8, 6), (4, 9, 0): (3, 30)}
    assert tables.read_layer(spark, root, "line").count() == 3
    tables.publish(tables.read_layer(spark, root, name), tables.read_layer(spark, root, "line"), ["depth", "prefix", "texel"], f"{root}/out")
    assert sorted((r["prefix"], r["texel"]) for r in spark.read.parquet(f"{root}/out").collect()) == [(1, 1), (2, 0)]


def test_recorded_chunks_of_unequal_columns_give_nothing(spark):
    from deltagrid.streaming import tracks

    kinds = "track int, chunk int, coord array<bigint>, ms array<bigint>, height array<int>, accuracy array<int>, vaccuracy array<int>, speed array<int>, bearing array<int>"
    full = ([5, 6], [1, 2], [-(2**31), 250], [100, 200], [65535, 50], [65535, 100], [65535, 9000])
    rows = [(1, 0, *full), (1, 1, *full[:5], [1], full[6]), (1, 2, None, *full[1:]), (1, 3, *full[:6], None), (1, 4, *[[]] * 7)]
    got = [tuple(r) for r in tracks.recorded(spark.createDataFrame(rows, kinds), "track").orderBy("n").collect()]
    assert got == [(1, 0, 0, 5, 1, None, 1.0, None, None, None), (1, 0, 1, 6, 2, 2.5, 2.0, 0.5, 1.0, 90.0)]
