"""Queries of cell stores: layers, fetches, edits, indexes, censuses, quantised planes, views, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import merge as U
from ..operators import store as S
from . import views as V
from .cells import GLOBE, globe
from .tables import _HEIGHT, RASTER, TEXELS, UP, raster, texels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def orders(spark, sf, *columns: str):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*columns)


# ---- documents


@query("""WITH b AS (SELECT o_orderkey AS p, o_custkey AS dem, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 255 END AS red, o_custkey % 7 AS nir, o_orderpriority AS land FROM orders WHERE o_orderstatus <> 'F'), d AS (SELECT o_orderkey AS p, CASE WHEN o_custkey % 5 > 0 THEN o_custkey + 1 END AS dem FROM orders WHERE o_orderstatus <> 'O'),
i AS (SELECT o_orderkey AS p, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 200 END AS red, o_custkey % 11 AS nir FROM orders WHERE substr(o_orderpriority, 1, 1) < '3'), n AS (SELECT o_orderkey AS p, o_custkey % 100 AS red, o_custkey % 13 AS nir FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('2', '4')),
a AS (SELECT coalesce(b.p, d.p, i.p, n.p) AS prefix, CASE WHEN d.p IS NOT NULL THEN d.dem ELSE b.dem END AS dem, CASE WHEN i.p IS NOT NULL THEN i.red ELSE b.red END AS red, CASE WHEN i.p IS NOT NULL THEN i.nir ELSE b.nir END AS nir, n.p AS np, n.red AS nr, n.nir AS nn, land FROM b FULL JOIN d ON b.p = d.p FULL JOIN i ON i.p = coalesce(b.p, d.p) FULL JOIN n ON n.p = coalesce(b.p, d.p, i.p))
SELECT prefix, dem, CASE WHEN red IS NOT NULL THEN red WHEN np IS NOT NULL THEN nr END AS red, CASE WHEN np IS NOT NULL THEN nn WHEN red IS NOT NULL THEN nir END AS nir, land FROM a""")
def s19_layered(spark, sf):
    image = lambda red, nir: f"CASE WHEN {red} IS NOT NULL THEN named_struct('red', {red}, 'green', {red}, 'blue', {red}, 'nir', {nir}) END AS img"
    o = spark.read.parquet(f"{sf}/orders.parquet")
    b = o.where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS prefix", "o_custkey AS dem", image("CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 255 END", "o_custkey % 7"), "o_orderpriority AS land")
    d = o.where("o_orderstatus <> 'O'").selectExpr("o_orderkey AS prefix", "CASE WHEN o_custkey % 5 > 0 THEN o_custkey + 1 END AS dem")
    i = o.where("substr(o_orderpriority, 1, 1) < '3'").selectExpr("o_orderkey AS prefix", image("CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 200 END", "o_custkey % 11"))
    n = o.where("substr(o_orderpriority, 1, 1) IN ('2', '4')").selectExpr("o_orderkey AS prefix", image("o_custkey % 100", "o_custkey % 13"))
    return S.layered(b, d, i, n).select("prefix", "dem", "img.red", "img.nir", "land")


_CACHE, _MISSING = "o_orderstatus = 'O'", "o_orderstatus = 'P'"
_STATUS = "CASE o_orderkey % 4 WHEN 0 THEN 'changed' WHEN 1 THEN 'gone' WHEN 2 THEN 'failed' ELSE 'same' END"


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey * 2 % 9000 + 1 AS key FROM lineitem), o AS (SELECT o_orderkey AS key, {_CACHE} AS held, {_MISSING} AS lost, CASE WHEN o_orderpriority <> '1-URGENT' THEN {_STATUS} END AS s, o_custkey FROM orders)
SELECT k.key, CASE WHEN held THEN 'bytes' WHEN lost THEN 'absent' WHEN s = 'changed' THEN 'bytes' WHEN s = 'gone' THEN 'absent' ELSE 'failed' END AS status, CASE WHEN held THEN o_custkey WHEN lost THEN NULL WHEN s = 'changed' THEN o_custkey + 1 END AS payload, CAST(coalesce(held, false) AS INT) AS "check" FROM k LEFT JOIN o USING (key)""")
def s20_fetched(spark, sf):
    keys = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey * 2 % 9000 + 1 AS key")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    answers = o.where("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey AS key", f"{_STATUS} AS status", "o_custkey + 1 AS payload")
    f = S.fetched(keys, o.where(_CACHE).selectExpr("o_orderkey AS key", "o_custkey AS payload"), o.where(_MISSING).selectExpr("o_orderkey AS key"), answers)
    return f.withColumn("check", F.col("check").cast("int"))


@query(f"SELECT o_orderkey AS key, CASE WHEN s = 'changed' THEN o_custkey + 1 ELSE o_custkey END AS payload, CASE WHEN s = 'changed' THEN 'new' ELSE 'old' END AS tag FROM (SELECT *, {_STATUS} AS s FROM orders) WHERE {_CACHE} OR s = 'changed'")
def m8_revalidated(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return S.revalidated(o.where(_CACHE).selectExpr("o_orderkey AS key", "o_custkey AS payload", "'old' AS tag"), o.selectExpr("o_orderkey AS key", f"{_STATUS} AS status", "o_custkey + 1 AS payload", "'new' AS tag"))


_INDEX = {"layer": "CASE l_linenumber % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'dem' ELSE 'img' END", "depth": "l_suppkey % 9", "prefix": "l_partkey", "bytes": "CAST(l_quantity AS BIGINT)"}


def index(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*(f"{e} AS {c}" for c, e in _INDEX.items()))


_INDEXED = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in _INDEX.items())} FROM lineitem)"


@query(f"SELECT DISTINCT depth, prefix FROM {_INDEXED} WHERE layer = 'dem'")
def s21_held_keys(spark, sf):
    return S.held_keys(index(spark, sf), "dem")


@query(f"SELECT sum(bytes)::BIGINT AS cached, sum(bytes) FILTER ((depth, prefix) IN (SELECT (s_suppkey % 9, p_partkey) FROM supplier, part WHERE s_nationkey = p_size % 25))::BIGINT AS pinned FROM {_INDEXED}")
def a27_cached_bytes(spark, sf):
    s, p = spark.read.parquet(f"{sf}/supplier.parquet"), spark.read.parquet(f"{sf}/part.parquet")
    # the nations' depths once each: suppliers and parts of one nation in pairs would grow with the square of the tables
    deep = s.select("s_nationkey", (F.col("s_suppkey") % 9).alias("depth")).distinct()
    pinned = deep.join(p, F.col("s_nationkey") == F.col("p_size") % 25).select("depth", F.col("p_partkey").alias("prefix"))
    return S.cached_bytes(index(spark, sf), pinned)


@query("""WITH e AS (SELECT o_orderkey % 7 AS k, length(o_orderpriority) AS n FROM orders) SELECT CASE k WHEN 0 THEN 'unreadable' WHEN 1 THEN 'zstd' WHEN 2 THEN 'etag' WHEN 3 THEN 'raw' WHEN 4 THEN 'document' WHEN 5 THEN 'dem+names' ELSE 'raw' END AS kind, count(*) AS n, coalesce(sum(CASE k WHEN 1 THEN n + 4 WHEN 2 THEN n + 2 WHEN 6 THEN n + 82 WHEN 0 THEN NULL ELSE n END), 0)::BIGINT AS bytes FROM e GROUP BY ALL""")
def a24_census(spark, sf):
    e = orders(spark, sf, "o_orderkey % 7 AS k", "o_orderpriority AS t")
    data = F.when(F.col("k") == 1, F.concat(F.lit(b"\x28\xb5\x2f\xfd"), F.encode("t", "UTF-8"))).when(F.col("k") == 2, F.encode(F.concat(F.lit('"'), "t", F.lit('"')), "UTF-8")).when(F.col("k") == 6, F.encode(F.concat(F.lit('"'), "t", F.repeat(F.lit("x"), 80), F.lit('"')), "UTF-8")).when(F.col("k") > 0, F.encode("t", "UTF-8"))
    names = F.when(F.col("k") == 5, F.array(F.lit("names"), F.lit("dem"), F.lit("names"))).when(F.col("k") == 4, F.array().cast("array<string>"))
    return S.census(e.select(data.alias("data"), names.alias("sections")))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_custkey % 4 = 0 THEN NULLIF(o_custkey % 8, 0) ELSE o_custkey END AS a, CASE WHEN o_custkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS b FROM orders")
def k2_edited(spark, sf):
    o = orders(spark, sf, "o_orderkey AS id", "o_orderstatus AS status", "o_custkey AS a", "o_orderpriority AS b")
    e = o.where("a % 4 = 0").selectExpr("id", "nullif(a % 8, 0) AS a", "'new' AS b")
    return S.edited(o, e.unionByName(e.selectExpr("-id - 1 AS id", "a", "b")), ["id"], ["a", "b"])


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS dem, o_orderstatus AS line, o_orderpriority AS names FROM orders WHERE o_custkey % 10 > 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 5 > 0 THEN o_custkey END AS dem, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS line, o_orderpriority AS names FROM orders WHERE o_custkey % 10 <> 1),
j AS (SELECT id, concat_ws('+', CASE WHEN a.dem IS DISTINCT FROM b.dem THEN 'dem' END, CASE WHEN a.line IS DISTINCT FROM b.line THEN 'line' END, CASE WHEN a.names IS DISTINCT FROM b.names THEN 'names' END) AS planes FROM a FULL JOIN b USING (id)) SELECT * FROM j WHERE planes <> ''""")
def k5_differing(spark, sf):
    o = orders(spark, sf, "o_orderkey AS id", "o_custkey AS c", "o_orderstatus AS line", "o_orderpriority AS names")
    a = o.where("c % 10 > 0").selectExpr("id", "CASE WHEN c % 3 > 0 THEN c END AS dem", "line", "names")
    b = o.where("c % 10 <> 1").selectExpr("id", "CASE WHEN c % 3 > 0 AND id % 5 > 0 THEN c END AS dem", "CASE WHEN id % 7 = 0 THEN 'X' ELSE line END AS line", "names")
    return S.differing(a, b, ["id"], ["dem", "line", "names"]).select("id", F.array_join("planes", "+").alias("planes"))


@query("WITH d AS (SELECT 98000 + o_custkey % 70 AS zip, min(o_custkey) AS lat0, max(o_custkey) AS lat1 FROM orders GROUP BY ALL) SELECT * FROM d UNION ALL SELECT 98000 + c_custkey, c_nationkey, c_nationkey + 1 FROM customer WHERE 98000 + c_custkey NOT IN (SELECT zip FROM d)")
def k6_zip_index(spark, sf):
    d = orders(spark, sf, "98000 + o_custkey % 70 AS zip", "o_custkey").groupBy("zip").agg(F.min("o_custkey").alias("lat0"), F.max("o_custkey").alias("lat1"))
    old = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("98000 + c_custkey AS zip", "c_nationkey AS lat0", "c_nationkey + 1 AS lat1")
    return S.reindexed(old, d, "zip")


@query("SELECT n_nationkey AS region, c AS part FROM nation, range(8) r(c) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 8 = c AND c_acctbal > 9000)")
def k11_pending(spark, sf):
    all_of = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("region"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("part"))
    done = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 9000").selectExpr("c_nationkey AS region", "c_custkey % 8 AS part")
    return S.pending(all_of, done, ["region", "part"])


_QUANT = f"(SELECT prefix, texel, CASE WHEN mag % 9 > 0 THEN mag * 7.25e0 * (prefix % 64 * prefix % 97) END AS elev FROM {TEXELS})"


@query(f"""WITH t AS {_QUANT}, g AS (SELECT prefix, coalesce(min(elev), 0) AS base, greatest(coalesce(max(elev) - min(elev), 0)/32000, 0.05e0) AS step FROM t GROUP BY prefix)
SELECT prefix, texel, base, round(step, 9) AS step, round((elev - base)/step)::BIGINT AS q, CASE WHEN elev IS NULL THEN 65535 ELSE least(greatest(round((elev - 5 - base)/0.05e0), 0), 65534) END::BIGINT AS apron FROM t JOIN g USING (prefix)""")
def z6_k10_quantised(spark, sf):
    t = texels(spark, sf).selectExpr("prefix", "texel", "CASE WHEN mag % 9 > 0 THEN mag * CAST(7.25 AS DOUBLE) * (prefix % 64 * prefix % 97) END AS elev")
    q = S.quantised(t, "elev")
    return q.select("prefix", "texel", "base", F.round("step", 9).alias("step"), "q", S.apron_code(F.col("elev") - 5, F.col("base"), F.lit(0.05)).cast("bigint").alias("apron"))


_FULL = "(SELECT 3 AS depth, 8 + t // 131072 AS prefix, t % 131072 AS texel, t * 7919 % 1013 - 500 AS v FROM range(524288) r(t))"


@query(f"SELECT depth - 1 AS depth, pp AS prefix, pt AS texel, (sum(v)::BIGINT + 2) >> 2 AS v FROM {UP.replace(TEXELS, _FULL)} GROUP BY ALL")
def z1_rounded_means(spark, sf):
    return S.rounded_means(spark.range(4 << 17).selectExpr("3 AS depth", "8 + id DIV 131072 AS prefix", "id % 131072 AS texel", "id * 7919 % 1013 - 500 AS v"), "v")


@query("SELECT p_partkey AS id, l AS level, s AS step, CASE WHEN s = 1 THEN d ELSE sign(d)*((abs(d) + s // 3) // s) END::BIGINT AS q FROM (SELECT p_partkey, l, p_partkey * 31 % 401 - 200 AS d, greatest(p_size // (1 << (8 - l)), 1)::BIGINT AS s FROM part, (SELECT CAST(x AS INT) AS l FROM range(1, 9) r(x)))")
def z2_quantiser(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), "p_size", (F.col("p_partkey") * 31 % 401 - 200).alias("d")).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(8))))
    p = p.withColumn("step", S.tapered(F.col("p_size"), F.col("level")))
    return p.select("id", "level", "step", S.dead_zone(F.col("d"), F.col("step")).alias("q"))


# ---- selections


@query(f"SELECT DISTINCT n_nationkey AS region, user_id AS way FROM {V.sql('g_fix')} JOIN nation ON CAST(floor(lat) AS INT) = 45 + n_nationkey % 3 AND CAST(floor(lon) AS INT) IN (-123 + n_nationkey % 2, -122 + n_nationkey % 2)")
def j23_regions(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("region"), (45 + F.col("n_nationkey") % 3).alias("lat"), F.explode(F.array(-123 + F.col("n_nationkey") % 2, -122 + F.col("n_nationkey") % 2)).alias("lon"))
    return S.in_regions(V.view(spark, sf, "g_fix").selectExpr("user_id AS way", "lat", "lon"), n)


_TILES = "(VALUES (0, 3, true, 47e0, -123e0, 64, 64), (1, 1, true, 48e0, -123e0, 64, 64), (2, 0, false, 47.5e0, -122.5e0, 64, 64)) t(tile, seq, named, north, west, width, height)"


@query(f"""WITH r AS (SELECT tile, px, py, {_HEIGHT} AS v FROM {RASTER} t0(tile, px, py, old)), j AS (SELECT id, seq, named, tile, CAST(floor((lon - west)/0.015625e0) AS INT) AS px, CAST(floor((north - lat)/0.015625e0) AS INT) AS py FROM {V.sql('g_place')} JOIN {_TILES} ON lat > north - 1.1 AND lat <= north AND lon >= west AND lon < west + 1.1)
SELECT id, v AS value FROM j JOIN r USING (tile, px, py) WHERE v <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY NOT named, seq) = 1""")
def j11_first_lit(spark, sf):
    t = spark.createDataFrame([(0, 3, True, 47.0, -123.0), (1, 1, True, 48.0, -123.0), (2, 0, False, 47.5, -122.5)], "tile int, seq int, named boolean, north double, west double")
    t = t.withColumns({"step": F.lit(0.015625), "width": F.lit(64), "height": F.lit(64)})
    return S.first_lit(V.view(spark, sf, "g_place").select("id", "lat", "lon"), t, raster(spark, sf).withColumnRenamed("v", "value"))


@query(f"SELECT id, kind, name FROM {V.sql('g_place')} WHERE lower(name) LIKE '%build%' OR lower(reference) LIKE '%build%'")
def x19_grep(spark, sf):
    return S.grep(V.view(spark, sf, "g_place").withColumn("depth", F.lit(14)), "BUILD", 14).select("id", "kind", "name")


@query(f"""WITH {GLOBE}, f AS (SELECT DISTINCT {V.prefix_sql(7)} AS p FROM coded), a AS (SELECT DISTINCT 7 - k AS depth, p >> (2*k) AS prefix FROM f, range(6) r(k)),
g AS (SELECT *, prefix >> (2*depth) AS dia, list_sum([((prefix >> (2*i+1)) & 1) << i for i in range(depth)]) AS gu, list_sum([((prefix >> (2*i)) & 1) << i for i in range(depth)]) AS gv FROM a WHERE depth <= 4), n AS (SELECT depth, dia, gu + i AS gu, gv + j AS gv FROM g, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j) WHERE gu + i BETWEEN 0 AND (1 << depth) - 1 AND gv + j BETWEEN 0 AND (1 << depth) - 1)
SELECT CAST(depth AS INT) AS depth, prefix FROM a UNION SELECT CAST(depth AS INT), CAST((dia << (2*depth)) | ({V.spread('gu')} << 1) | {V.spread('gv')} AS BIGINT) FROM n""")
def v8_wanted_cells(spark, sf):
    return S.wanted(globe(spark, sf).select(C.prefix(7).alias("prefix")).distinct(), 7, 2, 4)


_STOPS = [(0.0, (20, 120, 60)), (300.0, (180, 200, 90)), (1500.0, (150, 110, 70)), (3000.0, (250, 250, 250))]
_PAIRS = ", ".join(f"({a[0]}::DOUBLE, {b[0]}::DOUBLE, {', '.join(f'{x}::DOUBLE, {y}::DOUBLE' for x, y in zip(a[1], b[1], strict=True))})" for a, b in zip(_STOPS, _STOPS[1:], strict=False))


@query(f"""WITH e AS (SELECT p_partkey AS id, p_partkey * 37 % 4000 - 400e0 AS h FROM part), r(e0, e1, r0, r1, g0, g1, b0, b1) AS (VALUES {_PAIRS}), j AS (SELECT *, least(greatest((h-e0)/(e1-e0), 0), 1) AS t FROM e LEFT JOIN r ON h < e1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY e1) = 1)
SELECT id, coalesce(trunc(r0+(r1-r0)*t), 250)::BIGINT AS red, coalesce(trunc(g0+(g1-g0)*t), 250)::BIGINT AS green, coalesce(trunc(b0+(b1-b0)*t), 250)::BIGINT AS blue FROM j""")
def v5_tints(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 4000 - 400).cast("double").alias("h"))
    return p.select("id", S.ramp(F.col("h"), _STOPS).alias("c")).select("id", *(F.col(f"c.{x}").cast("bigint").alias(x) for x in ("red", "green", "blue")))


_PAST = """c AS (SELECT p, p >> 2 AS dia, (p >> 1) & 1 AS gu, p & 1 AS gv FROM (SELECT DISTINCT s_suppkey % 40 AS p FROM supplier)), a AS (SELECT p, dia, side, half, k, (gu + (CASE side WHEN 0 THEN -1 WHEN 1 THEN 256 ELSE k END + (half+1)/3e0)/256)/2 AS cu, (gv + (CASE side WHEN 2 THEN -1 WHEN 3 THEN 256 ELSE k END + (half+1)/3e0)/256)/2 AS cv FROM c, range(4) s(side), range(2) h(half), range(256) t(k))"""


@query(f"WITH {_PAST}, s AS (SELECT p AS prefix, dia AS diamond, side, half, k, cu, cv FROM a), {V.locate_sql('s', 'cu', 'cv')}, z AS (SELECT prefix, side, half, k, lat2 AS lat, lon2 AS lon FROM placed), y AS (WITH {V.coded('z')} SELECT * FROM coded) SELECT prefix, CAST(side AS INT) AS side, CAST(half AS INT) AS half, CAST(k AS INT) AS \"at\", {V.prefix_sql(1)} AS near, {V.texel_sql(1)} AS texel FROM y")
def j9_apron_places(spark, sf):
    return S.apron_places(spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") % 40).alias("prefix")).distinct(), 1)


# ---- unions


@query("SELECT 'line' AS kind, o_orderkey AS id, o_orderpriority AS name, CAST(NULL AS INT) AS rank FROM orders UNION ALL SELECT 'point', c_custkey, c_name, CAST(c_nationkey AS INT) FROM customer")
def u2_kinds(spark, sf):
    lines = orders(spark, sf, "'line' AS kind", "o_orderkey AS id", "o_orderpriority AS name")
    return lines.unionByName(spark.read.parquet(f"{sf}/customer.parquet").selectExpr("'point' AS kind", "c_custkey AS id", "c_name AS name", "CAST(c_nationkey AS INT) AS rank"), allowMissingColumns=True)


@query(f"""WITH n AS (SELECT depth, prefix, texel, class, CASE WHEN seq % 3 = 0 THEN cov ELSE 0 END AS cov FROM {TEXELS}), o AS (SELECT depth, prefix, texel, class + 1 AS class, cov + 1 AS cov FROM {TEXELS}) SELECT depth, prefix, texel, CASE WHEN n.cov > 0 THEN n.class ELSE o.class END AS class, CASE WHEN n.cov > 0 THEN n.cov ELSE o.cov END AS cov FROM n FULL JOIN o USING (depth, prefix, texel)""")
def u12_folded(spark, sf):
    t = texels(spark, sf)
    new = t.select("depth", "prefix", "texel", "class", F.when(F.col("seq") % 3 == 0, F.col("cov")).otherwise(0).alias("cov"))
    old = t.select("depth", "prefix", "texel", (F.col("class") + 1).alias("class"), (F.col("cov") + 1).alias("cov"))
    return U.over(new, old, ["class", "cov"])
