"""Queries of layers, samples, points and the rest of the line and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import classify as K
from ..operators import layers as Y
from ..operators import polygons as P
from ..operators import search as S
from . import views as V
from .cells import FIXES, GLOBE, globe
from .tables import RASTER, REFS, TEXELS, raster, refs, texels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CELLS = f"(SELECT DISTINCT {V.prefix_sql(8)} AS prefix FROM coded)"


def cells8(spark, sf):
    return globe(spark, sf).select(C.prefix(8).alias("prefix")).distinct()


@query(f"""WITH {GLOBE}, c AS {_CELLS}, r AS (SELECT DISTINCT 2 AS up, prefix >> 4 AS p, (prefix >> 4) % 100 AS value FROM c WHERE (prefix >> 4) % 3 = 0 UNION ALL SELECT DISTINCT 4, prefix >> 8, (prefix >> 8) % 100 FROM c WHERE (prefix >> 8) % 2 = 0),
j AS (SELECT c.prefix, up, value, row_number() OVER (PARTITION BY c.prefix ORDER BY up) AS n FROM c JOIN r ON p = c.prefix >> (2*up)) SELECT prefix, up, value FROM j WHERE n = 1""")
def j19_nearest_resident(spark, sf):
    c = cells8(spark, sf)
    at = lambda up, m: spark.range(10 << (2 * (8 - up))).where(f"id % {m} = 0").select(F.lit(up).alias("up"), F.col("id").alias("prefix"), (F.col("id") % 100).alias("value"))
    return Y.nearest_resident(c, at(2, 3).unionByName(at(4, 2)), 4)


@query(f"WITH {GLOBE}, c AS {_CELLS} SELECT prefix FROM c WHERE (prefix >> 4) % 3 <> 0 AND (prefix >> 8) % 2 <> 0")
def f13_without_absent(spark, sf):
    at = lambda up, m: spark.range(10 << (2 * (8 - up))).where(f"id % {m} = 0").select(F.lit(up).alias("up"), F.col("id").alias("prefix"))
    return Y.without_absent_ancestors(cells8(spark, sf), at(2, 3).unionByName(at(4, 2)), 4)


@query(f"""WITH {GLOBE}, p AS (SELECT {V.prefix_sql(5)} AS prefix, count(*) AS n FROM coded GROUP BY ALL), g AS (SELECT *, prefix >> 10 AS d, list_sum([((prefix & 1023) >> (2*i+1) & 1) << i for i in range(5)]) AS cu, list_sum([((prefix & 1023) >> (2*i) & 1) << i for i in range(5)]) AS cv FROM p)
SELECT a.prefix, a.n, w.n AS west, e.n AS east, s.n AS south, t.n AS north FROM g a LEFT JOIN g w ON w.d=a.d AND w.cu=a.cu-1 AND w.cv=a.cv LEFT JOIN g e ON e.d=a.d AND e.cu=a.cu+1 AND e.cv=a.cv LEFT JOIN g s ON s.d=a.d AND s.cu=a.cu AND s.cv=a.cv-1 LEFT JOIN g t ON t.d=a.d AND t.cu=a.cu AND t.cv=a.cv+1""")
def j8_apron(spark, sf):
    c = globe(spark, sf).groupBy(C.prefix(5).alias("prefix")).agg(F.count("*").alias("n"))
    return Y.apron(c, 5, "n")


@query(f"SELECT prefix, texel, l.value AS line, a.value AS land, w.value AS water FROM (SELECT prefix, texel, cov AS value FROM {TEXELS} WHERE class = 1) l FULL JOIN (SELECT prefix, texel, mag AS value FROM {TEXELS} WHERE seq % 2 = 0) a USING (prefix, texel) FULL JOIN (SELECT prefix, texel, uses AS value FROM {TEXELS} WHERE seq % 3 = 0) w USING (prefix, texel)")
def j20_u1_together(spark, sf):
    t = texels(spark, sf)
    part = lambda where, c: t.where(where).select("prefix", "texel", F.col(c).alias("value"))
    return Y.together({"line": part("class = 1", "cov"), "land": part("seq % 2 = 0", "mag"), "water": part("seq % 3 = 0", "uses")}, ["prefix", "texel"])


@query(f"WITH n AS (SELECT prefix, texel % 512 AS texel, class, count(*) AS n FROM {TEXELS} GROUP BY ALL) SELECT prefix, texel, m.c AS class, (m.n * 255 // 16)::BIGINT AS cov FROM (SELECT prefix, texel, max({{'n': n, 'c': class}}) AS m FROM n GROUP BY ALL)")
def a11_sampled_classes(spark, sf):
    return Y.sampled_classes(texels(spark, sf).select("prefix", (F.col("texel") % 512).alias("texel"), "class"))


_POINT = {"cx": "l_partkey % 40", "cy": "l_suppkey % 40", "z": "CAST(l_quantity AS DOUBLE)", "intensity": "l_partkey % 255", "return_number": "l_linenumber % 3", "class": "CASE l_returnflag WHEN 'A' THEN 2 ELSE 1 END"}
_LIDAR = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in _POINT.items())} FROM lineitem)"


@query(f"""WITH g AS (SELECT cx, cy, sum(intensity) FILTER (return_number=1) AS i, count(*) FILTER (return_number=1) AS n, max(z) FILTER (return_number=1) AS top, min(z) FILTER (class=2) AS ground FROM {_LIDAR} GROUP BY ALL)
SELECT a.cx, a.cy, (any_value(a.i) // any_value(a.n))::BIGINT AS intensity, any_value(a.n) AS n, any_value(a.top) AS top, CAST(least(greatest(floor(any_value(a.top) - min(b.ground)), 0), 255) AS BIGINT) AS canopy FROM g a LEFT JOIN g b ON b.cx BETWEEN a.cx-1 AND a.cx+1 AND b.cy BETWEEN a.cy-1 AND a.cy+1 AND b.ground IS NOT NULL WHERE a.n > 0 GROUP BY a.cx, a.cy""")
def a10_lidar(spark, sf):
    p = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in _POINT.items()))
    return Y.lidar_grid(p).withColumn("canopy", F.col("canopy").cast("bigint"))


@query("WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS k, count(*) OVER () AS n FROM part), q AS (SELECT max(CASE WHEN k = n // 100 THEN p_retailprice END) AS lo, max(CASE WHEN k = 99 * n // 100 THEN p_retailprice END) AS hi FROM r) SELECT p_partkey AS id, CAST(1 + floor(least(greatest((p_retailprice-lo)/greatest(hi-lo, 1), 0), 1)*254) AS BIGINT) AS byte FROM part, q")
def w9_stretched(spark, sf):
    return Y.stretched(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), "p_retailprice"), "p_retailprice").select("id", F.col("byte").cast("bigint").alias("byte"))


@query(f"SELECT kind, round(degrees(asin(z/sqrt(x*x+y*y+z*z))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM (SELECT kind, avg(cos(radians(lat))*cos(radians(lon))) AS x, avg(cos(radians(lat))*sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM {V.sql('g_place')} GROUP BY kind)")
def a23_centre(spark, sf):
    return Y.centre(V.view(spark, sf, "g_place"), "kind").select("kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH x AS (SELECT id, kind, log10(greatest(rank, 1)) AS x FROM {V.sql('g_place')}), b AS (SELECT *, min(x) OVER (PARTITION BY kind) AS lo, max(x) OVER (PARTITION BY kind) AS hi FROM x) SELECT id, CAST(CASE WHEN hi > lo THEN least(floor((x-lo)/(hi-lo)*5), 4) ELSE 0 END AS BIGINT) AS step FROM b")
def w10_rank_steps(spark, sf):
    return Y.rank_steps(V.view(spark, sf, "g_place"), "kind", "rank").select("id", F.col("step").cast("bigint").alias("step"))


@query(f"SELECT event_id, round(CASE WHEN v IS NOT NULL AND n IS NOT NULL THEN v + (n-v)*0.25 ELSE v END, 6) AS between FROM (SELECT event_id, v, lead(v) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN accuracy END AS v FROM {V.sql('g_fix')}))".replace("AS between", 'AS "between"'))
def w7_interpolated(spark, sf):
    f = V.view(spark, sf, "g_fix").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("accuracy")))
    return Y.interpolated(f, "user_id", "event_id", "v", F.lit(0.25)).select("event_id", F.round("between", 6).alias("between"))


@query(f"SELECT a.way AS way, b.way AS host FROM (SELECT way, arg_max(node, pos) AS last FROM {REFS} GROUP BY way) a JOIN (SELECT DISTINCT way, node FROM {REFS}) b ON a.last = b.node AND a.way <> b.way")
def j5_tributaries(spark, sf):
    r = refs(spark, sf)
    last = r.groupBy("way").agg(F.max_by("node", "pos").alias("node"))
    return last.join(r.select(F.col("way").alias("host"), "node").distinct(), "node").where("way <> host").select("way", "host")


@query(f"SELECT w.way, w.class FROM {V.sql('g_way')} w WHERE w.way IN (SELECT way FROM {REFS} WHERE node % 2 = 0)")
def j1_semi_join(spark, sf):
    return V.view(spark, sf, "g_way").join(refs(spark, sf).where("node % 2 = 0").select("way").distinct(), "way", "left_semi").select("way", "class")


@query(f"""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 98000 + c_custkey % 100 END AS zip, 46 + CAST(c_custkey*7 % 2000 AS DOUBLE)/2000 AS lat, -122 + CAST(c_custkey*11 % 2000 AS DOUBLE)/2000 AS lon FROM customer), j AS (SELECT p.id, a.id AS place, a.zip AS z, sqrt(pow((a.lon-p.lon)*cos(radians((p.lat+a.lat)/2)),2)+pow(a.lat-p.lat,2))*111320 AS m FROM p JOIN {V.sql('g_addr')} a ON p.zip IS NULL AND abs(a.lat-p.lat) < 0.02 AND abs(a.lon-p.lon) < 0.03),
b AS (SELECT id, arg_min(z, {{'m': round(m, 6), 'p': place}}) AS z FROM j WHERE m < 2000 GROUP BY id) SELECT p.id, coalesce(p.zip, b.z) AS zip FROM p LEFT JOIN b USING (id) WHERE coalesce(p.zip, b.z) IS NOT NULL""")
def j15_zip_or_nearest(spark, sf):
    p = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 98000 + c_custkey % 100 END AS zip", "46 + CAST(c_custkey*7 % 2000 AS DOUBLE)/2000 AS lat", "-122 + CAST(c_custkey*11 % 2000 AS DOUBLE)/2000 AS lon")
    a = V.view(spark, sf, "g_addr").select("id", "lat", "lon", "zip")
    near = S.nearest(p.where("zip IS NULL").drop("zip"), a, per_degree=30, bring=("zip",))
    return p.join(near.select("id", F.col("zip").alias("z")), "id", "left").select("id", F.coalesce("zip", "z").alias("zip")).where("zip IS NOT NULL")


@query(f"WITH {FIXES}, c AS (SELECT event_id, {V.prefix_sql(9)} AS p FROM coded) SELECT p AS prefix, count(*) AS fixes, count(DISTINCT event_id % 7) AS kinds FROM c GROUP BY p HAVING count(*) > 2")
def j12_points_in_cells(spark, sf):
    f = C.encode(V.view(spark, sf, "g_fix"))
    return f.groupBy(C.prefix(9).alias("prefix")).agg(F.count("*").alias("fixes"), F.count_distinct(F.col("event_id") % 7).alias("kinds")).where("fixes > 2")


@query(f"SELECT b.id, count(*) AS n, min(f.event_id) AS first FROM {V.sql('g_box')} b JOIN {V.sql('g_fix')} f ON f.lat BETWEEN b.lat0 AND b.lat1 AND f.lon BETWEEN b.lon0 AND b.lon1 GROUP BY b.id")
def f7_j13_points_in_boxes(spark, sf):
    b, f = V.view(spark, sf, "g_box"), V.view(spark, sf, "g_fix")
    square = lambda c: F.floor(F.col(c) * 4).cast("int")
    dealt = b.withColumn("_y", F.explode(F.sequence(square("lat0"), square("lat1")))).withColumn("_x", F.explode(F.sequence(square("lon0"), square("lon1"))))
    j = f.withColumns({"_y": square("lat"), "_x": square("lon")}).join(dealt, ["_y", "_x"]).where("lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1")
    return j.groupBy("id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"""WITH t AS (SELECT CAST(x AS INT) AS tx, CAST(y AS INT) AS ty, CAST(h AS INT) AS half FROM range(80) a(x), range(80) b(y), range(2) c(h)), b AS (SELECT id, lon0*20 + 2460 AS x0, lat0*20 - 918 AS y0, lon1*20 + 2460 AS x1, lat1*20 - 918 AS y1 FROM {V.sql('g_box')}) SELECT id, tx, ty, half FROM b JOIN t ON ty + (half+1)/3.0::DOUBLE >= y0 AND ty + (half+1)/3.0::DOUBLE < y1 AND tx + (half+1)/3.0::DOUBLE >= x0 AND tx + (half+1)/3.0::DOUBLE < x1""")
def g7_fill(spark, sf):
    b = V.view(spark, sf, "g_box").selectExpr("id", "lon0*20 + 2460 AS a0", "lat0*20 - 918 AS b0", "lon1*20 + 2460 AS a1", "lat1*20 - 918 AS b1")
    corners = [("a0", "b0"), ("a1", "b0"), ("a1", "b1"), ("a0", "b1")]
    edges = F.array(*[F.struct(F.col(p[0]).alias("x0"), F.col(p[1]).alias("y0"), F.col(q[0]).alias("x1"), F.col(q[1]).alias("y1")) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)])
    return P.fill(b.select("id", F.explode(edges).alias("e")).select("id", "e.*")).where("tx BETWEEN 0 AND 79 AND ty BETWEEN 0 AND 79")


@query(f"SELECT tile, CAST(px // 2 AS INT) AS px, CAST(py // 2 AS INT) AS py, round(avg(v), 6) AS v FROM {RASTER} GROUP BY ALL")
def a12_a13_box_filter(spark, sf):
    return raster(spark, sf).groupBy("tile", F.floor(F.col("px") / 2).cast("int").alias("px"), F.floor(F.col("py") / 2).cast("int").alias("py")).agg(F.round(F.avg("v"), 6).alias("v"))


@query(f"SELECT class, max(mag) AS top, min(mag) AS low FROM {TEXELS} WHERE cov > 20 GROUP BY class")
def a26_ceiling(spark, sf):
    return texels(spark, sf).where("cov > 20").groupBy("class").agg(F.max("mag").alias("top"), F.min("mag").alias("low"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 64 WHEN p_size % 4 = 1 THEN 68 WHEN p_size % 4 = 2 THEN 90 END AS kind, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 12345 ELSE 100000 END WHEN p_size % 4 = 1 THEN 109800 WHEN p_size % 4 = 2 THEN 1338 END AS rank FROM part WHERE p_size % 4 < 3")
def p7_point_kind(spark, sf):
    keys = {"place": "CASE WHEN p_size % 4 = 0 THEN 'city' END", "natural": "CASE WHEN p_size % 4 = 1 THEN 'peak' END", "man_made": "CASE WHEN p_size % 4 = 2 THEN 'tower' END", "tower:type": "CASE WHEN p_size % 4 = 2 THEN 'fire_lookout' END", "population": "CASE WHEN p_partkey % 2 = 0 THEN '12,345' END", "ele": "CASE WHEN p_size % 4 = 1 THEN '4392' ELSE '4392 ft' END"}
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", *(f"{e} AS `{k}`" for k, e in keys.items()))
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("v")) for k in keys]), lambda e: e["v"].isNotNull()))
    return p.select("id", K.point_kind(tags).alias("p")).where("p.kind IS NOT NULL").select("id", "p.kind", "p.rank")


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 95 WHEN 1 THEN 96 WHEN 2 THEN 101 WHEN 3 THEN 111 WHEN 4 THEN 100 END AS kind FROM part")
def p6_business(spark, sf):
    keys = {"amenity": "CASE p_partkey % 6 WHEN 0 THEN 'cafe' WHEN 1 THEN 'restaurant' WHEN 3 THEN 'spa' WHEN 5 THEN 'bench' END", "shop": "CASE p_partkey % 6 WHEN 0 THEN 'bakery' WHEN 2 THEN 'shoes' WHEN 4 THEN 'deli' END"}
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", *(f"{e} AS `{k}`" for k, e in keys.items()))
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("v")) for k in keys]), lambda e: e["v"].isNotNull()))
    return p.select("id", K.business(tags).alias("kind"))


@query("SELECT o_orderkey AS id, CAST(regexp_extract(t, '([NS])(\\d+)', 2) AS INT) * CASE regexp_extract(t, '([NS])(\\d+)', 1) WHEN 'S' THEN -1 ELSE 1 END AS lat, CAST(regexp_extract(t, '([WE])(\\d+)', 2) AS INT) * CASE regexp_extract(t, '([WE])(\\d+)', 1) WHEN 'W' THEN -1 ELSE 1 END AS lon FROM (SELECT o_orderkey, concat('Tile_', CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END, lpad(CAST(o_orderkey % 80 AS VARCHAR), 2, '0'), '_', CASE WHEN o_orderkey % 3 = 0 THEN 'W' ELSE 'E' END, lpad(CAST(o_orderkey % 180 AS VARCHAR), 3, '0')) AS t FROM orders)")
def s16_tile_names(spark, sf):
    from ..sources.names import square

    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    name = F.concat(F.lit("Tile_"), F.when(F.col("id") % 2 == 0, "N").otherwise("S"), F.lpad((F.col("id") % 80).cast("string"), 2, "0"), F.lit("_"), F.when(F.col("id") % 3 == 0, "W").otherwise("E"), F.lpad((F.col("id") % 180).cast("string"), 3, "0"))
    lat, lon = square(name)
    return o.select("id", lat.alias("lat"), lon.alias("lon"))


@query(f"SELECT node, count(*) AS n FROM (SELECT DISTINCT way, node FROM {REFS}) GROUP BY node HAVING count(*) = 1")
def r13_single_nodes(spark, sf):
    return refs(spark, sf).select("way", "node").distinct().groupBy("node").agg(F.count("*").alias("n")).where("n = 1")


@query(f"SELECT event_id, round(lat0 + (lat1-lat0)*k/4, 6) AS lat, CAST(k AS INT) AS station FROM (SELECT event_id, lat AS lat0, lead(lat) OVER (PARTITION BY user_id ORDER BY event_id) AS lat1 FROM {V.sql('g_fix')}), range(5) r(k) WHERE lat1 IS NOT NULL")
def w7_stations(spark, sf):
    from pyspark.sql import Window

    f = V.view(spark, sf, "g_fix").select("event_id", "lat", F.lead("lat").over(Window.partitionBy("user_id").orderBy("event_id")).alias("lat1")).where("lat1 IS NOT NULL")
    return f.withColumn("station", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("event_id", F.round(F.col("lat") + (F.col("lat1") - F.col("lat")) * F.col("station") / 4, 6).alias("lat"), "station")


@query(f"""WITH i AS (SELECT prefix, texel, texel >> 9 AS y, texel >> 1 & 255 AS x, texel & 1 AS h FROM {TEXELS} WHERE cov >= 50), n AS (SELECT prefix, texel, x + CASE WHEN h = 0 THEN -dx ELSE dx END AS x, y + CASE WHEN h = 0 THEN -dy ELSE dy END AS y, 1 - h AS h FROM i, (VALUES (0, 0), (1, 0), (0, 1)) d(dx, dy)), c AS (SELECT * FROM n WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 255 AND NOT EXISTS (SELECT 1 FROM i WHERE i.prefix = n.prefix AND i.x = n.x AND i.y = n.y AND i.h = n.h))
SELECT prefix, texel FROM c UNION SELECT prefix, y * 512 + x * 2 + h FROM c""")
def f16_edges(spark, sf):
    return Y.selection_edge(texels(spark, sf), 50)


@query(f"""WITH t AS (SELECT prefix, texel, class, texel >> 9 AS y, texel >> 1 & 255 AS x, texel & 1 AS h FROM {TEXELS} WHERE class <> 0), n AS (SELECT prefix, texel, class, x + CASE WHEN h = 0 THEN -dx ELSE dx END AS x, y + CASE WHEN h = 0 THEN -dy ELSE dy END AS y, 1 - h AS h FROM t, (VALUES (0, 0), (1, 0), (0, 1)) d(dx, dy))
SELECT DISTINCT n.prefix, n.texel FROM n LEFT JOIN t ON t.prefix = n.prefix AND t.x = n.x AND t.y = n.y AND t.h = n.h WHERE n.x BETWEEN 0 AND 255 AND n.y BETWEEN 0 AND 255 AND coalesce(t.class, 0) <> n.class""")
def v7_class_edges(spark, sf):
    return Y.class_edge(texels(spark, sf))


@query(f"SELECT tile, CAST(px // 4 AS INT) AS px, CAST(py // 4 AS INT) AS py, count(*) AS n, min(v) AS lowest FROM {RASTER} WHERE v < 200 GROUP BY ALL ORDER BY n DESC, tile, px, py LIMIT 10")
def f12_outliers(spark, sf):
    r = raster(spark, sf).select("tile", F.floor(F.col("px") / 4).cast("int").alias("px"), F.floor(F.col("py") / 4).cast("int").alias("py"), "v")
    return Y.outliers(r, ["tile", "px", "py"], "v", 200.0)
