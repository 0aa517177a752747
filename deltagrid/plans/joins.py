"""Queries of relations, routes over cells, progress, heights, holes, links and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import fields as D
from ..operators import ways as W
from . import views as V
from .cells import GLOBE, globe
from .tables import POINTS, TEXELS, points, texels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""WITH r AS (SELECT c_custkey AS rel, unnest([c_custkey * 3 % 900, c_custkey * 7, 999999999, c_custkey * 3 % 900 + 1]) AS way, generate_subscripts([1, 2, 3, 4], 1) - 1 AS idx FROM customer) SELECT rel, CAST(idx AS INT) AS idx, way, n FROM r JOIN (SELECT o_orderkey AS way, o_orderkey % 5 + 1 AS n FROM orders) USING (way)""")
def j4_members(spark, sf):
    k = F.col("c_custkey")
    rel = table(spark, sf, "customer").select(k.alias("rel"), F.array(k * 3 % 900, k * 7, F.lit(999999999).cast("bigint"), k * 3 % 900 + 1).alias("members"))
    ways = table(spark, sf, "orders").select(F.col("o_orderkey").alias("way"), F.sequence(F.lit(1).cast("bigint"), F.col("o_orderkey") % 5 + 1).alias("refs"))
    return W.members(rel, ways).select("rel", "idx", "way", F.size("refs").cast("bigint").alias("n"))


@query(f"""WITH p AS (SELECT way, pos, lat, lon, lat BETWEEN 46.19 AND 46.71 AND lon BETWEEN -121.81 AND -121.19 AS i FROM {POINTS}), q AS (SELECT *, coalesce(lag(i) OVER w, false) AS b, coalesce(lead(i) OVER w, false) AS a FROM p WINDOW w AS (PARTITION BY way ORDER BY pos)),
g AS (SELECT *, coalesce(sum(CASE WHEN NOT i AND NOT a THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM q) SELECT way, run, pos FROM g WHERE i OR a OR b QUALIFY count(*) OVER (PARTITION BY way, run) >= 2""")
def f5_clipped_lines(spark, sf):
    return W.clipped_runs(points(spark, sf), (46.2, -121.8, 46.7, -121.2)).select("way", "run", "pos")


_CROW = "sqrt(pow(({b}lon-{a}lon)*cos(radians(({a}lat+{b}lat)/2)),2)+pow({b}lat-{a}lat,2))*111320"


@query(f"""WITH p AS (SELECT way, pos, 46 + lat/100 - 0.46 AS lat, lon/100 - 120 AS lon, max(pos) OVER (PARTITION BY way) AS last FROM {POINTS}),
n AS (SELECT h.way, h.pos, h.lat, h.lon, coalesce(max(o.pos) FILTER (o.pos <= h.pos AND {_CROW.format(a='o.', b='h.')} >= 30), 1) AS b, coalesce(min(o.pos) FILTER (o.pos >= h.pos AND {_CROW.format(a='o.', b='h.')} >= 30), max(h.last)) AS a FROM p h JOIN p o USING (way) GROUP BY h.way, h.pos, h.lat, h.lon),
t AS (SELECT n.way, n.pos, (n.lon-x.lon)*cos(radians(n.lat)) AS ax, n.lat-x.lat AS ay, (y.lon-n.lon)*cos(radians(n.lat)) AS bx, y.lat-n.lat AS by_ FROM n JOIN p x ON x.way = n.way AND x.pos = n.b JOIN p y ON y.way = n.way AND y.pos = n.a)
SELECT way, pos, CASE WHEN degrees(atan2(ax*by_-ay*bx + 0.0, ax*bx+ay*by_ + 0.0)) > 30 THEN 'left' WHEN degrees(atan2(ax*by_-ay*bx + 0.0, ax*bx+ay*by_ + 0.0)) < -30 THEN 'right' ELSE 'straight' END AS turn FROM t""")
def w8_turns(spark, sf):
    p = points(spark, sf).select("way", "pos", F.struct((46 + F.col("lat") / 100 - 0.46).alias("lat"), (F.col("lon") / 100 - 120).alias("lon")).alias("p"))
    c = p.groupBy("way").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("chain"))
    c = c.withColumn("n", F.explode(F.sequence(F.lit(0), F.size("chain") - 1)))
    return c.select("way", (F.col("n") + 1).cast("bigint").alias("pos"), W.turn(F.col("chain"), F.col("n")).alias("turn"))


@query(f"""WITH w AS (SELECT DISTINCT prefix, texel, seq % 3 AS way, prefix >> 28 AS d, list_sum([((prefix >> (2*i+1)) & 1) << i for i in range(14)])*256 + ((texel >> 1) & 255) AS x, list_sum([((prefix >> (2*i)) & 1) << i for i in range(14)])*256 + (texel >> 9) AS y FROM (SELECT prefix, (texel >> 9) * 512 + ((texel >> 1) % 2 * 255) * 2 + texel % 2 AS texel, seq FROM {TEXELS}))
SELECT a.prefix, a.texel, a.way, b.prefix AS prefix2, b.texel AS texel2 FROM w a JOIN w b ON a.way = b.way AND a.d = b.d AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.prefix <> b.prefix""")
def j22_over_cell_edges(spark, sf):
    t = F.col("texel")
    w = texels(spark, sf).select("prefix", (F.shiftright(t, 9) * 512 + F.shiftright(t, 1) % 2 * 255 * 2 + t % 2).alias("texel"), (F.col("seq") % 3).alias("way")).distinct()
    return W.over_edges(w, 14)


@query(f"""WITH w AS (SELECT way % 50 AS parent, way % 4 AS q, row_number() OVER (PARTITION BY way % 50, way % 4 ORDER BY way) AS n, way % 77 AS osm, class FROM {V.sql('g_way')}), k AS (SELECT * FROM w WHERE CASE class WHEN 1 THEN 8 WHEN 3 THEN 8 WHEN 5 THEN 10 WHEN 7 THEN 13 WHEN 9 THEN 11 END <= 11),
f AS (SELECT parent, osm, min(q * 1000000 + n) AS spot FROM k GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY spot) AS num FROM f) SELECT parent, q, n, CAST(num AS INT) AS num FROM k JOIN m USING (parent, osm)""")
def j25_parent_ways(spark, sf):
    from pyspark.sql import Window

    w = V.view(spark, sf, "g_way")
    w = w.select((F.col("way") % 50).alias("parent"), (F.col("way") % 4).alias("q"), F.row_number().over(Window.partitionBy(F.col("way") % 50, F.col("way") % 4).orderBy("way")).cast("bigint").alias("n"), (F.col("way") % 77).alias("osm"), "class")
    return W.parent_numbers(w, 11)


@query(f"""WITH f AS (SELECT event_id, user_id % 10 AS route, (event_id * 37 % 1000) * 1e0 AS at_m FROM {V.sql('g_fix')}), s AS (SELECT r AS route, k AS step, (k * 130 + r * 17) * 1e0 AS step_m FROM range(10) a(r), range(6) b(k)),
j AS (SELECT f.*, (600 + f.route * 30) * 1e0 AS metres, (90 + f.route) * 1e0 AS seconds FROM f) SELECT event_id, route, at_m, greatest(metres - at_m, 0) AS left_m, seconds * greatest(metres - at_m, 0) / metres AS left_s, (SELECT min(step) FROM s WHERE s.route = j.route AND step_m > at_m) AS step, (SELECT min(step_m) FROM s WHERE s.route = j.route AND step_m > at_m) - at_m AS ahead_m FROM j""")
def m4_progress(spark, sf):
    f = V.view(spark, sf, "g_fix").select("event_id", (F.col("user_id") % 10).alias("route"), (F.col("event_id") * 37 % 1000).cast("double").alias("at_m"))
    r = spark.range(10).select(F.col("id").alias("route"), (600 + F.col("id") * 30).cast("double").alias("metres"), (90 + F.col("id")).cast("double").alias("seconds"))
    s = spark.range(10).select(F.col("id").alias("route"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("step")).withColumn("step_m", (F.col("step") * 130 + F.col("route") * 17).cast("double"))
    return W.progress(f, r, s)


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN accuracy WHEN (CAST(floor(lat) AS INT) + CAST(floor(lon) AS INT)) % 2 <> 0 THEN 0 END AS elev FROM (SELECT event_id, accuracy, lat + event_id % 5 AS lat, lon + event_id % 7 AS lon FROM {V.sql('g_fix')})")
def g18_elevation_or_sea(spark, sf):
    f = V.view(spark, sf, "g_fix").select("event_id", (F.col("lat") + F.col("event_id") % 5).alias("lat"), (F.col("lon") + F.col("event_id") % 7).alias("lon"), F.when(F.col("event_id") % 3 == 0, F.col("accuracy")).alias("elev"))
    sq = spark.range(-90, 90).select(F.col("id").cast("int").alias("lat"), F.explode(F.sequence(F.lit(-180), F.lit(179))).alias("lon")).where((F.col("lat") + F.col("lon")) % 2 == 0)
    return D.elevation_or_sea(f, sq).select("event_id", "elev")


@query(f"WITH {GLOBE}, g AS (SELECT DISTINCT {V.prefix_sql(2)} AS prefix, {V.texel_sql(2)} AS texel FROM coded), m AS (SELECT *, CAST(least(greatest(round((texel % 20011 - 10005)/10e0*100/10), -32767), 32767) AS INT) AS cm FROM g WHERE texel % 4 > 0) SELECT c.id, c.orderkey, round(c.id % 1000 - cm/100e0, 6) AS above FROM (SELECT id, orderkey, {V.prefix_sql(2)} AS prefix, {V.texel_sql(2)} AS texel FROM coded) c LEFT JOIN m USING (prefix, texel)")
def g22_sea_level(spark, sf):
    t = globe(spark, sf).select(C.prefix(2).alias("prefix"), C.texel(2).alias("texel")).distinct().where("texel % 4 > 0")
    geoid = t.withColumn("cm", D.centimetres((F.col("texel") % 20011 - 10005) / 100))
    f = V.view(spark, sf, "g_globe").select("id", "orderkey", "lat", "lon", (F.col("id") % 1000).cast("double").alias("height_m"))
    return D.sea_level_heights(f, geoid).select("id", "orderkey", F.round("above_m", 6).alias("above"))


@query(f"""WITH u AS (SELECT *, (texel>>1)&255 AS tx, texel>>9 AS ty, texel&1 AS h FROM {TEXELS}), p AS (SELECT *, CASE WHEN tx%2=1 AND ty%2=1 THEN 1 WHEN tx%2=0 AND ty%2=0 THEN 0 ELSE h END AS ph FROM u)
SELECT depth - 1 AS depth, prefix >> 2 AS prefix, (((((prefix & 1) * 128 + ty // 2) * 256) + ((prefix >> 1) & 1) * 128 + tx // 2) * 2 + ph) AS texel, CAST(least(greatest(round(avg(mag * 3e0 - 200) * 100), -32767), 32767) AS INT) AS cm FROM p GROUP BY ALL""")
def a14_geoid_pyramid(spark, sf):
    t = texels(spark, sf).select("depth", "prefix", "texel", (F.col("mag") * 3.0 - 200).alias("metres"))
    return D.geoid_pyramid(t).select("depth", "prefix", "texel", D.centimetres(F.col("metres")).alias("cm"))


@query("""WITH t AS (SELECT l_orderkey % 20 AS cell, l_partkey * 7 % 4096 AS path, max(CASE WHEN l_partkey % 3 > 0 THEN l_suppkey * 13 % 1000 - 500 END) AS value FROM lineitem GROUP BY ALL), m AS (SELECT cell, k, path >> (2*k) AS node, CAST(trunc(sum(value) / count(*)) AS BIGINT) AS mean FROM t, range(1, 9) r(k) WHERE value IS NOT NULL GROUP BY ALL),
f AS (SELECT t.cell, t.path, arg_min(mean, k) AS mean FROM t JOIN m ON m.cell = t.cell AND m.node = t.path >> (2*k) WHERE t.value IS NULL GROUP BY ALL) SELECT cell, path, coalesce(value, mean, 0) AS value FROM t LEFT JOIN f USING (cell, path)""")
def z3_filled_holes(spark, sf):
    li = table(spark, sf, "lineitem")
    t = li.groupBy((F.col("l_orderkey") % 20).alias("cell"), (F.col("l_partkey") * 7 % 4096).alias("path"), (F.col("l_partkey") % 3).alias("m")).agg(F.max(F.col("l_suppkey") * 13 % 1000 - 500).alias("v"))
    t = t.groupBy("cell", "path").agg(F.max(F.when(F.col("m") > 0, F.col("v"))).alias("value"))
    return D.filled(t, ["cell"])


@query("SELECT o_orderkey AS key, o_custkey % 7 AS hash FROM orders WHERE o_orderkey % 4 = 0 OR o_custkey % 7 = o_orderkey % 7")
def j21_linked_layers(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 7).alias("hash"))
    base = o.select("key", F.when(F.col("key") % 4 != 0, F.col("key") % 7).alias("want"))
    return D.linked(base, o, ["key"])


@query(f"SELECT prefix, texel, class FROM (SELECT prefix, texel, CASE WHEN class = 1 THEN 12 ELSE class END AS class FROM {TEXELS}) WHERE NOT (class = 12 AND texel % 5 < 2)")
def f11_j24_rivers_outside_lakes(spark, sf):
    t = texels(spark, sf).select("prefix", "texel", F.when(F.col("class") == 1, 12).otherwise(F.col("class")).cast("bigint").alias("class"))
    return D.not_in_water(t, t.where("texel % 5 < 2"))


@query(f"""WITH {GLOBE}, c AS (SELECT DISTINCT {V.prefix_sql(6)} AS prefix FROM coded), g AS (SELECT prefix, list_sum([((prefix >> (2*i+1)) & 1) << i for i in range(6)]) AS x, list_sum([((prefix >> (2*i)) & 1) << i for i in range(6)]) AS y FROM c WHERE prefix >> 12 = 3)
SELECT prefix, CAST(greatest(abs(x - 20), abs(y - 33)) AS BIGINT) AS far FROM g ORDER BY far, prefix LIMIT 48""")
def t5_nearest_cells(spark, sf):
    """The 48 cells to load first around the cell in the middle of the view."""
    c = globe(spark, sf).select(C.prefix(6).alias("prefix")).distinct()
    spread = lambda x: sum(((x >> i) & 1) << (2 * i) for i in range(6))
    return D.nearest_first(c, 6, (3 << 12) | spread(20) << 1 | spread(33), 48).withColumn("far", F.col("far").cast("bigint"))


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY id % 5 ORDER BY CASE kind WHEN 64 THEN 0 WHEN 65 THEN 0 WHEN 66 THEN 5 WHEN 67 THEN 5 ELSE 1 END, id % 3 = 0 DESC, rank DESC, id % 11 DESC, id) AS INT) AS place FROM {V.sql('g_place')}")
def t7_label_order(spark, sf):
    from ..functions import classify as K

    p = V.view(spark, sf, "g_place").select((F.col("id") % 5).alias("cell"), "id", K.tier(F.col("kind")).alias("tier"), (F.col("id") % 3 == 0).alias("shown"), "rank", (F.col("id") % 11).alias("texels"))
    return D.label_order(p).select("id", "place")


@query(f"SELECT DISTINCT 14 AS depth, prefix FROM {TEXELS} WHERE prefix >> 4 = 805306368 >> 4 AND cov > 80")
def f8_cells_under_a_piece(spark, sf):
    c = texels(spark, sf).select(F.lit(14).alias("depth"), "prefix").distinct()
    shape = texels(spark, sf).where("cov > 80").select(F.lit(14).alias("depth"), "prefix")
    return D.under_piece(c, 12, 805306368 >> 4, shape)


@query(f"WITH {GLOBE} SELECT DISTINCT 6 AS depth, {V.prefix_sql(6)} AS prefix FROM coded")
def u3_pinned_cells(spark, sf):
    return D.pinned(globe(spark, sf).select((F.col("orderkey") % 3).alias("area"), F.lit(6).alias("depth"), C.prefix(6).alias("prefix")))
